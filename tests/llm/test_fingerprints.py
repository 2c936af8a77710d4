import hashlib

from reviewloom.llm.fingerprints import fingerprints
from reviewloom.llm.queries import QUERIES

from .brute import jaccard, shingles


def edited(rows):
    """Texts with their last half replaced by the start of the next document, by ascending id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + after[:half], after))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {i: (t, e, a) for i, t, e, a in edited([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])}
    rows = QUERIES["op2_one_permutation_minhash"](spark, sf).collect()
    assert len(rows) == len(want)
    prints, errors = {}, []
    for r in rows:
        t, e, a = want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        for other, near in ((e, r.near_edited), (a, r.near_next)):
            errors.append(abs(near - jaccard(shingles(t, 5), shingles(other, 5))))
    assert sum(errors) / len(errors) < 0.03 and sorted(errors)[int(0.98 * len(errors))] < 0.12


def test_odd_rows(spark):
    data = [(3, "one two three four five six", 1), (1, None, 2), (2, "", 3), (None, "a", 4), (7, " \n ", 5), (7, " \n ", 6), (5, "é" * 7, 7), (9, "w " * 50_000, 8), (-4, "One two three four five six", 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, _text int")
    for buckets in (1, 3, 600):
        got = fingerprints(df, buckets=buckets).collect()
        assert len(got) == len(data)
        want = sorted((i is not None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited([x[:2] for x in data]))
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want
        by = {r.doc_id: r for r in got}
        assert by[3].fingerprint == by[-4].fingerprint != "" and by[1].fingerprint == by[2].fingerprint == by[7].fingerprint == ""
        assert by[1].near_next == 1.0 and by[2].near_next == 0.0  # empty beside empty, and beside words


def test_one_row_and_none(spark):
    one = fingerprints(spark.createDataFrame([(1, "ab cd")], "doc_id int, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id int, text string")).collect() == []
