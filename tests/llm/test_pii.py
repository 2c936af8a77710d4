import hashlib
import re

from pyspark.sql import functions as F

from reviewloom.llm.pii import BASE, PATTERNS, find_spans, listed
from reviewloom.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    None, "", "a@b.c_d@e.f", "a@b.c@d.e x@y", "é a.b@c.de \U0001f600 9.9.9.9", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "12 4111111111111111 1", "41111111111111111111111111", "+49 (0)30 1234567.",
    "+1 ++12345678- +123456789012345 +1234567890123456", "@" * 50, "a" * 30000, "1" * 30000, "+1" + "." * 5000, "x@" + "a." * 3000 + "b",
    "Karte\n4000 0000 0000 0002, mail: q%w@host-1.example.org.", "IBAN DE89 3704 0044 0532 0130 00 ok", "id 123-45-6789; social security 123-45-6789",
    " ".join(f"u{i}@h.io" for i in range(700)),
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] * 2, "doc_id int, text string, spans string")
    got = find_spans(df).select("doc_id", listed(BASE, F.col("spans")).alias("s"))
    rows = got.collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert r.s == base(ODD[r.doc_id]), ODD[r.doc_id]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_phone == want.count("phone:")


def test_added_kinds_need_their_checks(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.", "id 123-45-6789", "social security 123-45-6789", "ssn 000-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind not in BASE] for r in find_spans(df).collect()}
    assert got == {0: [("iban", 5, 32)], 1: [], 2: [], 3: [("ssn", 16, 27)], 4: []}


def test_empty_table(spark):
    assert find_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert set(PLAIN) == set(BASE) and set(BASE) < set(PATTERNS)
