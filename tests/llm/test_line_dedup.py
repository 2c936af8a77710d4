import random

import pytest

from reviewloom.llm import line_dedup
from reviewloom.llm.line_dedup import remove_boilerplate
from reviewloom.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck

BLANKS = " \t\r\x0b\x0c"


def brute(rows, least, several):
    """(id, text, n_lines, n_removed) with sets of sites."""
    sites, texts, keeper = {}, {}, {}
    for i, t, s in rows:
        for line in {x.strip(BLANKS) for x in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(s or "\0")
            texts.setdefault(line, set()).add(t)
            if i is not None:
                keeper[line] = min(i, keeper.get(line, i))
    found = {x for x in sites if len(sites[x]) >= least and len(texts[x]) >= several}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if x.strip(BLANKS) not in found or keeper.get(x.strip(BLANKS)) == i]
        out.append((i, "\n".join(stay), len(lines) if t else 0, len(lines) - len(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    problem, n = differences(spark, duck(sf), QUERIES["op7_distinct_site_spread"], ORACLES["op7_distinct_site_spread"], sf)
    assert not problem and n == 1000


@pytest.mark.parametrize("spread", [line_dedup.SPREAD, 10.0])  # 10: every line is near the threshold
@pytest.mark.parametrize("least, several", [(1, 1), (3, 2), (40, 9)])
def test_odd_rows(spark, monkeypatch, least, several, spread):
    monkeypatch.setattr(line_dedup, "SPREAD", spread)
    rng = random.Random(6)
    rows = [(i, "\n".join([f"own {i}", f"line {rng.randrange(30)} ", "everywhere", "", f"\tpart {i % 4}\r"]), f"site{i % 60}") for i in range(300)]
    rows += [(i, "copied\nas a whole\n", f"site{i % 60}") for i in range(400, 520)]
    rows += [(600, None, "s"), (601, "", None), (602, "\n\n", None), (603, "everywhere", None), (None, "everywhere\nx", "site1"), (3, "everywhere\nagain", "site9"), (3, "everywhere\nagain", "site9"), (604, "everywhere\n" * 3000, "z")]
    df = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, n_lines int")
    assert got(remove_boilerplate(df, min_sites=least, min_texts=several)) == brute(rows, least, several)


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([(1, "a", "s", "kept")], "doc_id long, text string, source string, extra string")
    assert remove_boilerplate(df.limit(0)).collect() == []
    assert remove_boilerplate(df).columns == ["doc_id", "text", "source", "extra", "n_lines", "n_removed"]


def test_columns_of_any_name_stay(spark):
    names = ["_gone", "_some", "_gone_id", "_kept", "row", "lines", "some", "id", "kept", "a.b", "line", "site"]
    rows = [(i, f"own {i}\nshared", f"s{i}", *[f"{n}{i}" for n in names]) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = remove_boilerplate(df, min_sites=2, min_texts=2)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(i, f"own {i}" if i else text, *rest, 2, int(i > 0)) for i, text, *rest in rows]


def test_sites_of_copies_count(spark):
    """A line that stands on three sites through copies, and in two texts, goes; a text that is only copied stays."""
    rows = [(1, "a\nline", "x"), (2, "a\nline", "y"), (3, "a\nline", "z"), (4, "b\nline", "x"), *[(10 + i, "copied only", f"s{i}") for i in range(9)]]
    out = {r.doc_id: r.text for r in remove_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string"), min_sites=3, min_texts=2).collect()}
    assert out[1] == "a\nline" and out[4] == "b" and out[2] == "a" and all(out[10 + i] == "copied only" for i in range(9))
