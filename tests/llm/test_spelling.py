import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import spelling
from reviewloom.llm.queries import ORACLES, QUERIES
from reviewloom.llm.spelling import SYMBOLS, neighbourhood, reduced, roots, symbols_for, variant_groups, variants
from tests.compare import differences, duck
from tests.llm.brute import ascii_lower


def one_edit(a, b):
    """Whether two strings differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count, ratio):
    out = []
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def corpus_count(rows, length, least, one_in):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += len(run) >= length
    return {w: n for w, n in count.items() if n >= least}


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(spark, duck(sf), QUERIES["op13_spelling_variants"], ORACLES["op13_spelling_variants"], sf)[0] == ""


def made_words(seed, n):
    """Words that are often an edit or two away from one another, with ties among their numbers."""
    rng = random.Random(seed)
    words = {"colour"}
    while len(words) < n:
        w = list(rng.choice(sorted(words)))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "ÿ", "o", "zz", "日", "𝄞"])
        if w:
            words.add("".join(w))
    return {w: rng.choice([1, 1, 5, 5, 7, 30, 200, 5000]) for w in words}


@pytest.mark.parametrize("symbols", [None, 1, 2, 9])
def test_variants_equal_brute_force(spark, symbols):
    count = made_words(3, 160)
    df = spark.createDataFrame(sorted(count.items()), "word string, n long")
    assert got(variants(df, 5, symbols)) == brute(count, 5)


def test_corpus_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["Kolour", "colour", "colours", "coloúr", "COLOUR", "colou", "neighbour", "neighbor", "Ünder", "ünder", "a", "×÷"]
    rows = [(rng.choice([None, i, i // 2]), rng.choice([None, "", *[" 1".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(5)]])) for i in range(80)]
    rows += rows[:10] + [(7, "colour " * 5000 + "neighbour")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id int, text string, word string, n int").repartition(3)
    for one_in in (None, 1, 3):
        assert got(variant_groups(df, least_length=5, least=3, slips_one_in=one_in)) == brute(corpus_count(rows, 5, 3, one_in), 5)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")], [(1, "123 !?")]])
def test_no_words(spark, rows):
    assert got(variant_groups(spark.createDataFrame(rows, "doc_id int, text string"), least=1)) == []


def test_neighbourhood_is_every_edit(spark):
    row = spark.range(1).select(neighbourhood(F.lit("abca"), 3).alias("x"), reduced(F.lit("hello"), 4).alias("r")).first()
    want = {"abca"} | {w for size in (3, 4, 5) for w in _strings("abc", size) if one_edit("abca", w)}
    assert len(row.x) == len(set(row.x)) and set(row.x) == want
    assert len(row.r) == 5 and set(row.r) <= set(SYMBOLS[:4]) and row.r[2] == row.r[3]


def _strings(letters, size):
    return [""] if not size else [x + c for x in _strings(letters, size - 1) for c in letters]


def test_roots_of_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5"), ("y", "z")]
    out = dict(tuple(r) for r in roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert out == {**{f"w{i}": "w13" for i in range(13)}, "x": "w13", "y": "z"}


def test_symbols_follow_the_vocabulary():
    assert [symbols_for(n) for n in (0, 1000, 10 ** 6, 10 ** 9)] == [4, 4, 5, 10]
    assert SYMBOLS.startswith(string.ascii_lowercase)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """A table that looks small by its file, or before it is exploded, must not reach the driver."""
    plans, kept = [], spelling.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(spelling, "written", seen)
    out = variants(spark.createDataFrame(sorted(made_words(4, 60).items()), "word string, n long"), 5)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60 and sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)
