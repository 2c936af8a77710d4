"""Text features by lookup in tasks against the join of exploded tokens, and tokens against Spark's expressions."""

import pyarrow as pa
from pyspark.sql import functions as F

from reviewloom.functions.strings import WS_CHARS, letter_words, words
from reviewloom.operators import bounds, featurise
from tests.conftest import rows

TEXTS = [
    "", " ", "one", "One two,three  FOUR", "\u00e9t\u00e9 \u00df\u0130 na\u00efve\u0301x", f"a{'b'.join(WS_CHARS)}c", "\U0001f600 x\U00020000y \U0001f600z",
    "1a2b\u2028c\u00a0d", "\u3000lead and trail\x85", "x" * 3000, "word " * 700, "\u4e2d\u6587 \u0440\u0443\u0441\u0441\u043a\u0438\u0439",
]


def test_tokens_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").select("id", "t", F.lower("t").alias("low"), letter_words(F.col("t")).alias("l"), words(F.lower("t")).alias("w"))
    got = df.orderBy("id").collect()
    texts = pa.array([None, *[r.low for r in got]]).slice(1)  # not from the start of its buffers
    for (tokens, size), want in zip(featurise._tokens(texts, [featurise._letters(spark), featurise._no_space()]), ([r.l for r in got], [r.w for r in got])):
        assert tokens.to_pylist() == sum(want, []) and size.tolist() == [len(w) for w in want]
    assert [x for a, e in featurise._portions(texts, 3000) for x in range(a, e)] == list(range(len(TEXTS)))


def test_a_dictionary_that_tasks_hold_needs_no_shuffle(spark, monkeypatch):
    flat = lambda kind, names: spark.createDataFrame(names, f"token string, {kind}")
    dictionary = featurise.merged_dictionary(
        flat("tag string", [("one", "NN"), ("two", "JJ"), ("word", "NN")]), flat("category string", [("one", "miedo"), ("x", "miedo")]), flat("topic string", [("two", "help")]),
        flat("valence int", [("word", 2), ("one", -1)]), spark.createDataFrame([("one",), ("two,three",), ("trail",)], "token string"))
    docs = spark.createDataFrame([(i, t, TEXTS[-1 - i], None if i % 3 == 0 else t + " one word") for i, t in enumerate(TEXTS)], "id int, `a.s` string, p string, c string")
    run = lambda: featurise.review_features(docs, "id", dictionary, ["NN", "JJ"], "a.s", "p", "c")
    held = run()
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    monkeypatch.setattr(bounds, "SETTLED_ROWS", 0)
    monkeypatch.setattr(featurise, "SETTLED_ROWS", 0)
    joined = run()
    assert held.dtypes == joined.dtypes and rows(held, "id") == rows(joined, "id")
