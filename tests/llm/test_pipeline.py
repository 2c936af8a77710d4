"""Every stage of the pipeline on what the one before it kept, against a plain version."""

import re

import pytest

import corpus_pipeline
from reviewloom.llm import toxicity
from reviewloom.llm.pieces import MARK
from reviewloom.session import written

from .test_jaccard_join import brute as components_of
from .test_line_dedup import brute as without_lines

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Documents before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_stages_keep_the_columns(steps):
    assert [s.columns for s in steps[1:-1]] == [COLUMNS] * 4
    assert steps[-1].columns[:5] == COLUMNS


def test_toxicity_keeps_clean_documents(spark, steps):
    model = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(steps[0], model).collect() if r.score < model.thresholds.get(r.lang, model.thresholds[None])}
    assert {i for i, in rows(steps[1], "doc_id")} == want
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {i for i, in rows(steps[0], "doc_id")} - want
    assert sum(labels.get(i) == 1 for i in gone) >= 0.7 * sum(i in labels for i in gone) > 0
    texts = dict(rows(steps[0], "doc_id", "text"))
    assert all(t == texts[i] for i, t in rows(steps[1], "doc_id", "text"))


def test_line_dedup(steps):
    want = without_lines(rows(steps[1], "doc_id", "text", "source"), 10, 10)
    assert sorted(rows(steps[2], "doc_id", "text"), key=str) == [w[:2] for w in want]
    assert all(n == len(t) for t, n in rows(steps[2], "text", "n_chars"))


def test_one_document_of_each_group_stays(steps):
    found = components_of(rows(steps[2], "doc_id", "text"), 5, 80)
    assert sorted(i for i, in rows(steps[3], "doc_id")) == [i for _, i, _, smallest in found if i == smallest]


def test_documents_with_test_items_go(spark, steps):
    norm = lambda t: f" {' '.join(re.findall(r'[^\\W_]+', t.lower()))} "
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = dict(rows(steps[3], "doc_id", "text")), {i for i, in rows(steps[4], "doc_id")}
    hit = {i for i, t in before.items() if any(b in norm(t) for b in items)}
    assert hit and after <= before.keys() and not hit & after
    assert len(before) - len(after) <= 1.2 * len(hit) + 1  # clean documents stay


def test_pieces_read_back(steps):
    assert steps[5].count() == steps[4].count()
    assert all(same or MARK in t for same, t in rows(steps[5], "same", "text"))


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [(5, long), (3, long + " x"), (None, long), (4, "short"), (4, "short"), (6, None), (6, None), (7, ""), (None, "alone"), (None, "alone"), (8, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert sorted(rows(kept, "doc_id", "text"), key=str) == sorted([(3, long + " x"), (4, "short"), (6, None), (6, None), (7, ""), (None, "alone")], key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
    assert docs.count() == 0
