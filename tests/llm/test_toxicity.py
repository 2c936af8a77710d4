import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewloom.llm import toxicity
from reviewloom.llm.queries import QUERIES


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op4_convolutional_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, y = (np.array(x) for x in zip(*own))
    assert auc(score, y) > 0.95
    flagged = score >= 0.3
    assert y[flagged].mean() > 0.85 and flagged[y == 1].mean() > 0.85


def test_portions_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(3)
    texts = pa.array(["", "bad", *(" ".join(rng.choice(["good", "fine", "bad", "bads", "so"], 9)) for _ in range(200))])
    y = np.array(["bad" in t for t in texts.to_pylist()], np.float32)
    docs, features = toxicity.tokens_of(texts)
    again, features_again = toxicity.tokens_in_slices(texts)
    assert [features[d].tolist() for d in docs] == [features_again[d].tolist() for d in again]
    model = toxicity.train(docs, features, y, np.ones(len(y), np.float32), epochs=20)
    whole = toxicity.scored(model, docs, features)
    assert np.allclose(whole, toxicity.scored(model, docs, features, most=20), atol=1e-6)
    assert np.allclose(whole, np.concatenate([model.score(*toxicity.tokens_of(texts.slice(i, 1))) for i in range(len(texts))]), atol=1e-6)
    assert auc(whole, y) > 0.99


def test_thresholds_by_language():
    score = np.array([0.9] * 30 + [0.5] * 30 + [0.1] * 10 + [0.9] * 5)
    label = np.array([1] * 30 + [0] * 30 + [0] * 10 + [1] * 5)
    langs = ["a"] * 70 + ["b"] * 5
    out = toxicity.language_thresholds(score, label, np.ones(75), langs)
    assert out["a"] == 0.9 and out["b"] == out[None] == 0.9
    assert toxicity.language_thresholds(score[:0], label[:0], np.ones(0), []) == {None: toxicity.FLOOR}
    assert toxicity.language_thresholds(np.full(40, 0.8), np.zeros(40), np.ones(40), ["a"] * 40) == {None: 1.0, "a": 1.0}


def test_thresholds_that_miss_the_precision():
    # two mislabelled texts at the top of b, a clean text weighing eight toxic ones
    score = np.array([0.9] * 200 + [0.99] * 2 + [0.8] * 35)
    label, langs = np.array([1] * 200 + [0] * 2 + [1] * 35), ["a"] * 200 + ["b"] * 37
    weight = np.where(label == 1, 1.0, 8.0)
    out = toxicity.language_thresholds(score, label, weight, langs)
    assert out[None] == out["b"] == out["a"] == toxicity.FLOOR
    assert toxicity.language_thresholds(score[:202], label[:202], weight[:202], ["a"] * 180 + ["b"] * 22, least=5)["b"] == toxicity.FLOOR
    clean = np.array([0] * 30 + [1] * 300)
    assert toxicity.language_thresholds(np.full(330, 0.9), clean, np.ones(330), ["c"] * 30 + ["a"] * 300)["c"] == toxicity.FLOOR
    assert toxicity.language_thresholds(score[200:], label[200:], weight[200:], langs[200:]) == {None: toxicity.FLOOR, "b": toxicity.FLOOR}


def test_odd_rows(spark):
    rows = [(i, f"text {'vile' if i % 3 == 0 else 'kind'} number {i}", "en") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "xx"), (None, "vile", "en"), (3, rows[3][1], "en"), (1002, "vile " * 50_000, "en"), (1003, "é \U0001f600 !!", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, y int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0), (4, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).withColumn("flag", toxicity.flagged(model)).collect()
    assert len(out) == len(rows) and out[0].y == 1
    by = {r.doc_id: r for r in out}
    assert by[0].score > 0.5 > by[1].score and by[1000].score == by[1001].score and by[1002].flag and by[1000].flag is False
    constant = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score(docs, constant).collect()} == {1.0}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where(F.lit(False)), model).collect() == []


def test_sample_holds_both_classes(spark, monkeypatch):
    labels = [(i, int(i % 9 == 0)) for i in range(900)]

    class Packed:
        def __init__(self, y):
            self.y = y

        def packed(self):
            return bytes(self.y)

    monkeypatch.setattr(toxicity, "learnt", lambda rows, toxic, clean: Packed([r[3] for r in rows]))
    monkeypatch.setattr(toxicity.Classifier, "unpacked", staticmethod(lambda data: list(bytes(data))))

    def sample(texts, **bounds):
        docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
        y = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), **bounds)
        return y.count(0), y.count(1)

    alike = [(i, "x" * 100) for i, _ in labels]
    assert sample(alike, max_docs=80, max_chars=6000) == (30, 30)
    assert sample(alike, max_docs=80, max_chars=10**6) == (40, 40)
    # one text beyond all bounds, first by hash, is passed over
    ids = spark.createDataFrame(labels, "id long, y int").where("crc32(cast(cast(id as string) as binary)) % 4 <> 2")
    first = ids.orderBy(F.xxhash64(F.lit("sample"), "id")).first().id
    assert sample([(i, "x" * (50_000 if i == first else 100)) for i, _ in labels], max_docs=80, max_chars=6000) == (30, 30)
    # what a small class leaves over goes to the other
    assert sample([(i, "x" if y else "x" * 100) for i, y in labels], max_docs=100, max_chars=4050) == (40, 50)
    assert sample([(i, "x" * 9000 if y else "x") for i, y in labels], max_docs=10, max_chars=100) == (5, 1)


def test_score_equals_a_plain_forward_pass_after_packing(spark):
    """Windows, filters and pooling in loops, on the weights that come back from the learning task."""
    docs = spark.createDataFrame([(i, f"{'vile scum ' if i % 5 == 0 else 'nice day '}word{i % 9} x{i} " * (1 + i % 4), "en") for i in range(600)], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic"))
    again = toxicity.Classifier.unpacked(model.packed())
    assert again.thresholds == model.thresholds and set(again.filters) == set(toxicity.WIDTHS)
    texts = pa.array(["", "vile", "nice day word3", "vile scum word1 x5 vile scum", "a b c d e f g h"], pa.large_string())
    tokens, features = toxicity.tokens_of(texts)
    got = again.score(tokens, features)
    for t, value in zip(tokens, got):
        word = [again.embed[features[w]].sum(0) for w in t] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
        pooled = []
        for w, f in again.filters.items():
            spots = [sum(word[i + k] @ f[k] for k in range(w)) for i in range(max(1, len(t)))]
            pooled.append(np.max(spots, axis=0))
        hidden = np.maximum(np.concatenate(pooled) + again.bias, 0)
        assert abs(1 / (1 + np.exp(-(hidden @ again.out + again.out_bias))) - value) < 1e-4


def test_a_column_named_like_the_score_is_replaced(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 3 == 0 else 'nice'} w{i}", "en", "old") for i in range(90)], "doc_id long, text string, lang string, score string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"))
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score"] and all(isinstance(r.score, float) for r in out.collect())


def test_every_labelled_text_is_learnt_or_calibrates(spark, monkeypatch):
    """Blocks hold all labelled texts but the calibration part, once each, whatever their number; no sample is drawn."""
    docs = spark.createDataFrame([(i, f"{'vile scum' if i % 4 == 0 else 'nice day'} word{i} " * (1 + i % 5), "en") for i in range(4000)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("cast(doc_id as int) as doc_id", "cast(doc_id % 4 = 0 as int) as toxic")  # ids of another type
    monkeypatch.setattr(toxicity, "sampled", lambda *_: 1 / 0)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 40_000)
    made, calibrating = [], []
    learner, calibrated = toxicity._block_learner, toxicity.calibrated

    def counting(model, number, epochs):
        inner = learner(model, number, epochs)
        made.append(number)
        return inner

    monkeypatch.setattr(toxicity, "_block_learner", counting)
    monkeypatch.setattr(toxicity, "calibrated", lambda scores: calibrating.append(scores.count()) or calibrated(scores))
    written = []
    plain = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    model = toxicity.fit(docs, labels)
    texts = dict(written)["toxicity-texts"]
    own = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(int(r.id) for r in texts.collect()) == own and len(own) > 2800
    learnt = texts.where("part > 0")
    assert made == list(range(toxicity.ROUNDS))
    ids = [f"{i}" for i in range(500)]
    batches = [pa.RecordBatch.from_pydict({"id": ids[a:a + 70], "text": ["x" * 1000] * len(ids[a:a + 70])}) for a in range(0, 500, 70)]
    blocks = [t.column("id").to_pylist() for t in toxicity._blocks(batches)]
    assert sum(blocks, []) == ids and all(30 < len(b) < 60 for b in blocks[:-1]) and len(blocks) > 8
    assert learnt.count() + calibrating[0] == len(own) and 0.1 < calibrating[0] / len(own) < 0.3
    out = toxicity.score(docs, model).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out)


def test_averages_of_blocks():
    """A word vector is averaged over the blocks that moved it, everything else over all."""
    model = toxicity.untrained(0.2, np.random.default_rng(1))
    sizes = [x.shape for x in toxicity._sliced(model)]
    first, second = ([np.zeros(s, np.float32) for s in sizes] for _ in range(2))
    first[0][0], first[0][1], second[0][1], first[-1][:], second[-1][:] = 1, 2, 4, 1, 3
    batch = lambda moved: pa.RecordBatch.from_arrays([pa.array(range(len(moved)), pa.int32()), pa.array([m.tobytes() for m in moved], pa.binary())], names=["slice", "moved"])
    means = next(toxicity._averaged([batch(first), batch(second)]))
    after = toxicity.added(model, dict(zip(means.column(0).to_pylist(), means.column(1).to_pylist())))
    moved = after.embed - model.embed
    assert np.allclose(moved[0], 1, atol=1e-5) and np.allclose(moved[1], 3, atol=1e-5) and not moved[2:].any()
    assert np.allclose(after.bias - model.bias, 2, atol=1e-5) and abs(after.out_bias - model.out_bias - 2) < 1e-5
    assert all(np.allclose(after.filters[w] - f, 2, atol=1e-5) for w, f in model.filters.items())
