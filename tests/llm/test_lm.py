import math
from collections import Counter

import numpy as np
import pandas as pd

from reviewloom.llm import lm
from reviewloom.llm.queries import QUERIES

from .brute import crc, words


def base(rows):
    """n_tokens, n_known, N and base score by the contract."""
    tokens = [[*words(t), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if crc(i) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in tokens]


def model(rows, weights):
    """The bigram model with given weights by bucket, from dictionaries."""
    one, two, context, starts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if crc(i) % 5 != 1:
            ws = ["<s>", *words(t), "</s>"]
            one.update(ws[1:])
            two.update(zip(ws, ws[1:]))
            context.update(ws[:-1])
    n, v, out = sum(one.values()), len(one), []
    for _, t in rows:
        ws = ["<s>", *words(t), "</s>"]
        total = 0.0
        for a, b in zip(ws, ws[1:]):
            c = context[a]
            w = weights[0 if c == 0 else min(int(math.floor(math.log2(c))) + 1, lm.BUCKETS - 1)]
            total += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + (w[2] * two[a, b] / c if c else 0))
        out.append(total)
    return out


def learned(monkeypatch):
    kept = []
    real = lm.learn_weights

    def spy(*args):
        kept.append(real(*args))
        return kept[-1]

    monkeypatch.setattr(lm, "learn_weights", spy)
    return kept


def test_whole_table(spark, monkeypatch):
    sf, kept = "/root/testdata/sf0.01", learned(monkeypatch)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op1_deleted_interpolation"](spark, sf).collect()}
    assert len(got) == len(rows)
    held = []
    for (i, _), (tokens, known, n, score), own in zip(rows, base(rows), model(rows, kept[0])):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.held_out == (crc(i) % 5 == 1) and math.isclose(r.base_score, score, rel_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9)
        if r.held_out:
            held.append((r.score, r.base_score))
    ours, plain = map(sum, zip(*held))
    assert ours > plain  # better than the smoothed single words on texts that it has not seen
    assert np.allclose(kept[0].sum(1), 1)


def test_odd_rows_and_blocks(spark, monkeypatch):
    kept = learned(monkeypatch)
    rows = [(i, f"a b{i % 7} c d{i % 3}" + " x" * (i % 5)) for i in range(400)]
    rows += [(None, "A B1 c"), (500, None), (501, ""), (502, " \n\t"), (503, "q " * 60_000), (504, "é x É"), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(3)
    want = sorted(zip([str(i) for i, _ in rows], base(rows)))
    for size in (10, 4096):
        got = lm.score_texts(df, rows_per_block=size).collect()
        for (i, (tokens, known, n, score)), r in zip(want, sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens))):
            assert (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) == (i, tokens, known, n) and math.isclose(r.base_score, score, rel_tol=1e-9)
        own = sorted(zip([str(i) for i, _ in rows], model(rows, kept[-1])))
        assert all(math.isclose(a[1], r.score, rel_tol=1e-9) for a, r in zip(own, sorted(got, key=lambda r: (str(r.doc_id), r.score))))
    assert lm.score_texts(df.limit(0)).collect() == []
    nothing = lm.score_texts(df.where("crc32(cast(doc_id as string)) % 5 = 1")).collect()  # nothing to learn from
    assert nothing and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)


def test_higher_order_and_counts(spark):
    rows = [(i, "a b c d e f") for i in range(50)] + [(60, "c b a")]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()}
    assert got[1].score > got[60].score
    counts = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (lm.widen([lm.narrow(counts), lm.narrow(counts[:2])], [6, 2]) == np.append(counts, counts[:2])).all()


def test_weights_reach_the_best_mixture():
    h = pd.DataFrame({"bucket": [3, 3], "p1": [-4, -40], "p2": [lm.LOWEST - 1, -4], "n": [30, 70]})
    w = lm.learn_weights(h, 2, 1000, rounds=500)[3]

    def loss(x):
        return -sum(n * np.log(x[0] / 1001 + x[1] * np.exp(a / 4) + x[2] * (0 if b < lm.LOWEST else np.exp(b / 4))) for a, b, n in zip(h.p1, h.p2, h.n))

    grid = [(1 - a - b, a, b) for a in np.arange(0, 1.01, 0.01) for b in np.arange(0, 1.01 - a, 0.01)]
    assert loss(w) < min(loss(g) for g in grid if min(g) > 1e-9) + 1.0
