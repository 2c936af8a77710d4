import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import jaccard_join
from reviewloom.llm.components import components
from reviewloom.llm.jaccard_join import divide_skip, similar_components
from reviewloom.llm.queries import QUERIES

from .brute import shingles


def brute(rows, width, percent):
    """(number of shingles, smallest id reachable) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x] if j > i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted((i is not None, i or 0, len(sets[k]), -1 if least[find(k)] is None else least[find(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op8_jaccard_join"](spark, sf)) == brute(rows, 3, 90)


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_chains_of_edits_and_odd_rows(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "LONG", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(None, None), (0, ""), (1, " \n"), (2, "A b"), (3, "a B"), (4, "x"), (5, "x"), (None, "x"), (6, "q " * 20_000), (7, "Q\t" * 30_000)]
    for k in range(90):  # edits on edits, a few words at a time, so that links form chains
        if k % 3 == 0:
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        text = [w if rng.random() > 0.01 else rng.choice(vocabulary) for w in base]
        rows.append((100 + k, " ".join(text)))
    rows += [(300 + k, "common words at the start " + " ".join(rng.choice(vocabulary) for _ in range(8))) for k in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token string, class int")
    assert got(similar_components(df, width=width, percent=percent)) == brute(rows, width, percent)


def test_empty_table(spark):
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_divide_skip_counts_like_a_dictionary(monkeypatch):
    rng = np.random.default_rng(1)
    for least in (1, 2, 4):
        lists = [np.unique(rng.integers(0, 300, n)) for n in (3, 5, 90, 200, 250)]
        every = np.concatenate(lists)
        want = {int(k): int((every == k).sum()) for k in np.unique(every) if (every == k).sum() >= least}
        assert divide_skip(lists, least) == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(path, "a long, b long")
    out = {r.node: r.label for r in components(df).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(df.where(F.lit(False))).collect() == []


def test_bitmaps_bound_the_difference_from_below():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 63, 64, 65, 300, 700]
    sets = [rng.choice(2**40, n, replace=False).astype(np.uint64) for n in sizes]
    sets += [np.concatenate((sets[6][k:], sets[7][:k])) for k in (1, 10, 200)]
    bits = jaccard_join.parity_bits(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    maps = [np.frombuffer(b.as_buffer(), np.uint64) for b in bits]
    for x, a in zip(sets, maps):
        for y, b in zip(sets, maps):
            if len(a) and len(b):
                assert jaccard_join.apart(a, b) <= len(set(x.tolist()) ^ set(y.tolist()))
    assert jaccard_join.apart(maps[6], maps[8]) == 2 and jaccard_join.apart(maps[6], maps[10]) > 100


def test_only_classes_that_may_link_bring_their_whole_sets(spark, monkeypatch):
    """Texts of equal rare words and unlike rest share what is indexed, and still are not compared whole."""
    asked = []
    real = jaccard_join.whole_sets
    monkeypatch.setattr(jaccard_join, "whole_sets", lambda texts, pairs, *rest: (asked.append(pairs.count()), real(texts, pairs, *rest))[1])
    rng = random.Random(3)
    rare = [f"rare{i}" for i in range(60)]
    rows = [(k, " ".join(rare + [f"v{rng.randrange(9)}x{rng.randrange(9)}" for _ in range(120)])) for k in range(40)]
    rows += [(100 + k, " ".join(f"own{i}" for i in range(100 + k))) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(similar_components(df, width=1, percent=90)) == brute(rows, 1, 90)
    assert sum(asked) <= 5


def test_sketches_are_sent_in_few_bytes():
    rng = np.random.default_rng(4)
    counts = rng.poisson(9, 1 << 16).astype(np.int64)
    counts[:3] = 1 << 40, 70_000, 300
    assert (jaccard_join.unpacked(jaccard_join.packed(counts)) == counts).all()
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 400_000, 1000)) + " the" * 3000 for _ in range(150)])
    parts = list(jaccard_join._counters(1, 1 << 14)([pa.RecordBatch.from_pydict({"text": texts})]))[0]
    held = np.concatenate([jaccard_join.unpacked(x.as_py()) for x in parts["counts"]])
    assert held.max() >= 450_000 and sum(parts["every"].to_pylist()) == 150 * 4000
    assert sum(len(x.as_py()) for x in parts["counts"]) < (1 << 14) / 4
