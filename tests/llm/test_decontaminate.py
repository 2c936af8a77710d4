import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm import decontaminate
from reviewloom.llm.decontaminate import Index, find_leaks
from reviewloom.llm.queries import QUERIES


def scores(index, hashes):
    """Scores of all items against a set of words, without any bound."""
    out = [0.0] * len(index.items)
    for t in {int(t) for t in index.terms(hashes) if t >= 0}:
        for i, x in zip(*index.lists[t]):
            out[i] += x
    return out


@pytest.mark.parametrize("least", [0.05, 0.3, 0.6])
def test_search_and_first_bound_lose_nothing(least):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(90)]
    index = Index(items)
    for _ in range(60):
        own = rng.choice(items)[1].split()
        words = [rng.choice(vocabulary) for _ in range(25)] + own[:rng.randrange(len(own) + 1)]
        hashes = decontaminate.word_hashes(" ".join(words))
        terms = sorted({int(t) for t in index.terms(hashes) if t >= 0})
        want = {i for i, x in enumerate(scores(index, hashes)) if x >= least - 1e-12}
        found = dict(index.search(terms, least))
        assert found.keys() == want
        rare = [t for t in terms if not index.common[t]]
        may = index.bounded(np.zeros(len(rare), np.int64), np.array(rare, np.int64), least)
        assert len(may) or not want or (index.common_mass >= least - 1e-9).any()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op3_block_max_wand"](spark, sf).collect()}
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d, i) for i, b in items.items() for d, t in docs.items() if f" {norm(b)} " in f" {norm(t)} "}
    assert want and want <= got.keys()
    for key in got.keys() - want:  # what else is found holds most of the item's words in order
        assert min(got[key].question_overlap, got[key].answer_overlap) >= 0.5
    assert len(got) <= 1.2 * len(want)


def test_parts_share_statistics(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 200}" for _ in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(3)) + ".") for i in range(60)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = []
    for i in range(120):  # items with some words gone, so that scores lie on both sides of the threshold
        words = rng.choice(items)[1].split()
        kept = [w for w in words if rng.random() > rng.choice((0, 0.1, 0.3, 0.5))]
        docs.append((i, f"{noise(rng.randrange(80))} {' '.join(kept)} {noise(rng.randrange(80))}"))
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    chars = sum(len(t) for _, t in items)
    one, five = (sorted(map(tuple, find_leaks(df, tests, index_chars=-(-chars // n)).collect())) for n in (1, 5))
    assert len(one) > 40 and one == five


def test_odd_rows_and_shards(spark):
    item = "Which river runs through the old town of Brenlow? The river Tassel runs through it."
    other = "A short one. Yes."
    filler = " ".join(f"filler{i}" for i in range(400))
    docs = [(0, filler), (1, f"{filler} {item.upper()} {filler}"), (2, item), (2, item), (None, f"x {item}"), (3, None), (4, ""), (5, item[:30]), (6, (filler + " ") * 60 + item),
            (7, f"{filler} a SHORT one yes"), (8, "The river Tassel runs through it."), (9, item.replace(" ", "\n* "))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int")
    tests = spark.createDataFrame([(10, item), (11, other), (12, None), (13, ""), (14, "?!"), (10, item), (15, "one")], "item_id long, text string")
    for chars in (10**9, 60):
        rows = find_leaks(df, tests, index_chars=chars).collect()
        got = {(r.doc_id, r.item_id) for r in rows if r.item_id in (10, 11)}
        assert got == {(1, 10), (2, 10), (None, 10), (6, 10), (7, 11), (9, 10)}
        assert sum(r.doc_id == 2 and r.item_id == 10 for r in rows) == 4  # two rows, two equal items
    assert find_leaks(df, tests.limit(0)).collect() == [] and find_leaks(df.limit(0), tests).collect() == []
    assert list(Index([]).leaks(pa.array(["a b"]), 0.6, 0.5)) == []
