import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import phrases
from reviewloom.llm.phrases import Trie, collocations
from reviewloom.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck
from tests.llm.brute import ascii_lower


def brute(rows, longest, least, covered, top):
    """(lang, rank, phrase, a, l, r, n, score) with dictionaries."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                count.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            lang == other and len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (other, q), b in found.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    out.sort()
    ranked, places = [], Counter()
    for lang, score, a, p, left, right in out:
        places[lang] += 1
        if places[lang] <= top:
            ranked.append((lang, places[lang], p.decode(), -a, left, right, total[lang], -score))
    return sorted(ranked)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n):
    """Texts of few words, with pieces, odd blanks, letters beyond ASCII, nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "été", "Été", "of", "the", "a|b", "日本", "x" * 300]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\x0b", "   "]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([text, text, text, None, ""])))
    return rows + rows[:20] + [("en", "new york city " * 3000)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(spark, duck(sf), QUERIES["op11_phrase_collocations"], ORACLES["op11_phrase_collocations"], sf)[0] == ""


@pytest.mark.parametrize("longest, least, covered, top", [(3, 4, 50, 25), (4, 2, 80, 1000), (2, 3, 50, 1000)])
def test_equals_brute_force(spark, longest, least, covered, top):
    rows = made(longest, 250)
    df = spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows)], "lang string, text string, words int, h string, rank string").repartition(3)
    assert got(collocations(df, longest=longest, least=least, covered=covered, top=top)) == brute(rows, longest, least, covered, top)


def test_many_shards_and_small_flushes_change_nothing(spark, monkeypatch):
    rows = made(9, 200)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    monkeypatch.setattr(phrases, "SHARD", 7)
    monkeypatch.setattr(phrases, "FLUSH", 5)
    monkeypatch.setattr(phrases, "MOST_BITS", 16)
    assert got(collocations(df, least=3)) == brute(rows, 3, 3, 50, 2000)


def test_texts_are_read_once_for_all_tries(spark, monkeypatch):
    """The number of tries grows with the data; the passes over the texts must not."""
    rows = made(11, 200)
    calls, kept = [], phrases.count_states
    monkeypatch.setattr(phrases, "count_states", lambda *a: (calls.append(a), kept(*a))[1])
    monkeypatch.setattr(phrases, "SHARD", 7)
    monkeypatch.setattr(phrases, "HELD", 50)
    found = got(collocations(spark.createDataFrame(rows, "lang string, text string").repartition(2), least=3))
    assert found == brute(rows, 3, 3, 50, 2000) and len(calls) == 1 and len(calls[0][1]) > 9


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "")], [("en", "one two one two")]])
def test_nothing_to_find(spark, rows):
    assert got(collocations(spark.createDataFrame(rows, "lang string, text string"))) == []


def test_scores_are_exact_beyond_64_bits(spark):
    n = 3_000_000_019
    counts = spark.createDataFrame([([1, 2], n)], "words array<long>, n long")
    words = spark.createDataFrame([(1, n + 7), (2, n + 11)], "h long, n long")
    row = phrases.scored(counts, words).first()
    assert row.score == 1000000 * n * n // ((n + 7) * (n + 11))


def test_trie_accepts_its_phrases_only():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(1, 1 << 62, 300, dtype=np.uint64))
    rows = words[np.minimum(rng.zipf(1.3, (4000, 3)), len(words)) - 1]
    rows[rng.random(len(rows)) < 0.5, 2] = 0
    rows = np.unique(rows, axis=0)
    trie, state = Trie.build(rows)
    assert len(set(state.tolist())) == len(rows)
    again = Trie.unpacked(trie.packed())
    spelt = again.spell(rows.ravel()).reshape(rows.shape)
    at = again.step(again.step(np.zeros(len(rows), np.int64), spelt[:, 0]), spelt[:, 1])
    long = rows[:, 2] != 0
    at[long] = again.step(at[long], spelt[long, 2])
    assert (at == state).all()
    pairs = {tuple(r[:2]) for r in rows.tolist()}
    other = words[rng.integers(0, len(words), (3000, 2))]
    end = again.step(again.step(np.zeros(len(other), np.int64), again.spell(other[:, 0]).clip(0)), again.spell(other[:, 1]).clip(0))
    known = (again.spell(other) >= 0).all(1)
    assert all((e != 1) == (tuple(o) in pairs) for e, o, k in zip(end.tolist(), other.tolist(), known) if k)
