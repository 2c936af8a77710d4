"""Benchmark decontamination: training passages query a BM25 index of test items by block-max WAND.

Items are scored by BM25 over distinct query words, divided by the score an item reaches against itself, so that one
threshold (``THRESHOLD`` of an item's own score) serves all items.  Documents are cut into passages of twice the
longest item's words, one item's length apart, so every item lies whole in some passage.  A passage is passed over
where, for every item, its rare words and all of the item's common words together stay below the threshold; for the
others WAND retrieves all items above it, and a match stands if word triples of both the item's question and its
answer (its last sentence) recur in the passage.

The index is carried to the tasks, so it is built for at most ``INDEX_CHARS`` characters of items at a time; a larger
benchmark is searched in several such parts.  All parts share the statistics of the whole benchmark (document
frequencies, number of items, mean length, longest item), so results do not depend on their number.

Odd input: null texts are empty and match nothing; items without words are left out; repeated documents and items
match like any other (one row per document row's id and item); null ids are kept; an empty side gives no rows; texts of
any length are read whole, passage by passage; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .words import U, Words, joined, rows_of, slices, strings

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
BLOCK = 4  # items per block of a posting list
COMMON = 0.02  # words in more of the items than this count as present in the first bound
INDEX_CHARS = 32_000_000


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence; a single sentence is cut at three quarters of its words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 3 // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row."""
    out = hashes[:max(0, len(hashes) - width + 1)]
    for k in range(1, width):
        out = joined(out, hashes[k:k + len(out)])
    return np.unique(out)


def word_hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), letters_only=True).hash


@dataclass
class Statistics:
    """What BM25 and the passages need to know of the whole benchmark; ``df`` by word hash."""
    items: int
    words: int
    longest: int
    df: dict[int, int]


class Index:
    """Inverted index of items with block maxima; impacts are shares of an item's own score.

    ``stats`` are those of the whole benchmark where ``items`` are a part of it.
    """

    def __init__(self, items: list[tuple[object, str]], stats: Statistics | None = None):
        words = [word_hashes(t or "") for _, t in items]
        keep = [i for i, w in enumerate(words) if len(w)]
        self.items = [items[i][0] for i in keep]
        words = [words[i] for i in keep]
        parts = [question_and_answer(items[i][1]) for i in keep]
        self.width = [min(3, len(w)) for w in words]
        # a part of fewer than three words takes its neighbours in
        self.question = [grams(w[:max(n, len(word_hashes(q)))], n) for w, n, (q, _) in zip(words, self.width, parts)]
        self.answer = [grams(w[-max(n, len(word_hashes(a))):], n) for w, n, (_, a) in zip(words, self.width, parts)]
        counts = [Counter(w.tolist()) for w in words]
        stats = stats or Statistics(len(words), sum(map(len, words)), max(map(len, words), default=1), Counter(h for c in counts for h in c))
        n, df, self.longest = stats.items, stats.df, stats.longest
        mean = stats.words / max(n, 1)
        postings = defaultdict(list)
        for i, c in enumerate(counts):
            impact = {h: math.log(1 + (n - df[h] + 0.5) / (df[h] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / mean)) for h, tf in c.items()}
            own = sum(impact.values())
            for h, x in impact.items():
                postings[h].append((i, x / own))
        self.vocabulary = np.array(sorted(postings), dtype=U)
        lists = [postings[h] for h in self.vocabulary.tolist()]
        self.lists = [([i for i, _ in p], [x for _, x in p]) for p in lists]
        self.top = np.array([max(x) for _, x in self.lists])
        self.blocks = [[(ids[min(k + BLOCK, len(ids)) - 1], max(x[k:k + BLOCK])) for k in range(0, len(ids), BLOCK)] for ids, x in self.lists]
        # first bound: what rare words bring to an item, and all that its common words could
        self.common = np.array([df[h] > max(1, COMMON * n) for h in self.vocabulary.tolist()], dtype=bool)
        self.common_mass = np.zeros(len(words))
        for t in np.flatnonzero(self.common):
            self.common_mass[self.lists[t][0]] += self.lists[t][1]
        rare = [([], []) if c else p for c, p in zip(self.common, self.lists)]
        self.rare_first = np.concatenate(([0], np.cumsum([len(ids) for ids, _ in rare]))).astype(np.int64)
        self.rare_item = np.array([i for ids, _ in rare for i in ids], dtype=np.int64)
        self.rare_impact = np.array([v for _, x in rare for v in x], dtype=float)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for unknown ones."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def bounded(self, passage: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """Passages (numbers) in which some item may reach ``least``; pairs (passage, rare term) are distinct."""
        n = max(len(self.items), 1)
        size = self.rare_first[term + 1] - self.rare_first[term]
        at = np.repeat(self.rare_first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key, inverse = np.unique(np.repeat(passage, size) * n + self.rare_item[at], return_inverse=True)
        bound = np.bincount(inverse, self.rare_impact[at], len(key)) + self.common_mass[key % n]
        return np.unique(key[bound >= least - 1e-9] // n)

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose score reaches ``least``: document-at-a-time with a pivot, skipping by block maxima."""
        least -= 1e-9
        at = dict.fromkeys(terms, 0)
        found = []
        while True:
            live = sorted((t for t in terms if at[t] < len(self.lists[t][0])), key=lambda t: self.lists[t][0][at[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += self.top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = self.lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and self.lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead, ends = 0.0, []
            for t in live[:pivot + 1]:
                k = self._block(t, at[t], item)
                if k < len(self.blocks[t]):
                    ahead += self.blocks[t][k][1]
                    ends.append(self.blocks[t][k][0] + 1)
            if ahead < least:  # nothing before the first block's end can reach it
                beyond = self.lists[live[pivot + 1]][0][at[live[pivot + 1]]] if pivot + 1 < len(live) else 1 << 60
                to = max(item + 1, min(*ends, beyond) if len(ends) else beyond)
                for t in live[:pivot + 1]:
                    at[t] = self._reach(t, at[t], to)
                continue
            parts = []
            for t in live[:pivot + 1]:
                at[t] = self._reach(t, at[t], item)
                ids, x = self.lists[t]
                if at[t] < len(ids) and ids[at[t]] == item:
                    parts.append(x[at[t]])
                    at[t] += 1
            total = math.fsum(parts)  # whatever the order
            if total >= least:
                found.append((item, total))

    def _block(self, t: int, at: int, item: int) -> int:
        k = at // BLOCK
        while k < len(self.blocks[t]) and self.blocks[t][k][0] < item:
            k += 1
        return k

    def _reach(self, t: int, at: int, item: int) -> int:
        k = self._block(t, at, item)
        at = max(at, k * BLOCK)
        ids = self.lists[t][0]
        while at < len(ids) and ids[at] < item:
            at += 1
        return at

    def leaks(self, texts: pa.Array, threshold: float, overlap: float):
        """(row, item, score, question overlap, answer overlap, passages) of every verified match."""
        w = Words(texts, letters_only=True)
        step = self.longest
        n = np.diff(w.first)
        steps = np.maximum(1, -(-n // step))  # a passage starts at each step and takes two
        first = np.concatenate(([0], np.cumsum(steps)))
        row = rows_of(w.first)
        own = first[row] + (np.arange(len(row)) - w.first[row]) // step
        term = self.terms(w.hash)
        most = max(len(self.lists), 1)

        def distinct(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p, t = own[pick], term[pick]
            earlier = p > first[row[pick]]
            return np.divmod(np.unique(np.concatenate([p * most + t, (p[earlier] - 1) * most + t[earlier]])), most)

        known = term >= 0
        if not known.any():
            return
        may = self.bounded(*distinct(np.flatnonzero(known & ~self.common[term])), threshold)
        if (self.common_mass >= threshold - 1e-9).any():  # an item of common words only
            may = np.arange(first[-1])
        near = np.zeros(first[-1] + 1, bool)
        near[may] = True
        passage, term = distinct(np.flatnonzero(known & (near[own] | near[own - 1])))
        best: dict = {}
        rows = np.searchsorted(first, np.arange(first[-1]), side="right") - 1
        for p in may.tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            hits = self.search(term[a:b].tolist(), threshold)
            if not hits:
                continue
            r = int(rows[p])
            begin = int(w.first[r]) + (p - int(first[r])) * step
            words = w.hash[begin:min(begin + 2 * step, int(w.first[r + 1]))]
            for item, score in hits:
                seen = grams(words, self.width[item])
                shares = [float(np.isin(x, seen).mean()) for x in (self.question[item], self.answer[item])]
                if min(shares) >= overlap:
                    old = best.get((r, item), (0.0, 0.0, 0.0, 0))
                    best[r, item] = (*(max(x, y) for x, y in zip(old, (score, *shares))), old[3] + 1)
        for (r, item), values in sorted(best.items()):
            yield (r, item, *values)


def _words_of(batches):
    """Part, number of words and distinct word hashes of each item."""
    for b in batches:
        t = strings(b.column("text"))
        for at, end in slices(t):
            w = Words(t.slice(at, end - at), letters_only=True)
            sets = [np.unique(w.hash[i:j]).view(np.int64) for i, j in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("part").slice(at, end - at), pa.array(np.diff(w.first).astype(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["part", "n", "words"])


def _parts(items: DataFrame, n: int) -> Iterator[tuple[DataFrame, Statistics | None]]:
    """The items in ``n`` parts by hash, each with the benchmark's statistics; frequencies are those of the part's words."""
    if n == 1:
        yield items, None
        return
    items = items.withColumn("part", F.pmod(F.xxhash64("text", F.col("item").cast("string")), F.lit(n)))
    words = written(items.mapInArrow(_words_of, "part long, n long, words array<bigint>"), "item-words")
    facts = words.where("n > 0").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    spots = words.select("part", F.explode("words").alias("word"))
    df = spots.groupBy("word").agg(F.count("*").alias("df"))
    known = written(spots.distinct().join(df, "word"), "item-frequencies")
    for k in range(n):
        own = {r["word"] % (1 << 64): r["df"] for r in known.where(F.col("part") == k).toLocalIterator()}
        yield items.where(F.col("part") == k).drop("part"), Statistics(facts[0], facts[1] or 0, facts[2] or 1, own)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per document and test item that it holds: ids, score, question_overlap, answer_overlap, passages."""
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-int(chars) // index_chars) or 1
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, "item")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for part, stats in _parts(items, shards):
        index = Index(sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda x: (x[1] or "", str(x[0]))), stats)

        def run(batches, index=index):
            for b in batches:
                t = strings(b.column("text"))
                for at, end in slices(t):
                    rows = list(index.leaks(t.slice(at, end - at), threshold, overlap))
                    if rows:
                        r, item, *values = zip(*rows)
                        yield pa.RecordBatch.from_arrays([
                            b.column("id").slice(at, end - at).take(pa.array(r)), pa.array([index.items[i] for i in item]), *map(pa.array, values),
                        ], names=["id", "item", "score", "question_overlap", "answer_overlap", "passages"])

        found = texts.mapInArrow(run, f"id {id_type}, item {item_type}, score double, question_overlap double, answer_overlap double, passages long")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
