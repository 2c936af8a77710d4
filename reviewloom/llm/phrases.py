"""Phrase collocations, counted by double-array tries that tasks hold beside their texts.

Phrases of up to ``longest`` words are counted within the pieces of a text, per language.  Three kinds of passes:

1. Words are counted; those of ``least`` occurrences are frequent.
2. Level by level, a phrase is a candidate where its two parts of one word less are (Apriori), and where a hashed
   counter of its occurrences reaches ``least``.  The counters prune only; each pass counts the next level's while it
   lists the candidates of the level before.
3. Candidates of all levels are dealt by their first two words to shards of at most ``SHARD`` phrases on average.  A task
   per shard builds its trie.  One more pass reads the texts; the first two words of a position name its trie, so each
   position is looked up once however many tries there are, and a task holds one trie at a time beside some millions of
   words.  numpy takes the states of all positions one level further at a time; the counts of the tasks are summed.

What frequent words and counters let through is kept as a bitmap of at most 8 MB; when it fills up it only lets more
through, and joins on the exact sets follow.  Words of the trie are spelt in two digits, which keeps sets of children
narrow.  Words and phrases are told apart by 64-bit hashes of their bytes and language; scores are exact decimals.

Odd input: null and empty texts have no words; a null language is ``und``; repeated rows count each time; ties are
broken as the ranking says; texts of any length are read whole (a batch is one text at least); an empty table gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .words import U, Words, joined, mix, raw, slices, strings

SHARD = 1_000_000  # phrases a trie holds at most on average
FLUSH = 1_500_000  # entries a task gathers before it hands them on
HELD = 4_000_000  # words a task gathers before it looks them up
BLOCK_BITS = 14  # of states whose counts travel together
MOST_BITS = 26
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class PieceWords(Words):
    """The words of some rows with hashes per language, and whether the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, off = raw(texts)
        gap = _GAP[data]
        edge = np.ones(len(data) + 1, bool)  # a word may start here
        edge[1:] = np.concatenate((gap, [True]))[:-1] if len(data) else True
        edge[off] = True
        inside = ~gap
        self.start = np.flatnonzero(inside & edge[:-1])
        edge = np.zeros(len(data) + 1, bool)  # a word may end here
        edge[off] = True
        edge[:-1] |= gap
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        self.data = _LOWER[data]
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        names = langs.dictionary_encode()
        self.langs = names.dictionary
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.lang = names.indices.to_numpy(zero_copy_only=False)[self.row] if len(self.row) else np.zeros(0, np.int64)
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], U)
        self.hash = joined(seeds[self.lang], self._hashes()) if len(self.row) else np.zeros(0, U)
        at = breaks[self.start] if len(self.row) else np.zeros(0, np.int64)
        self.joins = np.zeros(len(self.start), bool)
        if len(at) > 1:
            self.joins[:-1] = (at[1:] == at[:-1]) & (self.row[1:] == self.row[:-1])

    def spelt(self, which: np.ndarray) -> pa.Array:
        """The words at these places as strings."""
        size = (self.end - self.start)[which]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[which] - (ends - size), size)
        off = np.concatenate(([0], ends)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(self.data[at]))])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[PieceWords]:
    """The words of (lang, text) batches, a slice at a time."""
    for batch in parts:
        texts, langs = strings(batch.column(1)), batch.column(0).fill_null("und")
        for lo, hi in slices(texts, 1 << 21):
            yield PieceWords(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, h, n) of all words."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {"h": [], "n": [], "lang": [], "word": []}

        def gathered() -> pa.RecordBatch:
            key, first, back = np.unique(np.concatenate(seen["h"]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(seen["n"]), len(key)).astype(np.int64)
            lang, word = (pa.chunked_array(seen[c]).take(pa.array(first)).combine_chunks() for c in ("lang", "word"))
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), word, pa.array(_signed(key)), pa.array(n)], names=["lang", "word", "h", "n"])

        size = 0
        for words in _batches(parts):
            key, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            seen["h"].append(key), seen["n"].append(n)
            seen["lang"].append(words.langs.take(pa.array(words.lang[first])).cast(pa.string()))
            seen["word"].append(words.spelt(first))
            size += len(key)
            if size > FLUSH:
                yield gathered()
                seen, size = {c: [] for c in seen}, 0
        if size:
            yield gathered()

    spread = texts.mapInArrow(count, "lang string, word string, h long, n long")
    return spread.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _bits_for(rows: int) -> int:
    return min(MOST_BITS, max(16, math.ceil(math.log2(rows + 1)) + 5))


def sieve(keys: DataFrame, col: str) -> np.ndarray:
    """A bitmap of the low bits of the keys, some 32 bits a key and at most 2^MOST_BITS; built by an aggregation."""
    bits = _bits_for(keys.count())
    at = F.col(col).bitwiseAND((1 << bits) - 1)
    marks = keys.select(F.shiftright(at, 6).alias("block"), F.expr(f"shiftleft(1L, cast(({col} & 63) as int))").alias("bit"))
    blocks = marks.groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, U)
    out[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy().view(U)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if bits <= 20 else out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sieve lets through."""
    if bitmap.dtype == bool:
        return bitmap[(keys & U(len(bitmap) - 1)).astype(np.int64)]
    at = keys & U(64 * len(bitmap) - 1)
    return (bitmap[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def _phrase_hashes(words: PieceWords, size: int) -> np.ndarray:
    """Hash of the phrase of ``size`` words from each position (of no meaning where the piece ends before)."""
    h = words.hash
    for k in range(1, size):
        h = h.copy()
        if len(h) > k:
            h[:-k] = joined(h[:-k], words.hash[k:])
    return h


def _possible(words: PieceWords, sieves: list[np.ndarray]) -> list[np.ndarray]:
    """Per level from 1, whether the phrase from each position passes the sieves of its level and of all within it."""
    out = [passes(sieves[0], words.hash)]
    for size in range(2, len(sieves) + 1):
        both = out[-1] & words.joins
        both[:-1] &= out[-1][1:]
        at = np.flatnonzero(both)
        if len(at):
            both[at] = passes(sieves[size - 1], _counter(_phrase_hashes(words, size)[at]))
        out.append(both)
    return out


def _counter(h: np.ndarray) -> np.ndarray:
    """The counter of a phrase: 32 bits of its hash."""
    return mix(h) >> U(32)


def level(texts: DataFrame, sieves, size: int, last: bool) -> DataFrame:
    """One pass: candidates of ``size`` words (``words`` and their ``counter``) and, unless ``last``, counters of one word more with ``n``.

    ``sieves`` is a broadcast list for the levels up to ``size``.  Rows are dealt once, by counter.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def candidates() -> pa.RecordBatch:
            rows = np.concatenate(phrases)
            rows = rows[np.unique(joined_rows(rows), return_index=True)[1]]
            off = np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(_signed(rows.ravel())))
            counter = pa.array(_signed(_counter(joined_rows(rows))))
            return pa.RecordBatch.from_arrays([lists, counter, pa.nulls(len(rows), pa.int64())], names=["words", "counter", "n"])

        def counters() -> pa.RecordBatch:
            key, n = _summed(keys, counts)
            lists = pa.nulls(len(key), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([lists, pa.array(_signed(key)), pa.array(n)], names=["words", "counter", "n"])

        for words in _batches(parts):
            ok = _possible(words, sieves.value)[size - 1]
            if size > 1:
                at = np.flatnonzero(ok)
                rows = np.stack([words.hash[at + k] for k in range(size)], 1)
                phrases.append(rows[np.unique(joined_rows(rows), return_index=True)[1]])
                if sum(map(len, phrases)) > FLUSH:
                    yield candidates()
                    phrases.clear()
            if not last:
                both = ok & words.joins
                both[:-1] &= ok[1:]
                key, n = np.unique(_counter(_phrase_hashes(words, size + 1)[both]), return_counts=True)
                keys.append(key), counts.append(n)
                if sum(map(len, keys)) > FLUSH:
                    yield counters()
                    keys.clear(), counts.clear()
        if phrases:
            yield candidates()
        if keys:
            yield counters()

    rows = texts.mapInArrow(run, "words array<long>, counter long, n long")
    return rows.repartition("counter").groupBy("counter", "words").agg(F.sum("n").alias("n"))


def joined_rows(rows: np.ndarray) -> np.ndarray:
    """One hash a row of word hashes, equal to that of the phrase in a text."""
    h = rows[:, 0]
    for k in range(1, rows.shape[1]):
        h = joined(h, rows[:, k])
    return h


def _longer(a: np.ndarray, fill: int) -> np.ndarray:
    return np.concatenate((a, np.full(len(a), fill, a.dtype)))


class Trie:
    """A double array over phrases of words; a word is two digits of its rank among the words of the phrases.

    State s goes to t = base[s] + digit where check[t] = s.  State 0 is the root, 1 the dead state.
    """

    def __init__(self, words: np.ndarray, digit: int, base: np.ndarray, check: np.ndarray):
        self.words, self.digit, self.base, self.check = words, digit, base, check

    @classmethod
    def build(cls, phrases: np.ndarray) -> tuple[Trie, np.ndarray]:
        """The trie of distinct rows of word hashes (0: no word) and the accepting state of each row."""
        words = np.unique(phrases[phrases != 0])
        digit = max(1, (max(1, len(words) - 1).bit_length() + 1) // 2)
        rank = np.searchsorted(words, phrases)
        width = 1 << digit
        steps = np.stack([rank >> digit, rank & width - 1], 2).reshape(len(phrases), -1)  # two digits a word
        used = np.repeat(phrases != 0, 2, axis=1)
        room = 2 * len(phrases) * steps.shape[1] + 4 * width + 4
        base, check = np.full(room, 2, np.int64), np.full(room, -1, np.int64)
        check[:2] = -2
        free = 2  # the search for places starts here
        state = np.zeros(len(phrases), np.int64)
        for depth in range(steps.shape[1]):
            at = np.flatnonzero(used[:, depth])
            edge, back = np.unique(state[at] * width + steps[at, depth], return_inverse=True)
            node, char = edge // width, edge % width
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(node)])))
            target = np.empty(len(edge), np.int64)
            for j in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())]:
                mine = char[starts[j]:starts[j] + sizes[j]]
                low, tried = free, 0
                while True:  # the first free places for all children, 64 tries at a time
                    if low + 256 + 2 * width > len(check):
                        base, check = _longer(base, 2), _longer(check, -1)
                    places = low + np.flatnonzero(check[low:low + 256] == -1)[:64]
                    places = places[places - mine[0] >= 2]
                    fits = (check[(places - mine[0])[:, None] + mine[None, :]] == -1).all(1)
                    if fits.any():
                        b = places[fits.argmax()] - mine[0]
                        break
                    low, tried = low + 256, tried + 1
                    if tried > 16:  # places this crowded are left to single children
                        free = low
                base[node[starts[j]]] = b
                check[b + mine] = node[starts[j]]
                target[starts[j]:starts[j] + sizes[j]] = b + mine
            single = starts[sizes == 1]  # a single child takes any free place that is far enough on
            while int((check[2 + width:] == -1).sum()) < len(single):
                base, check = _longer(base, 2), _longer(check, -1)
            places = 2 + width + np.flatnonzero(check[2 + width:] == -1)[:len(single)]
            base[node[single]] = places - char[single]
            check[places] = node[single]
            target[single] = places
            state[at] = target[back]
        top = int(np.flatnonzero(check != -1).max()) + width + 2
        return cls(words, digit, base[:top].astype(np.int32), check[:top].astype(np.int32)), state

    def spell(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for words in no phrase."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        rank = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[rank] == hashes, rank, -1)

    def step(self, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """All states one word further; 1 where there is no such child."""
        for part in (rank >> self.digit, rank & (1 << self.digit) - 1):
            there = self.base[state] + part
            state = np.where(self.check[there] == state, there, 1)
        return state

    def packed(self) -> list[bytes]:
        return [self.words.tobytes(), self.digit.to_bytes(8, "little"), self.base.tobytes(), self.check.tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Trie:
        words, digit, base, check = parts
        return cls(np.frombuffer(words, U), int.from_bytes(digit, "little"), np.frombuffer(base, np.int32), np.frombuffer(check, np.int32))


BUILT = "shard int, trie array<binary>, state long, words array<long>"


def build_tries(candidates: DataFrame, longest: int) -> DataFrame:
    """Per shard of (shard, words) rows one row with its trie, and a row for each phrase with its accepting state."""

    def build(table: pa.Table) -> pa.Table:
        lists = table.column("words").combine_chunks()
        off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy().view(U)
        size = np.diff(off)
        rows = np.zeros((len(size), longest), U)
        for k in range(longest):
            has = size > k
            rows[has, k] = flat[off[:-1][has] + k]
        order = np.lexsort(rows.T[::-1])  # the same trie if a task is run again
        trie, state = Trie.build(rows[order])
        n = len(rows)
        shard = pa.array(np.full(n + 1, table.column("shard")[0].as_py(), np.int32))
        tries = pa.array([trie.packed()] + [None] * n, pa.list_(pa.binary()))
        words = pa.concat_arrays([pa.nulls(1, lists.type), lists.take(pa.array(order))])
        return pa.table([shard, tries, pa.array(np.concatenate(([-1], state))), words.cast(pa.list_(pa.int64()))], names=["shard", "trie", "state", "words"])

    return candidates.groupBy("shard").applyInArrow(build, BUILT)


def _pair(words: np.ndarray) -> np.ndarray:
    """What decides a phrase's shard: the counter of its first two words."""
    return _counter(joined(words[:, 0], words[:, 1]))


def dealt(found: DataFrame, shards: int) -> DataFrame:
    """(shard, words) of phrases (words): all phrases that begin with the same two words are in one shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lists = batch.column("words")
            flat, at = lists.values.to_numpy().view(U), lists.offsets.to_numpy()[:-1]
            shard = (_pair(np.stack((flat[at], flat[at + 1]), 1)) % U(shards)).astype(np.int32) if len(at) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), lists.cast(pa.list_(pa.int64()))], names=["shard", "words"])

    return found.select("words").mapInArrow(run, "shard int, words array<long>")


def count_states(texts: DataFrame, tries: dict, sieves, longest: int, shards: int) -> DataFrame:
    """(shard, state, n): how often each state is reached at the end of a word after the first, from one pass over the texts.

    ``tries`` holds a broadcast per shard, ``sieves`` is a broadcast list for the levels 1 and 2.  The first two words of a
    position name the one trie that it is looked up in, so the work does not grow with the number of shards; a task
    gathers ``HELD`` words and takes one trie after the other for them.  Counts travel as lists, one for a block of states.
    """

    def count(h: np.ndarray, joins: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = passes(sieves.value[0], h)
        at = np.flatnonzero(ok[:-1] & joins[:-1] & ok[1:])
        pair = _pair(np.stack((h[at], h[at + 1]), 1))
        some = passes(sieves.value[1], pair)
        at, shard = at[some], (pair[some] % U(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for own, broadcast in tries.items():
            p = at[order[ends[own]:ends[own + 1]]]
            if not len(p):
                continue
            trie = Trie.unpacked(broadcast.value)
            state, reached = np.zeros(len(p), np.int64), []
            for k in range(longest):  # every position's state one word further, the dead ones left behind
                if k:
                    on = joins[p + k - 1]
                    p, state = p[on], state[on]
                rank = trie.spell(h[p + k])
                on = rank >= 0
                p, state = p[on], trie.step(state[on], rank[on])
                p, state = p[state != 1], state[state != 1]
                if k:
                    reached.append(state)
            state, n = np.unique(np.concatenate(reached), return_counts=True)
            if hasattr(broadcast, "_value"):  # a task holds one trie at a time
                del broadcast._value, trie
            block, first = np.unique(state >> BLOCK_BITS, return_index=True)
            off = pa.array(np.append(first, len(state)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (state.astype(np.int32), n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), own, np.int32)), pa.array(block), *lists], names=["shard", "block", "states", "counts"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for words in _batches(parts):
            held.append((words.hash, words.joins))
            if sum(len(h) for h, _ in held) > HELD:
                yield from count(*map(np.concatenate, zip(*held)))
                held.clear()
        if held:
            yield from count(*map(np.concatenate, zip(*held)))

    def summed(table: pa.Table) -> pa.Table:
        low = table.column("block")[0].as_py() << BLOCK_BITS
        at, n = (np.concatenate([x.flatten().to_numpy() for x in table.column(c).chunks]) for c in ("states", "counts"))
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        np.add.at(total, at - low, n)
        some = np.flatnonzero(total)
        shard = pa.array(np.full(len(some), table.column("shard")[0].as_py(), np.int32))
        return pa.table([shard, pa.array(some + low), pa.array(total[some])], names=["shard", "state", "n"])

    packed = texts.mapInArrow(run, "shard int, block long, states array<int>, counts array<long>")
    return packed.groupBy("shard", "block").applyInArrow(summed, "shard int, state long, n long")


def phrase_counts(texts: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """(words, n) of all phrases of 2 to ``longest`` words that occur ``least`` times, as arrays of the hashes of ``words``."""
    context = texts.sparkSession.sparkContext
    sieves, found, full = [sieve(words, "h")], None, None
    for size in range(1, longest + 1):
        step = level(texts, context.broadcast(sieves), size, size == longest)
        step = written(step.where(F.col("words").isNotNull() | (F.col("n") >= least)), "level")
        if size > 1:  # a bitmap may let too much through; the counters themselves decide
            rows = step.where("words IS NOT NULL").join(full, "counter", "left_semi").select("words")
            found = rows if found is None else found.unionByName(rows)
        if size < longest:
            full = step.where("words IS NULL").select("counter")
            sieves = [*sieves, sieve(full, "counter")]
    if found is None:
        return words.select(F.array("h").alias("words"), "n").limit(0)
    found = written(found, "candidates")
    shards = max(1, math.ceil(found.count() / SHARD))
    built = written(build_tries(dealt(found, shards), longest), "tries")
    tries = {}
    for shard in range(shards):
        row = built.where((F.col("shard") == shard) & F.col("trie").isNotNull()).select("trie").first()
        if row is not None:
            tries[shard] = context.broadcast([bytes(x) for x in row.trie])
    if not tries:
        return found.select("words", F.lit(0).cast("long").alias("n")).limit(0)
    counts = count_states(texts, tries, context.broadcast(sieves[:2]), longest, shards).where(F.col("n") >= least)
    counted = written(built.where(F.col("words").isNotNull()).join(counts, ["shard", "state"]).select("words", "n"), "phrases")
    for trie in tries.values():
        trie.destroy()
    return counted


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """words, a, l, r, score of phrases (words, n): the cut of the lowest score, the earliest of several."""
    known = counts.unionByName(words.select(F.array("h").alias("words"), "n"))
    cuts = counts.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, F.size("words")))
    cuts = cuts.join(known.select(F.col("words").alias("part"), F.col("n").alias("l")), "part")
    cuts = cuts.join(known.select(F.col("words").alias("rest"), F.col("n").alias("r")), "rest")

    def exact(c: str):
        return F.col(c).cast("decimal(18,0)")

    cuts = cuts.withColumns({"above": exact("a") * exact("a") * F.lit(1_000_000), "below": exact("l") * exact("r")})
    cuts = cuts.select("words", "a", F.struct(F.expr("above div below").alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("words", "a").agg(F.min("cut").alias("cut")).select("words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """Without phrases that lie in a longer one of at least ``percent`` of their occurrences; longer ones count, gone or not."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("words", at, n))))
    inside = phrases.where(size > 2).select(F.explode(inner).alias("inner"), F.col("a").alias("longer")).groupBy("inner").agg(F.max("longer").alias("longer"))
    both = phrases.join(inside, phrases["words"] == inside["inner"], "left")
    return both.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("inner", "longer")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    rows = uncovered(written(scored(written(phrase_counts(texts, frequent, longest, least), "counts"), frequent), "scored"), covered)
    spelt = rows.select("words", "a", "l", "r", "score", F.posexplode("words").alias("at", "h")).join(frequent.select("h", "lang", "word"), "h")
    spelt = spelt.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    spelt = spelt.select("lang", F.array_join(F.transform("spelt", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
