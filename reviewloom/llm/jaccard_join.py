"""N-gram Jaccard join: texts whose sets of word shingles are alike, as classes and connected components.

Texts with equal sets are one class.  Shingles are ordered rare ones first (by a sketch of their counts, then hash), and
a class is indexed under the first few of its shingles: two classes that link must share ``T`` of these.  First every
inverted list is compared with its most central class, which joins large groups of copies by a link per member.  What
then still lies in different components is searched by T-occurrence: a query's inverted lists are divided into long
and short ones, the short ones merged by a heap, the long ones probed by binary search (DivideSkip).  Classes that reach
the required overlap are compared on parity bitmaps, which bound the overlap of the whole sets from above, and those
that stay on their whole sets.  The order only moves work, never results.

Odd input: null and empty texts, and texts without words, are empty sets, linked with nothing; a text with fewer words
than a shingle is one shingle; equal rows are in one component; the smallest id of a component is taken over non-null
ids; other columns are ignored.  Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .words import U, Words, mix, rows_of, slices, small_batches, strings

CHARS_PER_SLOT = 400  # one counter of the sketch for so many characters, from 2^16 to 2^24 counters
PIECES = 16
LONG = 64  # inverted lists longer than this are probed where the overlap allows it
BAND = 1.02
CHUNK = 1024  # expected entries of a list that one search holds


def _counters(width: int, slots: int):
    """Partial sketches: how many shingles of a task's texts fall on each counter, in packed pieces.

    Counts of at most twice the task's mean are sent as zero, with the sum of all: frequent shingles stand above that in
    most tasks, and what a task sends does not grow with the number of counters.
    """
    def run(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            t = strings(b.column("text"))
            for at, end in slices(t):
                place, n = np.unique(Words(t.slice(at, end - at)).shingles(width)[0] % U(slots), return_counts=True)
                total[place.astype(np.int64)] += n
        sums = [int(x.sum()) for x in np.split(total, PIECES)]
        total[total <= 2 * total.mean()] = 0
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "counts": [packed(x) for x in np.split(total, PIECES)], "every": sums})

    return run


def packed(counts: np.ndarray) -> bytes:
    """Counts with their lowest bytes first, then the next ones, compressed: most are small."""
    return zlib.compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel().astype(np.int64)


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(1, np.int64)
    for x in group["counts"]:
        total = total + unpacked(x.as_py())
    return pa.table({"piece": group["piece"].slice(0, 1), "counts": [packed(total)], "every": [sum(group["every"].to_pylist())]})


def count_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Rank of each counter: 0 for usual ones, growing with the logarithm of the count above twice the mean."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = 1 << int(np.clip(np.ceil(np.log2(max(chars, 1) / CHARS_PER_SLOT)), 16, 24))
    kind = "piece int, counts binary, every long"
    parts = texts.mapInArrow(_counters(width, slots), kind).groupBy("piece").applyInArrow(_summed, kind).collect()
    if not parts:
        return np.zeros(slots, np.uint8)
    total = np.concatenate([unpacked(r["counts"]) for r in sorted(parts, key=lambda r: r["piece"])])
    mean = sum(r["every"] for r in parts) / slots
    return np.clip(np.floor(np.log2(np.maximum(total, 1) / (2 * mean + 16))) + 1, 0, 63).astype(np.uint8)


def distinct_shingles(texts: pa.Array, width: int, ranks: np.ndarray):
    """Distinct shingles of each text in the common order, and where each text starts; 58-bit tokens carry the rank."""
    shingles, first = Words(texts).shingles(width)
    token = (shingles >> U(6)) | (ranks[(shingles % U(len(ranks))).astype(np.int64)].astype(U) << U(58))
    row = rows_of(first)
    order = np.lexsort((shingles, token, row))
    shingles, token, row = shingles[order], token[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, token, row = shingles[new], token[new], row[new]
    return shingles, token, np.searchsorted(row, np.arange(len(texts) + 1))


def class_ids(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(shingles ^ U(0xA5A5A5A5A5A5A5A5)))))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U)).view(np.int64)


def least_of(n, percent: int):
    """The smallest size that may link with a set of size n, which is the overlap it needs too."""
    return -(-percent * n // 100)


def overlap_of(n, m, percent: int):
    """Shared shingles that two sets need."""
    return -(-percent * (n + m) // (100 + percent))


def parity_bits(shingles: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each set a bitmap of as many bits as members, rounded up to a power of two from 64 on: whether an odd number of
    members falls on a bit.  Folding a bitmap by exclusive or gives that of half as many bits."""
    n = np.diff(first)
    width = np.where(n > 0, 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 6), 0)
    head = np.concatenate(([0], np.cumsum(width)))
    row = rows_of(first)
    place = head[row] + (mix(shingles ^ U(0x3C3C3C3C3C3C3C3C)) & (width[row] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(place, minlength=head[-1]) & 1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((head // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd))])


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the members that only one of two sets has, from their bitmaps."""
    short, long = sorted((x, y), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0) ^ short).sum())


def _signatures(width: int, percent: int, ranks: np.ndarray):
    """Size, class, bitmap and indexed tokens of each text."""
    def run(batches):
        for b in batches:
            t = strings(b.column("text"))
            for at, end in slices(t):
                shingles, token, first = distinct_shingles(t.slice(at, end - at), width, ranks)
                n = np.diff(first)
                own = np.where(n > 0, n - least_of(n, percent) + 1, 0)
                head = np.concatenate(([0], np.cumsum(own)))
                pick = np.arange(head[-1]) - np.repeat(head[:-1] - first[:-1], own)
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c).slice(at, end - at) for c in ("id", "whole")), pa.array(n.astype(np.int64)), pa.array(class_ids(shingles, first)),
                    parity_bits(shingles, first), pa.ListArray.from_arrays(pa.array(head.astype(np.int32)), pa.array(token[pick].view(np.int64))),
                ], names=["id", "whole", "n", "class", "bits", "tokens"])

    return run


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    h = mix(keys.view(U))
    return np.stack([(h >> U(s)) % U(size) for s in (0, 13, 27)]).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of (class, id) pairs, at most 64 MB, as one byte per eight bits."""
    n = wanted.count()
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(n, 1))), 16, 29))

    def run(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_bits(b.column("key").to_numpy(), size).ravel()] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in wanted.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _key(ids: pa.Array, classes: np.ndarray) -> np.ndarray:
    text = ids.cast(pa.string()).fill_null("null")
    data = Words(pa.compute.replace_substring_regex(text, r"\s", "_"))
    own = np.zeros(len(ids), U)
    own[rows_of(data.first)] = data.hash
    return mix(own + classes.view(U)).view(np.int64)


def whole_sets(texts: DataFrame, pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(class, members, left, right): the sorted hashes of the sets of all classes in the pairs, read from the texts
    again; left and right tell on which side of the pairs a class is wanted.

    Rows are picked by Bloom filters on (class, id), so a few more than wanted, or one twice, may come along.
    """
    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": _key(b.column("id"), b.column("class").to_numpy())})

    def wanted(side: str) -> np.ndarray:
        nodes = pairs.select(F.col(side).alias("class")).distinct().join(classes, "class")
        return _filter(nodes.select("id", "class").mapInArrow(keys, "key long"))

    filters, none = (wanted("a"), wanted("b")), np.zeros(1, np.uint8)

    def run(batches):
        for b in batches:
            t = strings(b.column("text"))
            for at, end in slices(t):
                shingles, _, first = distinct_shingles(t.slice(at, end - at), width, none)
                classes = class_ids(shingles, first)
                keys = _key(b.column("id").slice(at, end - at), classes)
                sides = []
                for bits in filters:
                    place = _bits(keys, 8 * len(bits))
                    sides.append(((bits[place >> 3] >> (7 - (place & 7))) & 1).all(0) & (np.diff(first) > 0))
                hit = np.flatnonzero(sides[0] | sides[1])
                if len(hit):
                    yield pa.RecordBatch.from_pydict({
                        "class": classes[hit], "members": [np.sort(shingles[first[i]:first[i + 1]]).tobytes() for i in hit],
                        "left": sides[0][hit], "right": sides[1][hit]})

    return written(texts.mapInArrow(run, "class long, members binary, left boolean, right boolean"), "sets")


def possible(pairs: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that the bitmaps of their sets do not rule out; no link is lost."""
    def run(batches):
        for b in batches:
            keep = []
            for both, x, y in zip(b.column("both").to_pylist(), b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append((both - apart(x, y)) * (100 + percent) >= 2 * percent * both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = every.where("n > 0").select("class", "n", "bits").dropDuplicates(["class"])
    left = pairs.join(own.select(F.col("class").alias("a"), F.col("n").alias("_n"), F.col("bits").alias("x")), "a")
    both = left.join(own.select(F.col("class").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("y")), "b")
    with small_batches(pairs.sparkSession):
        return written(both.select("a", "b", (F.col("_n") + F.col("_m")).alias("both"), "x", "y").mapInArrow(run, "a long, b long"), "pairs")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole sets are alike enough."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both * (100 + percent) >= percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.where("left").select(F.col("class").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.where("right").select(F.col("class").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    with small_batches(pairs.sparkSession):
        return written(both.mapInArrow(run, "a long, b long").distinct(), "linked")


def divide_skip(lists: list[np.ndarray], least: int) -> dict[int, int]:
    """Members that occur in at least ``least`` of the sorted lists, with their counts.

    Of the lists longer than LONG up to ``least`` - 1 are left out of the merge and probed by binary search.
    """
    lists = sorted(lists, key=len, reverse=True)
    skip = 0
    while skip < min(least - 1, len(lists)) and len(lists[skip]) > LONG:
        skip += 1
    found = {}
    for member, run in groupby(heapq.merge(*[x.tolist() for x in lists[skip:]])):
        count = sum(1 for _ in run)
        if count < least - skip:
            continue
        for k, long in enumerate(lists[:skip]):
            at = bisect_left(long, member)
            count += at < len(long) and long[at] == member
            if count + skip - k - 1 < least:
                break
        if count >= least:
            found[member] = count
    return found


def _band(n):
    """Number of the size band, each about a fiftieth wide."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND)))


def _need_in_band(n, band, percent: int):
    """A lower bound of the indexed shingles that a set of size n shares with one that it links with in the band."""
    def need(m):
        return F.ceil(percent * (n + m) / (100 + percent)) - F.ceil(percent * F.greatest(n, m) / 100)

    low = F.greatest(F.floor(F.pow(F.lit(BAND), band)) - 1, F.ceil(percent * n / 100))
    high = F.least(F.ceil(F.pow(F.lit(BAND), band + 1)) + 1, F.floor(100 * n / percent))
    return F.least(need(low), need(high))


def _search(percent: int):
    """Candidates of each query: rows of one query, band and chunk follow each other, a row per inverted list."""
    def candidates(own: pa.Table):
        query, n, members, label = (own[c][0].as_py() for c in ("query", "n", "members", "label"))
        lists, size = [], {}
        for row in range(len(own)):
            c, m, k, l = (own[x][row].values.to_numpy().astype(np.int64) for x in ("classes", "sizes", "ranks", "labels"))
            fit = ((k > members) | ((k == members) & (l > label))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if fit.any():
                size.update(zip(c[fit].tolist(), m[fit].tolist()))
                lists.append(np.sort(c[fit]))
        if not lists:
            return []
        # both sets hold the same shingles up to the end of the shorter index part; what lies behind it is bounded
        need = {m: overlap_of(n, m, percent) - least_of(max(n, m), percent) + 1 for m in set(size.values())}
        found = divide_skip(lists, max(1, min(need.values())))
        return [(query, y) for y, count in found.items() if count >= need[size[y]]]

    def run(batches):
        def groups():
            held, key = [], None
            for b in batches:
                t = pa.Table.from_batches([b])
                keys = list(zip(*(t[c].to_pylist() for c in ("query", "band", "chunk"))))
                at = 0
                for k, rows in groupby(keys):
                    size = sum(1 for _ in rows)
                    if held and k != key:
                        yield pa.concat_tables(held)
                        held = []
                    key = k
                    held.append(t.slice(at, size))
                    at += size
            if held:
                yield pa.concat_tables(held)

        out = []
        for g in groups():
            out += candidates(g)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]})
                out = []
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, class, component, component_id (the smallest id of the component), class_size
    and whole (a hash of the text).  Class and component are null for empty sets.

    Documents link when 100 * shared shingles >= ``percent`` * shingles of either.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("whole"))
    ranks = count_sketch(texts, width)
    every = written(texts.mapInArrow(_signatures(width, percent, ranks), f"id {id_type}, whole long, n long, class long, bits binary, tokens array<bigint>"), "signatures")
    classes = every.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    # the second condition on n always holds: with it both uses of the classes share one shuffle
    own = every.where("n > 0").select("class", "n", "tokens").dropDuplicates(["class"]).where("n > 0")
    postings = own.select("class", "n", F.explode("tokens").alias("token"))
    several = postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1").select("token")
    shared = written(postings.join(several, "token"), "postings")

    # every list against its most central class: the one with the largest share of its index in lists
    size = F.first("n")
    share = shared.groupBy("class").agg((F.count("*") / (size - F.ceil(percent * size / 100) + 1)).alias("share"))
    central = F.struct(F.col("share"), F.col("class"), F.col("n"))
    pivots = shared.join(share, "class").groupBy("token").agg(F.max(central).alias("pivot"))
    n, m = F.col("n"), F.col("pivot.n")
    need = F.ceil(percent * (n + m) / (100 + percent)) - F.ceil(percent * F.greatest(n, m) / 100) + 1
    stars = shared.join(pivots, "token").where((F.col("class") != F.col("pivot.class")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)))
    stars = stars.groupBy(F.col("class").alias("a"), F.col("pivot.class").alias("b")).agg(F.count("*").alias("shared"), F.first(need).alias("need"))
    stars = possible(stars.where("shared >= need").select("a", "b"), every, percent)

    links = linked(stars, whole_sets(texts, stars, classes, width), percent)
    labels = components(links)

    # what is left: lists that hold several components; the smaller component asks the larger one
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    labels = written(labels.join(sizes, "label").select(F.col("node").alias("class"), "label", "members"), "labels")
    held = shared.join(labels, "class", "left").select(
        "token", "class", "n", F.struct(F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("label", "class").alias("label")).alias("rank"))
    mixed = held.groupBy("token").agg(F.min("rank.label").alias("low"), F.max("rank.label").alias("high"), F.max("rank").alias("top")).where("low != high")
    held = written(held.join(mixed.select("token", "top"), "token").withColumn("band", _band(F.col("n"))), "mixed")
    presence = held.groupBy("token", "band").agg(F.count("*").alias("length"))
    longest = presence.agg(F.max("length")).first()[0] or 0
    queries = held.where(F.col("rank") < F.col("top")).select("token", F.col("class").alias("query"), "n", "rank.members", "rank.label")
    # a band of sizes is only searched where enough of the query's lists reach into it
    low, high = _band(F.ceil(percent * F.col("n") / 100)), _band(F.floor(100 * F.col("n") / percent))
    asks = queries.join(presence.select("token", "band"), "token").where(F.col("band").between(low, high))
    enough = asks.groupBy("query", "band", "n").agg(F.count("*").alias("lists")).where(F.col("lists") >= _need_in_band(F.col("n"), F.col("band"), percent))
    asks = asks.join(enough.select("query", "band"), ["query", "band"], "left_semi")
    chunk = F.pmod(F.xxhash64("class"), F.lit(-(-longest // CHUNK) or 1))
    # rows are dealt once, as the join with the queries wants the lists; they are put together behind that shuffle
    dealt = held.select("token", "band", "class", F.col("n").cast("int").alias("n"), F.col("rank.members").cast("int").alias("members"), "rank.label").repartition("token", "band")
    lists = dealt.groupBy("token", "band", chunk.alias("chunk")).agg(F.collect_list(F.struct("class", "n", "members", "label")).alias("entries"))
    # an array a field: half the bytes of an array of rows, and these are sent to each query
    fields = {"classes": ("class", "bigint"), "sizes": ("n", "int"), "ranks": ("members", "int"), "labels": ("label", "bigint")}
    lists = lists.select("token", "band", "chunk", *[F.col("entries")[f].cast(f"array<{kind}>").alias(name) for name, (f, kind) in fields.items()])
    asked = asks.join(lists, ["token", "band"]).drop("token").repartition("query", "band", "chunk").sortWithinPartitions("query", "band", "chunk")
    with small_batches(docs.sparkSession):
        rest = possible(asked.mapInArrow(_search(percent), "a long, b long"), every, percent)
    more = linked(rest, whole_sets(texts, rest, classes, width), percent)

    labels = components(links.unionByName(more))
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "label").select("class", F.col("label").alias("component"), "component_id", F.col("size").alias("class_size"))
    none = F.lit(None).cast("long")
    full = every.where("n > 0").select("id", "whole", "n", "class").join(named, "class", "left")
    empty = every.where("n = 0").select(
        "id", "whole", "n", none.alias("class"), none.alias("component"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return full.unionByName(empty).select("id", "n", "class", "component", "component_id", "class_size", "whole").withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component one row of the smallest id stays, with all its columns.

    Null ids count as the largest, equal ids go by a hash of the text; texts without words all stay.
    """
    found = similar_components(docs, id_col, text_col, width, percent).select(F.col(id_col).alias("_id"), F.col("whole").alias("_whole"), "component")
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_whole")).alias("b"))
    chosen = best.select("b._id", "b._whole")
    # the row rides along as one column, so that its columns can be called anything
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("own", F.xxhash64(F.coalesce("text", F.lit(""))))
    wordless = F.col("text").isNull() | F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    stay = keyed.where(~wordless).join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_whole")), "left_semi").dropDuplicates(["id", "own"])
    return stay.unionByName(keyed.where(wordless)).select("row.*")
