"""All text features of a review in one pass: lengths, tags, emotions, valence, vocabulary and topics.

A merged dictionary that tasks can hold is looked up row by row: texts reach Python whole, are cut into tokens as byte
ranges and counted in numpy, and nothing is shuffled.  With a larger one the tokens of all fields of a review are exploded
together and joined to it once; sums per review, field and feature combine in the scan's task, so a single row per review
is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed_values import EMOTIONS, TOPIC_CATEGORIES
from ..functions.strings import WS_CHARS, letter_words, word_count, words
from .align import quoted
from .bounds import SETTLED_ROWS, rows_if_small, settle


def merged_dictionary(tags: DataFrame, emotions: DataFrame, topics: DataFrame, valences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per token: what it counts as, with weights.

    Inputs are (token, tag), (token, category), (token, topic), (token, valence) and (token).  Vocabulary holds
    white-space tokens, all others letter runs, so the kind is part of the key.
    """
    def rows(df: DataFrame, kind: str, label: Column, weight: Column) -> DataFrame:
        return df.where(F.col("token").isNotNull()).select(
            F.lit(kind).alias("_kind"), F.col("token").alias("_t"), label.alias("label"), weight.cast("double").alias("weight"))

    one = F.lit(1)
    every = rows(tags, "letters", F.concat(F.lit("tag_"), "tag"), one)
    for more in (
        rows(emotions, "letters", F.concat(F.lit("emotion_"), "category"), one), rows(topics, "letters", F.concat(F.lit("topic_"), "topic"), one),
        rows(valences, "letters", F.lit("valence"), F.col("valence")), rows(vocabulary, "words", F.lit("known"), one),
    ):
        every = every.unionByName(more)
    weight = F.when(F.col("label") == "valence", F.sum("weight")).otherwise(F.max("weight"))
    every = every.groupBy("_kind", "_t", "label").agg(weight.alias("weight"))
    return settle(every.groupBy("_kind", "_t").agg(F.collect_list(F.struct("label", "weight")).alias("_labels")), "merged-dictionary")


def review_features(df: DataFrame, key: str, dictionary: DataFrame, tags: list[str], summary: str = "summary", pros: str = "pros", cons: str = "cons") -> DataFrame:
    """``key`` and the text features in signature order; ``key`` is unique, null texts count as empty.

    Lengths and tag densities for all three texts; emotions, valence, vocabulary and topics for the two long ones.
    Emotions are shares of all emotion hits, topics and tags shares of the letter tokens, vocabulary a share of the
    white-space tokens; a tag that does not occur is null.
    """
    entries = rows_if_small(dictionary, SETTLED_ROWS)
    if entries is not None:
        texts = df.select(quoted(key).alias(key), *[quoted(c).alias(f"_{n}") for n, c in zip(FIELDS, (summary, pros, cons))])
        return _looked_up(texts, entries, tags, [f"_{n}" for n in FIELDS]).drop(*[f"_{n}" for n in FIELDS])
    fields = {"summary": summary, "pros": pros, "cons": cons}
    tokens = F.concat(*[
        F.transform(split(quoted(column)), _token(name, kind))
        for name, column in fields.items() for kind, split in (("letters", letter_words), ("words", lambda c: words(F.lower(c))))
    ])
    lengths = [c.alias(n) for name, column in fields.items() for n, c in (
        (f"{name}_charlen", F.length(F.coalesce(quoted(column), F.lit("")))), (f"{name}_wordlen", word_count(quoted(column))))]
    length_names = [f"{name}_{kind}" for name in fields for kind in ("charlen", "wordlen")]
    # lengths and tokens are made before the rows are exploded, once per review
    rows = df.select(quoted(key).alias("_key"), F.struct(*lengths).alias("_lengths"), tokens.alias("_tokens"))
    rows = rows.select("_key", "_lengths", F.explode_outer("_tokens").alias("_x"))
    rows = rows.select("_key", "_lengths", "_x.field", "_x._kind", "_x._t").join(dictionary, ["_kind", "_t"], "left")
    own = F.struct(F.coalesce("_kind", F.lit("none")).alias("label"), F.lit(1.0).alias("weight"))
    counted = rows.select("_key", "_lengths", "field", F.explode(F.concat(F.array(own), F.coalesce("_labels", F.array().cast("array<struct<label:string,weight:double>>")))).alias("_c"))
    name = F.concat_ws("_", "field", "_c.label")
    sums = counted.groupBy("_key", name.alias("_name")).agg(F.sum("_c.weight").alias("_n"), F.first("_lengths").alias("_lengths"))
    summed = sums.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_n"))).alias("_sums"), F.first("_lengths").alias("_lengths"))

    def total(label: str) -> Column:
        return F.coalesce(F.col("_sums")[label], F.lit(0.0))

    features = _features(total, tags)
    return summed.select(F.col("_key").alias(key), *[F.col(f"_lengths.{n}").alias(n) for n in length_names], *[c.alias(n) for n, c in features.items()])


FIELDS, LONG = ("summary", "pros", "cons"), ("pros", "cons")


def _features(total: Callable[[str], Column], tags: list[str]) -> dict[str, Column]:
    """The features in signature order, from sums by ``<field>_<label>``."""
    features = {}
    for name in FIELDS:
        letters = F.greatest(total(f"{name}_letters"), F.lit(1.0))
        for t in tags:
            features[f"{name}_ld_{t}"] = F.nullif(total(f"{name}_tag_{t}"), F.lit(0.0)) / letters
    for name in LONG:
        hits = F.aggregate(F.array(*[total(f"{name}_emotion_{label}") for label in EMOTIONS.values()]), F.lit(0.0), lambda a, x: a + x)
        for short, label in EMOTIONS.items():
            features[f"{name}_emolex_{short}"] = F.coalesce(total(f"{name}_emotion_{label}") / F.nullif(hits, F.lit(0.0)), F.lit(0.0))
    for name in LONG:
        v = total(f"{name}_valence")
        features[f"{name}_nltk_sia"] = v / F.sqrt(v * v + 15.0)
    for name in LONG:
        features[f"ODI_related_vocab_{name}"] = total(f"{name}_known") / F.greatest(total(f"{name}_words"), F.lit(1.0))
    for name in LONG:
        letters = F.greatest(total(f"{name}_letters"), F.lit(1.0))
        for topic in TOPIC_CATEGORIES:
            features[f"{name}_empath_{topic}"] = total(f"{name}_topic_{topic}") / letters
    return features


def row_features(df: DataFrame, dictionary: DataFrame, tags: list[str], summary: str = "summary", pros: str = "pros", cons: str = "cons") -> DataFrame:
    """The rows with the features of :func:`review_features` behind their columns, each from its own row alone.

    Works on a stream in append mode as on a table: no join, no aggregate.  Tasks hold the dictionary, whose size is
    checked; a larger one is an error here and a join in ``review_features``.
    """
    entries = rows_if_small(dictionary, SETTLED_ROWS)
    if entries is None:
        raise ValueError(f"a dictionary of more than {SETTLED_ROWS} tokens is too large to be held by every task")
    return _looked_up(df, entries, tags, [summary, pros, cons])


def _looked_up(df: DataFrame, entries: list, tags: list[str], columns: list[str]) -> DataFrame:
    """The rows with their features, by dictionary entries that go to every task."""
    kinds = ("letters", "words")
    labels = sorted({x["label"] for e in entries for x in e["_labels"]})
    tables = {}
    for kind in kinds:  # tokens, where their labels begin, labels, weights
        own = [e for e in entries if e["_kind"] == kind]
        tables[kind] = (
            pa.array([e["_t"] for e in own], pa.string()), np.cumsum([0, *[len(e["_labels"]) for e in own]]),
            np.array([labels.index(x["label"]) for e in own for x in e["_labels"]], np.int64),
            np.array([x["weight"] for e in own for x in e["_labels"]], float))
    names = [*kinds, *labels]
    place = {f"{f}_{n}": i for i, (f, n) in enumerate((f, n) for f in FIELDS for n in names)}
    held = (tables, {"letters": np.packbits(_letters(df.sparkSession)), "words": np.packbits(_no_space())})
    shared = df.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("array<double>")
    def sums(texts: pa.Array) -> pa.Array:
        tables, packed = shared.value
        classes = {k: np.unpackbits(v).astype(bool) for k, v in packed.items()}
        n, width = len(texts), len(place)
        out = np.zeros(n * width)
        for field, column in enumerate(texts.flatten()):
            for at, end in _portions(column):
                base = np.arange(end - at) * width + field * len(names)
                part = out[at * width:end * width]
                for kind, (tokens, size) in zip(kinds, _tokens(column.slice(at, end - at), [classes[k] for k in kinds])):
                    known, first, label, weight = tables[kind]
                    part[base + kinds.index(kind)] = size
                    code = pc.index_in(tokens, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                    hit = np.flatnonzero(code >= 0)
                    code, row = code[hit], np.repeat(base, size)[hit]
                    many = first[code + 1] - first[code]
                    spot = np.arange(many.sum()) + np.repeat(first[code] - (np.cumsum(many) - many), many)
                    part += np.bincount(np.repeat(row, many) + len(kinds) + label[spot], weight[spot], len(part))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(out))

    texts = {name: F.coalesce(quoted(c), F.lit("")) for name, c in zip(FIELDS, columns)}
    lengths = F.struct(*[F.length(c).alias(name) for name, c in texts.items()])
    rows = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("_row"), lengths.alias("_lengths"), sums(F.struct(*[F.lower(c).alias(n) for n, c in texts.items()])).alias("_sums"))

    def total(label: str) -> Column:
        return F.col("_sums")[place[label]] if label in place else F.lit(0.0)

    kept = [F.col("_row").getField(c).alias(c) for c in df.columns]
    sizes = [c for n in FIELDS for c in (F.col("_lengths").getField(n).alias(f"{n}_charlen"), total(f"{n}_words").cast("int").alias(f"{n}_wordlen"))]
    return rows.select(*kept, *sizes, *[c.alias(n) for n, c in _features(total, tags).items()])


@functools.cache
def _letters(spark: SparkSession) -> np.ndarray:
    """For each code point whether Spark's regular expressions take it for a letter, so that tokens are those of ``letter_words``."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kept = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", r"[^\p{L}]+", "")).first()[0]
    out = np.zeros(0x110000, bool)
    out[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
    return out


def _no_space() -> np.ndarray:
    """For each code point whether it is part of the tokens of ``words``."""
    out = np.ones(0x110000, bool)
    out[[ord(c) for c in WS_CHARS]] = False
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows without nulls, and where each row starts in them (one more entry than rows)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    first = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first[0]:first[-1]]
    return data, first - first[0]


def _portions(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least: they bound the memory of a task."""
    first, at = _bytes(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
        yield at, end
        at = end


def _tokens(texts: pa.Array, classes: list[np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each class of code points its maximal runs in all rows, and how many each row has."""
    data, first = _bytes(texts)
    begins = np.zeros(len(data) + 1, bool)
    begins[first] = True
    lead = np.flatnonzero(data >= 0xC0)  # first bytes of the characters beyond ASCII
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    point = data[lead].astype(np.int64) & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        following = data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F if len(lead) else point
        point = np.where(size > k, (point << 6) | following, point)
    for own in classes:
        inside = np.concatenate((own[:128], np.zeros(128, bool)))[data]
        held = own[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            inside[lead[held & (size > k)] + k] = True
        at = np.flatnonzero(inside)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1))[:len(at)] | begins[at])
        bounds = np.append(starts, len(at)).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[at]))
        yield tokens, np.diff(np.searchsorted(at[starts], first))


def feature_names(tags: list[str]) -> list[str]:
    """Names of the text features in signature order."""
    lengths = [f"{name}_{kind}" for name in FIELDS for kind in ("charlen", "wordlen")]
    return [*lengths, *_features(lambda label: F.lit(0.0), tags)]


def _token(field: str, kind: str):
    return lambda t: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("_kind"), t.alias("_t"))
