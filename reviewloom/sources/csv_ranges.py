"""CSV files whose quoted fields span lines, read in parallel and by header name.

Such a file cannot be cut at any line end, as the line may end inside a quoted field.  The text source cuts files into
byte ranges all the same, and two passes settle what that means:

1. Each range reports its number of quotes, and the first range of a file its header.  A running sum over the ranges of
   a file, one row each, says whether a range begins inside a quoted field.
2. Each range joins its lines to records from its own first record on.  What is left over at its ends are fragments;
   they alone are shuffled, put together, and parsed like the rest.

Quotes inside quoted fields are doubled (RFC 4180), so that only their number counts.  Files are read through Spark, so
any URI will do.  Columns are found by the header of their file: order does not matter, a missing column is null, one
that the schema lacks is left out.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, _parse_datatype_string

from ..session import written

MOST_HEADERS = 200  # different headers of one read; each is a branch of the parsing expression
MOST_INSIDE = 1_000_000
_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "nullValue": "\u0000", "emptyValue": ""}


def text_ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, file, start): the lines of the byte ranges, in order within a range."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """A batch cut where the range changes, as ((file, start), rows)."""
    files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy(zero_copy_only=False)
    codes = files.indices.to_numpy(zero_copy_only=False)
    edge = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
    for low, high in zip([0, *edge], [*edge, len(batch)]):
        if high > low:
            yield (files.dictionary[int(codes[low])].as_py(), int(starts[low])), batch.slice(low, high - low)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def range_facts(lines: DataFrame) -> DataFrame:
    """(file, start, quotes, header) of every range; the first range of a file has its first line as header."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("header", pa.string())])

    def facts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in parts:
            out = []
            for key, rows in _runs(batch):
                line = rows.column("line")
                out.append((*key, int(_quotes(line).sum()), line[0].as_py() if key[1] == 0 and key != last else None))
                last = key
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    counted = lines.mapInArrow(facts, "file string, start long, quotes long, header string")
    return counted.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.max("header").alias("header"))


def open_ranges(facts: DataFrame) -> DataFrame:
    """(file, start, inside, unbalanced): whether a range begins inside a quoted field, and whether its file's quotes are odd."""
    order = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return facts.select("file", "start", (before % 2 == 1).alias("inside"), (F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1).alias("unbalanced"))


def record_pieces(lines: DataFrame, inside, fragments: bool) -> DataFrame:
    """The whole records of every range, or its ``fragments``: (file, start, place, opens, record).

    ``inside`` is a broadcast set of the (file, start) that begin within a quoted field.  ``place`` orders the two
    fragments of a range, ``opens`` marks one that begins a record.  The header of a file is left out.
    """
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("opens", pa.bool_()), ("record", pa.string())])

    def joined(held: list[pa.Array], ends: np.ndarray) -> pa.Array:
        values = pa.concat_arrays(held)
        off = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(off, values.slice(0, int(ends[-1]))), "\n")

    def rows(key: tuple, records: pa.Array, place: int, opens: bool) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.array(np.full(n, place, np.int32)),
            pa.array(np.full(n, opens)), records.cast(pa.string())], schema=schema)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, odd, started, top = None, [], 0, False, False  # lines since the last record end, parity, whether a record has begun here

        def rest() -> Iterator[pa.RecordBatch]:
            # what is open at the end of a range: a record that goes on, or a range that lies within one record
            if held and fragments:
                yield rows(key, joined(held, np.array([sum(map(len, held))])), 1, started)

        for batch in parts:
            for this, part in _runs(batch):
                if this != key:
                    yield from rest()
                    within = this in inside.value
                    key, held, odd, started, top = this, [], int(within), not within, this[1] == 0
                line = part.column("line")
                parity = (np.cumsum(_quotes(line)) + odd) % 2
                odd = int(parity[-1])
                pending = sum(map(len, held))
                held.append(line)
                ends = np.flatnonzero(parity == 0) + pending + 1
                if not len(ends):
                    continue
                records = joined(held, ends)
                values = pa.concat_arrays(held)
                held = [values.slice(int(ends[-1]))] if int(ends[-1]) < len(values) else []
                if not started:  # the first record end closes a record of an earlier range
                    if fragments:
                        yield rows(key, records.slice(0, 1), 0, False)
                    records, started = records.slice(1), True
                records, top = records.slice(1) if top else records, False
                if len(records) and not fragments:
                    yield rows(key, records, 0, True)
        yield from rest()

    return lines.mapInArrow(cut, "file string, start long, place int, opens boolean, record string")


def joined_fragments(pieces: DataFrame) -> DataFrame:
    """(file, record) of the records that lie on several ranges."""
    order = Window.partitionBy("file").orderBy("start", "place")
    numbered = pieces.select("file", "start", "place", F.sum(F.col("opens").cast("int")).over(order).alias("number"))
    whole = pieces.select("file", "start", "place", "record").join(numbered, ["file", "start", "place"])
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "record")))
    return whole.groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")).select("file", "record")


def _names(header: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")], skipinitialspace=True)))


def _parsed(record: Column, names: tuple[str, ...], fields: list[StructField], corrupt: bool) -> Column:
    """A record as a struct of the columns in its header, ``c0``, ``c1`` and so on, and perhaps ``corrupt``."""
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    own = [f"c{i} {kinds.get(n, 'string')}" for i, n in enumerate(names)] + ["corrupt string"] * corrupt
    return F.from_csv(record, F.lit(", ".join(own)), _OPTIONS | ({"columnNameOfCorruptRecord": "corrupt"} if corrupt else {}))


def read_csv_by_name(
    spark: SparkSession, paths: str | list[str], schema: str, corrupt: str | None = None, required: tuple[str, ...] = (),
) -> DataFrame:
    """All records of CSV files with headers, columns by name, one task per byte range; ``file_name`` is added.

    With ``corrupt`` records that do not fit are kept whole in that column.  Unbalanced quotes, a header that spans lines,
    has a name twice or lacks a ``required`` column are errors that name the file.
    """
    fields = _parse_datatype_string(schema).fields
    lines = text_ranges(spark, paths)
    facts = written(range_facts(lines), "csv-ranges")
    spans = open_ranges(facts)
    if broken := spans.where("unbalanced").select("file").limit(1).collect():
        raise ValueError(f"unbalanced quotes in {broken[0].file}")
    tops = facts.where("start = 0").select("file", F.coalesce("header", F.lit("")).alias("header"))
    kinds = tops.groupBy("header").agg(F.min("file").alias("file")).orderBy("header").limit(MOST_HEADERS + 1).collect()
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    for kind in kinds:
        names = _names(kind.header)
        if kind.header.count('"') % 2 or len(set(names)) < len(names):
            raise ValueError(f"the header of {kind.file} spans lines or has a name twice")
        if missing := set(required) - set(names):
            raise ValueError(f"{kind.file} lacks {sorted(missing)}")

    # one entry a range that begins inside a field; ranges are maxPartitionBytes apart
    within = spans.where("inside").select("file", "start").limit(MOST_INSIDE + 1).collect()
    if len(within) > MOST_INSIDE:
        raise ValueError(f"more than {MOST_INSIDE} ranges begin inside a field: raise spark.sql.files.maxPartitionBytes")
    inside = spark.sparkContext.broadcast({(r.file, r.start) for r in within})
    records = record_pieces(lines, inside, fragments=False).select("file", "record")
    if within:  # otherwise every record lies on one range
        records = records.unionByName(joined_fragments(record_pieces(lines, inside, fragments=True)))
    records = records.select("file", F.regexp_replace("record", r"\r\z", "").alias("record")).where(F.btrim("record") != "")
    headers = [_names(k.header) for k in kinds]
    if len(kinds) > 1:  # files with the same header are parsed by the same branch of one scan
        number = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k.header, i)])
        records = records.join(tops.select("file", number[F.col("header")].alias("kind")), "file")
    else:
        records = records.withColumn("kind", F.lit(0))
    rows = [F.when(F.col("kind") == i, _parsed(F.col("record"), names, fields, bool(corrupt))).alias(f"_row{i}") for i, names in enumerate(headers)]
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    parsed = records.select(name.alias("file_name"), *rows)

    def field(f: StructField) -> Column:
        found = [F.col(f"_row{i}")[f"c{names.index(f.name)}"] for i, names in enumerate(headers) if f.name in names]
        return F.coalesce(*found, F.lit(None).cast(f.dataType)).alias(f.name)

    broken = [F.coalesce(*[F.col(f"_row{i}")["corrupt"] for i in range(len(headers))], F.lit(None).cast("string")).alias(corrupt)] if corrupt else []
    return parsed.select(*[field(f) for f in fields], *broken, "file_name")
