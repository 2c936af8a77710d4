"""Tables that streams and batches fill together.

A table is a folder of Parquet files with one subfolder per load.  A load is written by replacing its own subfolder, so
whoever repeats it (a micro-batch that is retried, a job that is run again under the same name) leaves the table as it
was, and nobody has to read the table in order to add to it.  Readers list the folder; there is no log that knows of
one writer only.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LOAD = "_load"


def load_name(*parts: object) -> str:
    """A name for a load that is a folder name and never read as a number or a date."""
    return "load-" + re.sub(r"[^A-Za-z0-9-]+", "-", "-".join(str(p) for p in parts))


def land(df: DataFrame, path: str, load: str | None = None) -> str:
    """Add rows to a table as one load and return its name; an earlier load of the same name is replaced."""
    load = load or load_name(uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{LOAD}={load}")
    return load


def land_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add what a stream has now, one load per micro-batch, named after the query's own id and the batch.

    The id is in the checkpoint, so a stream that starts anew with a fresh checkpoint never replaces earlier loads.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        land(batch, path, load_name(query, number))

    return _drained(stream, "append", write, checkpoint)


def _drained(stream: DataFrame, mode: str, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_landed(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All rows of a table, whoever has written them; with a ``schema`` a table without loads is empty, not an error."""
    if schema is None:
        return spark.read.parquet(path).drop(LOAD)
    return spark.read.schema(schema).parquet(path).drop(LOAD) if path_exists(spark, path) else spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace_parts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the parts of a table that ``df`` has rows of, and no others; a part is one value of each key."""
    df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def keep_parts(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Drain an aggregating stream into a table; each micro-batch replaces the groups that it has changed, and no others.

    ``keys`` are the grouping columns; a group without a value is the null group, an empty string counts as none.  A
    retried batch writes the same parts again, and the table is there all the time.
    """
    def write(batch: DataFrame, number: int) -> None:
        replace_parts(batch, path, keys)

    _drained(stream, "update", write, checkpoint).awaitTermination()
    return read_landed(stream.sparkSession, path, stream.schema).select(*stream.columns)
