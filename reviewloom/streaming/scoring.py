"""Structured Streaming: score form events, append to gold, live counts.

The per-event functions are the batch ones; only source, watermark and sink differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.forms import parse_forms
from ..functions.fixed_values import SUB_RATINGS
from ..operators.evaluate import decide
from ..sources.landing import land_stream, read_landed
from ..sources.tables import gold_rows, quarantine

EVENT_SCHEMA = "submission_id string, ts timestamp, payload string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines events; a malformed line keeps null fields."""
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State kept by RocksDB on the executors' disks, of which a batch writes its changes only."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_once(
    stream: DataFrame, path: str, checkpoint: str, key: str = "submission_id", rejects: str | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Drain a stream into a table that holds each key once, however late a repeat or a first copy comes.

    The keys seen are state of the query: a batch looks up its own keys and never reads the table, so its work does not
    grow with the table.  The first copy to arrive stays (of several in a batch any one).  ``then`` works on the rows
    that are new, without aggregates, before they are written.  A batch that is retried replaces its own rows.  Rows
    without key or time go to the ``rejects`` table with the reason, by a query of their own.
    """
    good, bad = quarantine(stream, {"no key": F.col(key).isNotNull(), "no time": F.col("ts").isNotNull()})
    new = then(good.dropDuplicates([key]))
    with keyed_state(stream.sparkSession):
        land_stream(new, path, checkpoint).awaitTermination()
    if rejects:
        land_stream(bad, rejects, f"{checkpoint.rstrip('/')}-rejects").awaitTermination()
    return read_landed(stream.sparkSession, path, new.schema)


def score_events(events: DataFrame, model_score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parse the form, add the model's ``model_rating``, then blend, label and confidence.

    ``model_score`` is a DataFrame -> DataFrame function, typically a saved
    pipeline's ``transform`` with its feature projection; the same one serves batch.
    """
    parsed = parse_forms(events, "payload", ("submission_id", "ts"), F.col("ts").cast("string"))
    return decide(model_score(parsed), "model_rating", SUB_RATINGS)


def append_gold(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the gold table with its fixed columns, each event once; batch jobs may append to the same table."""
    return land_stream(gold_rows(scored, F.col("ts")), path, checkpoint)


def class_counts(gold: DataFrame, ts: str, label: str, width: str = "1 day") -> DataFrame:
    """Events per day and class, on a stream and on a table alike.

    The state is one row per day and class, so it is kept and events count however late they come.
    """
    return (
        gold.groupBy(F.window(ts, width).alias("w"), label).agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("day"), label, "n_events")
    )
