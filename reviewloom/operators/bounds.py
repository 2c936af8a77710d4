"""Size checks that decide between an inlined small table and a join."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, functions as F

from ..session import written

INLINE_ROWS = 1024
SETTLED_ROWS = 50_000
SETTLED_BYTES = 32 << 20
MAX_COLUMNS_FROM_DATA = 10_000


def rows_if_small(df: DataFrame, limit: int = INLINE_ROWS) -> list[Row] | None:
    """All rows when there are at most ``limit`` of them, else ``None``.

    At most ``limit + 1`` rows ever reach the driver, so the check itself is safe.
    """
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def distinct_values(df: DataFrame, column: str, limit: int = MAX_COLUMNS_FROM_DATA) -> list:
    """Sorted distinct non-null values that are about to become columns.

    Column counts are a schema property, so exceeding the bound is an error
    (as in Spark's own pivot) and never a silent cut.
    """
    values = df.select(column).where(df[column].isNotNull()).distinct()
    rows = rows_if_small(values, limit)
    if rows is None:
        raise ValueError(f"{column} has more than {limit} distinct values; too many to become columns")
    return sorted(r[0] for r in rows)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Compute a derived table once and make its size known to the optimiser.

    Aggregates carry no useful size estimate, so joining one back would shuffle
    the large side first.  Up to ``SETTLED_ROWS`` rows and ``SETTLED_BYTES`` the
    table becomes a local relation with a broadcast hint; beyond that it is
    written to the shared folder and joined as an ordinary table.  Rows and bytes
    are summed on the executors before anything comes to the driver.  The cached
    copy only spans the check, so nothing is computed twice.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size = kept.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
        if size[0] <= SETTLED_ROWS and (size[1] or 0) <= SETTLED_BYTES:
            return F.broadcast(df.sparkSession.createDataFrame(kept.toArrow(), schema=df.schema))
        return written(kept, name)
    finally:
        kept.unpersist()
