"""Run registered queries against their SQL twins: ``python -m tests.compare sf_dir [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("reviewloom")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{pathlib.Path(folder) / (t + '.parquet')}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, bool):
        return int(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", v) for v in r))


def differences(spark, con, fn, sql, folder, show=3):
    """Empty when equal, else a description.  Values must be equal, not close."""
    df = fn(spark, folder)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(got)
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:show] if len(got) < 5000 else got[:show]
        return f"rows {len(got)} != {len(want)}; e.g. {extra}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} of {len(got)} rows differ; e.g. {bad[:show]}" if bad else ""), len(got)


def main(argv):
    folder, names = argv[0], argv[1:]
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    from reviewloom import plans

    plans.load()
    spark, con = session(), duck(folder)
    failed = 0
    for name, fn in plans.QUERIES.items():
        if names and not any(n in (name, fn.__module__.rsplit(".", 1)[-1]) for n in names):
            continue
        t = time.time()
        try:
            problem, n = differences(spark, con, fn, plans.ORACLES.get(name), folder)
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        kind = "oracle" if name in plans.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {kind:6s} rows={n} {time.time() - t:.1f}s {problem}", flush=True)
        failed += bool(problem)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
