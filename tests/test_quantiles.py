"""Exact quantiles of many columns against numpy, on the paths for many and for equal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import profile, quantiles
from reviewloom.operators.quantiles import wide_quantiles


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(2000).selectExpr(
        "id", "rand(1) AS a", "floor(rand(2) * 4) AS `b.x`", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN double('NaN') ELSE -exp(rand(3) * 20) END AS c",
        "CAST(NULL AS DOUBLE) AS empty", "5 AS same", "CASE WHEN rand(4) < 0.9 THEN 0.5 ELSE rand(5) END AS d", "CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'test' END AS split")
    return df.persist()


COLUMNS = ["b.x", "c", "empty", "d"]
PROBS = {"low": 0.0, "q25": 0.25, "q75": 0.75, "high": 1.0}


@pytest.mark.parametrize("few, margin", [(20_000, 0.006), (30, 1e-9)])
def test_equal_to_numpy(table, monkeypatch, few, margin):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    monkeypatch.setattr(quantiles, "AT_ONCE", 50)
    parts = {"train": F.col("split") == "train", "none": F.col("id") < 0, "two": F.col("id").isin(4, 5)}
    got = wide_quantiles(table.repartition(5), COLUMNS, parts, PROBS)
    rows = table.toPandas()
    masks = {"train": rows["split"] == "train", "two": rows["id"].isin([4, 5])}
    for name, mask in masks.items():
        for c in COLUMNS:
            values = rows.loc[mask, c].astype(float).dropna().to_numpy()
            if not len(values):
                assert (name, c) not in got
            else:
                want = np.quantile(values, list(PROBS.values()))
                assert np.allclose(list(got[name, c].values()), want, rtol=1e-12, atol=0), (name, c)
    assert not any(part == "none" for part, _ in got)


def test_reports_of_odd_tables(spark, table):
    got = profile.iqr_report(table, "split", ["a", "empty"], whole=True).collect()
    assert sorted((r["split"], r["variable"]) for r in got) == [("all", "a"), ("test", "a"), ("train", "a")]
    report = {(r["split"], r["variable"]): r for r in profile.outlier_report(table, "split", ["a", "empty", "same"], multiplier=0.01).collect()}
    assert report["test", "empty"]["lower"] is None and report["test", "empty"]["n_outliers"] == 0
    assert report["train", "a"]["n_outliers"] > 0 and (None, "a") in report
    assert profile.iqr_report(table.limit(0), "split", ["a"], whole=True).count() == 0
