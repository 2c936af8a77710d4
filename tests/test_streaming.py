"""Streams give the batch result; repeats and broken lines do not reach the table."""

import json

from pyspark.sql import functions as F

import pytest

from reviewloom.sources import landing
from reviewloom.sources.landing import keep_parts, read_landed
from reviewloom.streaming import scoring as S


def _line(i, ts, likes):
    payload = json.dumps({"body": {"data": {"createdAt": ts, "fields": [{"label": "like most", "type": "TEXTAREA", "value": likes}]}}})
    return json.dumps({"submission_id": i, "ts": ts, "payload": payload})


def _score(df):
    return df.withColumn("model_rating", F.length("pros").cast("double"))


def test_stream_equals_batch_without_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([_line("1", "2024-01-01T10:00:00Z", "abcd"), "{broken", _line("2", "2024-01-01T10:01:00Z", "ab")]))
    (folder / "b.json").write_text("\n".join([_line("1", "2024-01-01T10:20:00Z", "abcd"), _line("3", "2024-01-01T10:30:00Z", "abcde")]))
    stream = S.score_events(S.read_events(spark, str(folder), files_per_batch=1), _score)
    target, checkpoint, rejects = (str(tmp_path / n) for n in ("out", "cp", "bad"))
    S.append_once(stream, target, checkpoint, rejects=rejects)
    out = S.append_once(stream, target, checkpoint, rejects=rejects)  # nothing new
    assert [r["reason"] for r in read_landed(spark, rejects).collect()] == ["no key"]
    got = sorted((r["submission_id"], r["predicted_rating"], r["satisfaction"]) for r in out.collect())
    assert got == [("1", 4.0, "Alto"), ("2", 2.0, "Bajo"), ("3", 5.0, "Alto")]
    batch = S.score_events(spark.read.schema(S.EVENT_SCHEMA).json(str(folder)).dropDuplicates(["submission_id"]).where("submission_id is not null"), _score)
    assert sorted((r["submission_id"], r["predicted_rating"], r["satisfaction"]) for r in batch.collect()) == got


def test_late_events_stay_and_repeats_do_not(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    times = ["2024-01-02T10:00:00Z", "2024-01-02T11:30:00Z", "2024-01-01T10:00:00Z", "2023-01-01T10:00:00Z"]
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for k, ts in enumerate(times):
        (folder / f"{k}.json").write_text("\n".join([_line(str(k), ts, "abcd"), _line("0", ts, "abcd"), json.dumps({"submission_id": "no time"})]))
        S.append_once(S.read_events(spark, str(folder), files_per_batch=1), target, checkpoint)
    assert sorted(r["submission_id"] for r in spark.read.parquet(target).collect()) == ["0", "1", "2", "3"]


def test_gold_appends_only_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    gold, checkpoint = str(tmp_path / "gold"), str(tmp_path / "cp")
    for name, i in (("a", "1"), ("b", "2")):
        (folder / f"{name}.json").write_text(_line(i, "2024-01-01T10:00:00Z", "abcd"))
        S.append_gold(S.score_events(S.read_events(spark, str(folder)), _score), gold, checkpoint).awaitTermination()
    table = read_landed(spark, gold)
    assert table.count() == 2 and len(table.columns) == 17


def test_class_counts_versions(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'Alto' AS c UNION ALL SELECT timestamp'2024-01-02 01:00:00', 'Bajo'").write.parquet(str(tmp_path / "gold"))
    stream = spark.readStream.schema("ts timestamp, c string").parquet(str(tmp_path / "gold"))
    for _ in range(2):  # the second run has no new files
        out = keep_parts(S.class_counts(stream, "ts", "c"), str(tmp_path / "daily"), str(tmp_path / "cp"), ["day", "c"])
    assert sorted((str(r["day"]), r["c"], r["n_events"]) for r in out.collect()) == [("2024-01-01 00:00:00", "Alto", 1), ("2024-01-02 00:00:00", "Bajo", 1)]


def test_counts_follow_late_events_day_by_day(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("gold", "daily", "cp"))
    for ts in ("2024-03-01 10:00:00", "2024-01-01 10:00:00", "2024-03-01 11:00:00", "2020-01-01 00:00:00"):
        spark.sql(f"SELECT timestamp'{ts}' AS ts, 'Alto' AS c").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, c string").parquet(source)
        out = keep_parts(S.class_counts(stream, "ts", "c"), target, checkpoint, ["day", "c"])
    batch = S.class_counts(spark.read.parquet(source), "ts", "c")
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect())) and out.count() == 3


def test_a_retried_batch_adds_nothing(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(_line(i, "2024-01-01T10:00:00Z", "abcd") for i in "1213"))
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    real = landing.land

    def once_broken(*args):
        real(*args)
        monkeypatch.setattr(landing, "land", real)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(landing, "land", once_broken)
    with pytest.raises(Exception, match="lost after the write"):
        S.append_once(S.read_events(spark, str(folder)), target, checkpoint)
    assert read_landed(spark, target).count() == 3
    out = S.append_once(S.read_events(spark, str(folder)), target, checkpoint)
    assert sorted(r["submission_id"] for r in out.collect()) == ["1", "2", "3"]


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """The keys seen are state; the table that grows is not read by later batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    (folder / "0.json").write_text("\n".join(_line(str(i), "2024-01-01T10:00:00Z", "abcd") for i in range(500)))
    S.append_once(S.read_events(spark, str(folder)), target, checkpoint)
    (folder / "1.json").write_text("\n".join(_line(i, "2024-01-02T10:00:00Z", "abcd") for i in ("3", "new")))
    good, _ = S.quarantine(S.read_events(spark, str(folder)), {"key": F.col("submission_id").isNotNull(), "ts": F.col("ts").isNotNull()})
    with S.keyed_state(spark):
        query = landing.land_stream(good.dropDuplicates(["submission_id"]), target, checkpoint)
        query.awaitTermination()
    progress = query.lastProgress
    assert progress["numInputRows"] <= 2 * 2 and progress["stateOperators"][0]["numRowsTotal"] == 501
    assert read_landed(spark, target).count() == 501


def test_texts_of_the_training_rows_stay_at_their_scan(spark, monkeypatch):
    """Whatever the size of the labels, no text is shuffled to meet them, and features are made once."""
    from reviewloom.plans import streams

    fitted, real = [], streams.M.fit_assembled
    monkeypatch.setattr(streams.M, "fit_assembled", lambda df, *rest: (fitted.append(df), real(df, *rest))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        streams._scorer(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = fitted[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "stream-train" in plan
