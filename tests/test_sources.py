"""Large quoted CSV files, folders of unlike files, tables that several writers fill."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from reviewloom.sources import csv_ranges as R
from reviewloom.sources import landing as L
from reviewloom.sources import tables as T


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, header, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end, quoting=quoting)
        w.writerow(header)
        w.writerows(rows)


def odd_rows(seed, n):
    rng = random.Random(seed)
    parts = ["a", "é", '"', '""', "\n", "\n\n", ",", " ", "日本", "x" * 40, '"\n"', "\n,\n"]
    return [(i, "".join(rng.choices(parts, k=rng.choice([1, 2, 5, 40]))), rng.random()) for i in range(n)]


@pytest.mark.parametrize("seed, quoting", [(1, csv.QUOTE_MINIMAL), (2, csv.QUOTE_ALL), (3, csv.QUOTE_MINIMAL)])
def test_ranges_give_every_record_once(spark, tmp_path, small_ranges, seed, quoting):
    rows = odd_rows(seed, 120)
    write(tmp_path / "one.csv", ["id", "text", "score"], rows, quoting=quoting)
    df = R.read_csv_by_name(spark, str(tmp_path / "one.csv"), "id int, text string, score double")
    assert sorted((r.id, r.text, r.score) for r in df.collect()) == rows
    assert R.text_ranges(spark, str(tmp_path / "one.csv")).select("start").distinct().count() > 30
    # in more than one task, and with a filter that stays where the records are read
    assert df.rdd.getNumPartitions() > 2


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = [(1, "short"), (2, "line\n" * 400 + '"end"'), (3, ""), (4, "x" * 1000), (5, "\n")]
    write(tmp_path / "a.csv", ["id", "text"], rows, quoting=csv.QUOTE_NONNUMERIC)
    got = R.read_csv_by_name(spark, str(tmp_path), "id int, text string")
    assert sorted((r.id, r.text) for r in got.collect()) == rows


def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_ranges):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else t, s) for i, t, s in odd_rows(7, 60)] + [(99, "", 0.5)], "id int, text string, score double")
    path = str(tmp_path / "out")
    T.write_csv(df.repartition(3), path)
    whole = T.read_csv(spark, path, "id int, text string, score double")
    ranged = R.read_csv_by_name(spark, path, "id int, text string, score double").drop("file_name")
    assert sorted(map(str, ranged.collect())) == sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))


def test_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path / "acme_1.csv", ["id", "text", "rating"], [(1, "one", 1.0)])
    write(tmp_path / "acme_2.csv", ["rating", " id ", "more", "text"], [(2.0, 2, "x", "two")], end="\r\n")
    write(tmp_path / "beta+co 3.csv", ["text", "id"], [("three\nlines", 3)])
    (tmp_path / "bom_4.csv").write_bytes("﻿id,rating,text\n4,4.0,four".encode())
    (tmp_path / "empty_5.csv").write_text("id,text\n\n")
    got = T.read_folder(spark, str(tmp_path), "id int, rating double, text string")
    assert sorted((r.id, r.rating, r.text, r.file_name) for r in got.collect()) == [
        (1, 1.0, "one", "acme_1.csv"), (2, 2.0, "two", "acme_2.csv"), (3, None, "three\nlines", "beta+co 3.csv"), (4, 4.0, "four", "bom_4.csv")]


def test_headers_that_cannot_be_meant_are_errors(spark, tmp_path):
    for name, text in (("odd", 'id,text\n1,"open\n2,x\n'), ("twice", "id,id\n1,2\n"), ("lines", '"i\nd",text\n1,x\n'), ("lacks", "text\nx\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError, match=name):
            R.read_csv_by_name(spark, str(tmp_path / f"{name}.csv"), "id int, text string", required=("id",))


def test_the_plain_reader_refuses_another_order(spark, tmp_path):
    write(tmp_path / "a.csv", ["id", "text", "rating"], [(1, "one", 1.0)])
    with pytest.raises(Exception, match="(?i)header"):
        T.read_csv(spark, str(tmp_path / "a.csv"), "id int, rating double, text string").collect()


def test_records_that_do_not_fit_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score\n1,2.5\nx,1\n3,y\n4,1,5\n")
    got = R.read_csv_by_name(spark, str(tmp_path), "id int, score double", corrupt="_bad").collect()
    assert sorted((r._bad or "", r.id) for r in got)[0] == ("", 1) and {r._bad for r in got} == {None, "x,1", "3,y", "4,1,5"}


def test_streams_and_batches_fill_one_table(spark, tmp_path):
    table, source, checkpoint = (str(tmp_path / n) for n in ("gold", "in", "cp"))
    rows = spark.range(4).select("id", F.lit("x").alias("v"))
    rows.where("id < 2").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    assert L.read_landed(spark, table, rows.schema).count() == 0
    L.land_stream(stream, table, checkpoint).awaitTermination()
    L.land(rows.where("id = 2"), table)
    assert sorted(r.id for r in L.read_landed(spark, table).collect()) == [0, 1, 2]
    L.land_stream(stream, table, checkpoint).awaitTermination()  # nothing new
    L.land(rows.where("id = 3"), table, "nightly")
    L.land(rows.where("id = 3"), table, "nightly")  # run again
    assert sorted(r.id for r in L.read_landed(spark, table).collect()) == [0, 1, 2, 3]
    L.land_stream(stream, table, str(tmp_path / "cp2")).awaitTermination()  # another query never replaces these loads
    assert sorted(r.id for r in L.read_landed(spark, table).collect()) == [0, 0, 1, 1, 2, 3]


def test_only_changed_parts_are_replaced(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), (None, 1, 30)], "k string, j int, n int")
    L.replace_parts(rows, path, ["k", "j"])
    L.replace_parts(spark.createDataFrame([("a", 2, 21), ("b", 1, 40)], rows.schema), path, ["k", "j"])
    L.replace_parts(rows.limit(0), path, ["k", "j"])
    got = L.read_landed(spark, path, rows.schema).select("k", "j", "n").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, 10), ("a", 2, 21), ("b", 1, 40), (None, 1, 30)]


def test_large_texts_are_written_to_several_files(spark, monkeypatch):
    from reviewloom.plans import io

    paths, kept = [], io.write_csv
    monkeypatch.setattr(io, "write_csv", lambda df, path: (paths.append(path), kept(df, path)))
    monkeypatch.setattr(io, "CSV_FILE_BYTES", 100_000)
    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND n_chars > 1000").count()
    assert io.csv_ranges(spark, sf).count() == want
    assert spark.read.text(paths[0]).select("_metadata.file_path").distinct().count() > 1
