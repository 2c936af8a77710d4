"""Sources and sinks: tables written to the shared folder and read back."""

from pyspark.sql import functions as F

from . import query, table
from ..operators.evaluate import decide
from ..functions.fixed_values import SUB_RATINGS
from ..session import shared_dir
from ..streaming.scoring import append_gold
from ..sources.csv_ranges import read_csv_by_name
from ..sources.landing import read_landed
from ..sources.tables import (
    append_gold_rows, company_from_file, convert_csv, replace_table, write_csv,
)

CSV_FILE_BYTES = 128 << 20  # of text in a file


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def csv_roundtrip(spark, sf):
    """Whole texts, line breaks and quotes included, through CSV and on to Parquet."""
    docs = table(spark, sf, "documents")
    path = shared_dir(spark, "csv")
    write_csv(docs, path)
    back = convert_csv(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", shared_dir(spark, "parquet"))
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


@query("""SELECT 'nation' AS company, count(*) AS n_rows, sum(n_nationkey)::BIGINT AS key_sum FROM nation
UNION ALL SELECT 'region', count(*), NULL FROM region UNION ALL SELECT 'customer', count(*), NULL FROM customer""")
def multi_file_scan(spark, sf):
    """Several files with different columns in one scan, labelled by file name."""
    files = spark.read.option("mergeSchema", True).parquet(*[f"{sf}/{t}.parquet" for t in ("nation", "region", "customer")])
    name = F.replace(F.col("_metadata.file_name"), F.lit("."), F.lit("_"))
    return files.select(company_from_file(name).alias("company"), "n_nationkey").groupBy("company").agg(
        F.count("*").alias("n_rows"), F.sum("n_nationkey").alias("key_sum")
    )


@query("""WITH k AS (SELECT props, event_id FROM events)
SELECT CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS is_bad, count(*) AS n_rows FROM k GROUP BY 1""")
def corrupt_csv_rows(spark, sf):
    """Records that do not fit the schema are kept whole in their own column."""
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, F.lit("not a number")).otherwise(F.col("value").cast("string")).alias("value")
    )
    path = shared_dir(spark, "csv")
    write_csv(events, path)
    back = convert_csv(spark, path, "event_id bigint, value double", shared_dir(spark, "parquet"), corrupt="_corrupt")
    return back.groupBy(F.col("_corrupt").isNotNull().cast("int").alias("is_bad")).agg(F.count("*").alias("n_rows"))


_SCORED = """SELECT user_id, event_id, 1 + value / 125 AS p FROM events"""


@query(f"""WITH s AS ({_SCORED})
SELECT CASE WHEN p >= 4 THEN 'Alto' ELSE 'Bajo' END AS satisfaction, count(*) AS n_rows, round(sum(p), 4) AS total,
       round(sum(round(least(abs(p - 4) / 2, 1), 3)), 3) AS confidence_total, 17 AS n_columns FROM s GROUP BY 1""")
def gold_append(spark, sf):
    """Scored rows appended in two batches in the fixed column order."""
    events = table(spark, sf, "events").select(
        "event_id", (1 + F.col("value") / 125).alias("model_rating"), F.col("event_type").alias("summary"),
        F.date_format("ts", "yyyy-MM-dd").alias("submission_date"), *[F.lit(3.0).alias(c) for c in SUB_RATINGS],
    )
    scored = decide(events, "model_rating", SUB_RATINGS)
    path = shared_dir(spark, "gold")
    append_gold_rows(scored.where("event_id % 2 = 0"), path)
    append_gold_rows(scored.where("event_id % 2 = 1"), path)
    gold = read_landed(spark, path)
    return gold.groupBy("satisfaction").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("predicted_rating"), 4).alias("total"),
        F.round(F.sum("confidence"), 3).alias("confidence_total"), F.lit(len(gold.columns)).alias("n_columns"),
    )


@query("SELECT c_custkey, c_acctbal FROM customer")
def table_replace(spark, sf):
    """Overwrite a table other than the one being read."""
    path = shared_dir(spark, "table")
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    replace_table(customers.where("c_acctbal < 0"), path)
    replace_table(customers, path, read_from=(f"{sf}/customer.parquet",))
    return spark.read.parquet(path)


@query("""SELECT 't' || (c_custkey % 4) AS company, c_custkey, CASE WHEN c_custkey % 4 <> 2 THEN c_name END AS name, c_acctbal,
CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment || chr(10) || '"' || c_name || '", ' || c_custkey END AS comment FROM customer""")
def unlike_headers(spark, sf):
    """A folder of files whose headers differ in order, in names the schema lacks, and in names they lack themselves."""
    c = table(spark, sf, "customer")
    rows = c.select("c_custkey", F.col("c_name").alias("name"), "c_acctbal", F.concat(
        "c_mktsegment", F.lit('\n"'), "c_name", F.lit('", '), F.col("c_custkey").cast("string")).alias("comment"))
    orders = [["c_custkey", "name", "c_acctbal", "comment"], ["comment", "c_acctbal", "name", "c_custkey"],
              ["c_acctbal", "comment", "c_custkey"], ["name", "more", "c_custkey", "c_acctbal"]]
    base = shared_dir(spark, "csv-folder")
    for k, columns in enumerate(orders):
        part = rows.where(F.col("c_custkey") % 4 == k).withColumn("more", F.lit("x"))
        write_csv(part.select(*columns).withColumnRenamed("c_custkey", " c_custkey ") if k == 1 else part.select(*columns), f"{base}/t{k}_reviews")
    found = read_csv_by_name(spark, [f"{base}/t{k}_reviews" for k in range(4)], "c_custkey bigint, name string, c_acctbal double, comment string", required=("c_custkey",))
    return found.select(F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string")).alias("company"), "c_custkey", "name", "c_acctbal", "comment")


@query("SELECT doc_id, lang, source, md5(text) AS digest FROM documents WHERE lang = 'en' AND n_chars > 1000")
def csv_ranges(spark, sf):
    """Large files of texts with line breaks and quotes, read in several ranges and filtered where they are read."""
    path, docs = shared_dir(spark, "csv-large"), table(spark, sf, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    write_csv(docs.repartition(max(1, -(-size // CSV_FILE_BYTES))), path)  # a file is written by one task
    docs = read_csv_by_name(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.where("lang = 'en' AND n_chars > 1000").select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'stream' ELSE 'batch' END AS writer, count(*) AS n_rows, round(sum(1 + value / 125), 4) AS total FROM events GROUP BY 1""")
def gold_shared(spark, sf):
    """A gold table that a stream and a batch job append to; the batch job runs twice under one name."""
    events = table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("value") / 125).alias("model_rating"),
        F.when(F.col("event_id") % 2 == 0, "stream").otherwise("batch").alias("summary"), *[F.lit(3.0).alias(c) for c in SUB_RATINGS])
    scored = decide(events, "model_rating", SUB_RATINGS)
    path, source = shared_dir(spark, "gold"), shared_dir(spark, "gold-source")
    batch = scored.where("event_id % 2 = 1")
    append_gold_rows(batch, path, load="nightly")
    scored.where("event_id % 2 = 0").write.parquet(source)
    append_gold(spark.readStream.schema(scored.schema).parquet(source), path, shared_dir(spark, "checkpoint")).awaitTermination()
    append_gold_rows(batch, path, load="nightly")
    return read_landed(spark, path).groupBy(F.col("summary").alias("writer")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("predicted_rating"), 4).alias("total"))
