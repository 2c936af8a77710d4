"""Operators against brute force on small, awkward tables, including their large-table paths."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.operators import align, dedup, encode, enrich, evaluate, matching, profile, ranks, text, vectors
from reviewloom.sources import tables
from tests.conftest import rows

QUIET = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# ---- dedup ---------------------------------------------------------------------

def test_merge_sources(spark):
    a = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "")], "id int, key string")
    b = spark.createDataFrame([(4, "k1"), (5, "k2"), (6, "k2"), (7, ""), (8, "")], "id int, key string")
    assert [r[0] for r in rows(dedup.merge_sources(a, b, "key", ["id"]), "id")] == [1, 2, 3, 5, 7, 8]


def test_keep_first_with_null_key_and_odd_names(spark):
    df = spark.createDataFrame([(2, "x", "b"), (1, "x", "a"), (3, None, "c"), (4, None, "d")], "id int, k string, `a.b` string")
    assert rows(dedup.keep_first(df, "k", ["id"]), "id") == [(1, "x", "a"), (3, None, "c")]


def test_one_hot_key_is_not_lost(spark):
    df = spark.range(30_000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS k")
    assert dedup.keep_first(df, "k", ["id"]).count() == 20_001


# ---- matching ------------------------------------------------------------------

SLUGS = ["sse", "sse-airtricity", "credit-suisse", "bath-body-works", "x-bt", "bt-x", "", "a-bt-c", None, "Sse"]


def test_slug_rules(spark):
    df = spark.createDataFrame([(s,) for s in SLUGS], "slug string")
    entries = spark.createDataFrame([("sse",), ("bat",), ("bt",)], "entry string")
    strict = {tuple(r) for r in matching.slug_matches(df, "slug", entries, "entry").collect()}
    loose = {tuple(r) for r in matching.substring_matches(df, "slug", entries, "entry").collect()}
    fs = ["sse", "bat", "bt"]
    want = {(s, f) for s in SLUGS if s is not None for f in fs
            if s.lower() == f or s.lower().startswith(f + "-") or s.lower().endswith("-" + f)}
    assert strict == want
    assert loose == {(s, f) for s in SLUGS if s is not None for f in fs if f in s.lower()}


def test_presence_counts_a_row_once_per_entity(spark):
    entities = spark.createDataFrame([("E", "ab"), ("E", "bc"), ("F", "zz")], "entity string, slug string")
    a = spark.createDataFrame([("xabcx",), ("xabcx",), ("q",)], "name string")
    b = spark.createDataFrame([("bc",), (None,)], "name string")
    assert rows(matching.entity_presence(entities, "entity", "slug", a, b, "name")) == [("E", 2, 1, 3)]


# ---- ranks ---------------------------------------------------------------------

@QUIET
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6))), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, data):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double")
    got = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for k in {k for k, v in data if v is not None}:
        values = [float(v) for kk, v in data if kk == k and v is not None]
        want = np.quantile(values, [0.25, 0.5, 0.9])
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], want, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("values", ["rand(1)", "floor(rand(2) * 5)", "exp(rand(3) * 30)", "7.0", "IF(id % 2 = 0, 0, rand(4))"])
def test_quantiles_of_large_skewed_groups(spark, values):
    """Buckets and slices are used (whole_group=100); one group holds most rows."""
    df = spark.range(40_000).selectExpr("IF(id % 10 = 0, 'small', 'hot') AS k", f"CAST({values} AS DOUBLE) AS v")
    pdf = df.toPandas()
    got = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], "v", {"q25": 0.25, "q75": 0.75}, whole_group=100).collect()}
    for k, part in pdf.groupby("k"):
        assert np.allclose([got[k]["q25"], got[k]["q75"]], np.quantile(part["v"], [0.25, 0.75]), rtol=1e-12)


def test_quantiles_of_many_group_sizes(spark):
    """Without whole groups: the cut points and the step next to them must always hold the rank."""
    sizes = [1, 2, 3, 4, 5, 7, 11, 50, 99, 500, 1001, 1999, 2503, 4999, 7001]
    parts = [(n, float(v)) for n in sizes for v in np.random.default_rng(n).normal(size=n)]
    df = spark.createDataFrame(parts, "k int, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], "v", probs, whole_group=0).collect()}
    for n in sizes:
        want = np.quantile([v for k, v in parts if k == n], list(probs.values()))
        assert np.allclose([got[n][c] for c in probs], want, rtol=1e-12, atol=1e-12), n


def test_quantiles_when_tables_are_written(spark, no_broadcast):
    df = spark.range(500).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS v")
    got = rows(ranks.exact_quantiles(df, ["k"], "v", {"m": 0.5}), "k")
    assert got == [(0, 249.0), (1, 250.0)]


def test_row_numbers_and_folds_over_buckets(spark):
    df = spark.range(1003).selectExpr("id * 7 AS key")
    numbered = rows(ranks.with_row_number(df, "key", rows_per_bucket=100), "key")
    assert [r[1] for r in numbered] == list(range(1, 1004))
    folds = rows(ranks.contiguous_folds(df, "key", 5, rows_per_bucket=100), "key")
    assert [sum(f == i for _, f in folds) for i in range(5)] == [201, 201, 201, 200, 200]
    assert [f for _, f in folds] == sorted(f for _, f in folds)


def test_row_numbers_of_text_keys(spark):
    df = spark.range(500).selectExpr("md5(CAST(id AS STRING)) AS `review.id`", "id")
    got = rows(ranks.with_row_number(df, "review.id", rows_per_bucket=60))
    assert [r[2] for r in sorted(got)] == list(range(1, 501))
    assert ranks.with_row_number(df.limit(0), "review.id").count() == 0
    assert {r["fold"] for r in ranks.contiguous_folds(df, "review.id", 3, rows_per_bucket=60).collect()} == {0, 1, 2}


@pytest.mark.parametrize("per_range", [100, 1_000_000])
def test_rank_with_ties_and_ranges(spark, per_range):
    df = spark.range(3000).selectExpr("id", "IF(id % 50 = 0, NULL, IF(id % 10 = 1, 1, 0)) AS g", "CAST(IF(id % 7 = 0, NULL, floor(sqrt(id))) AS DOUBLE) AS s")
    got = evaluate.rank_within(df, ["g"], "s", rows_per_range=per_range).toPandas()
    assert len(got) == 3000 and got["rank"].isna().equals(got["s"].isna())
    got = got.dropna(subset=["s"])
    want = got.groupby("g", dropna=False)["s"].rank(method="min", ascending=False).astype(int)
    assert (got["rank"].astype(int) == want).all()


def test_missing_periods_are_the_gaps(spark):
    df = spark.createDataFrame([("a", 2), ("a", 5), ("a", 5), ("b", 1), ("b", 7), ("c", None), ("d", 4), (None, 3)], "e string, p int")
    got = {(r.e, r.period) for r in tables.missing_periods(df, "e", F.col("p"), F.lit(2), F.lit(6)).collect()}
    seen = {(r.e, r.p) for r in df.collect()}
    assert got == {(e, p) for e in ("a", "b", "c", "d", None) for p in range(2, 7)} - seen


def test_empty_keys_pass_the_anti_join(spark):
    a = spark.createDataFrame([(1, ""), (2, None), (3, "x"), (4, "y")], "i int, k string")
    seen = spark.createDataFrame([("x",), ("",), (None,)], "k string")
    assert sorted(r.i for r in dedup.new_keys_only(a, seen, "k").collect()) == [1, 2, 4]


# ---- text ----------------------------------------------------------------------

DOCS = [(1, "Joy and fear, joy!"), (2, ""), (3, None), (4, "nothing here"), (5, "fear")]
LEXICON = [("joy", "joy"), ("joy", "positive"), ("fear", "fear")]
CATS = ["joy", "positive", "fear"]


def _shares(spark):
    docs = spark.createDataFrame(DOCS, "id int, t string")
    lexicon = spark.createDataFrame(LEXICON, "token string, category string")
    counts = text.category_counts(docs, "id", "t", lexicon, "token", "category", CATS)
    return rows(text.shares_of_hits(counts, "id", CATS, "e_"), "id"), rows(text.shares_of_tokens(counts, "id", CATS, "d_", True), "id")


def test_lexicon_shares(spark):
    of_hits, of_tokens = _shares(spark)
    assert of_hits == [(1, 0.4, 0.4, 0.2), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 1.0)]
    assert of_tokens == [(1, 0.5, 0.5, 0.25), (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, None, None, 1.0)]


def test_lexicon_shares_do_not_depend_on_the_join(spark, no_broadcast):
    of_hits, _ = _shares(spark)
    assert of_hits[0] == (1, 0.4, 0.4, 0.2) and of_hits[4] == (5, 0, 0, 1.0)


def test_vocabulary_ratio_and_valence(spark):
    docs = spark.createDataFrame([(1, "burn out Sad sad,"), (2, "")], "id int, t string")
    vocabulary = spark.createDataFrame([("burn out",), ("sad",)], "w string")
    assert rows(text.vocabulary_ratio(docs, "id", "t", vocabulary, "w", "r"), "id") == [(1, 0.25), (2, 0.0)]
    valences = spark.createDataFrame([("sad", -2.0)], "w string, v double")
    got = rows(text.valence_compound(docs, "id", "t", valences, "w", "v", "s"), "id")
    assert math.isclose(got[0][1], -4 / math.sqrt(16 + 15)) and got[1][1] == 0.0


def test_top_words_by_class_counts_unlabelled_rows_in_all(spark):
    docs = spark.createDataFrame([("s", "Alto", "apple apple pear"), ("s", None, "apple plum"), ("s", "odd", "plum")], "src string, cls string, t string")
    got = rows(text.top_words_by_class(text.word_frequencies(docs, "t", [], ("src", "cls")), "src", "cls", ["Alto", "Bajo"], 2).select("cls", "word", "frequency", "position"), "cls", "position")
    assert got == [("All", "apple", 3, 1), ("All", "plum", 2, 2), ("Alto", "apple", 2, 1), ("Alto", "pear", 1, 2)]


# ---- profile and encode ----------------------------------------------------------

def test_outlier_limits_use_distinct_and_nonzero_values(spark):
    values = [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 3.0, 100.0]
    df = spark.createDataFrame([("train", v) for v in values] + [("test", 1000.0), ("test", None)], "split string, v double")
    s = pd.Series(values)
    iqr = pd.Series(s.unique()).quantile(0.75) - s[s != 0].quantile(0.25)
    got = {r["split"]: r for r in profile.outlier_report(df, "split", ["v"], multiplier=2).collect()}
    assert math.isclose(got["train"]["upper"], s.quantile(0.75) + 2 * iqr)
    assert got["train"]["n_outliers"] == 1 and got["test"]["n_outliers"] == 1 and got["test"]["outlier_share"] == 0.5


def test_split_consistency_flags_and_skips(spark):
    data = [("train" if i % 5 else "test", float(i % 7) * (9 if i % 5 == 0 else 1), 0.0 if i % 3 else 1.0, "a" if i % 5 else "b") for i in range(200)]
    df = spark.createDataFrame(data, "split string, x double, mostly_zero double, c string")
    got = {(r["check_name"], r["variable"], r["category"]): r["passed"] for r in profile.split_consistency(df, "split", ["x", "mostly_zero"], ["c"]).collect()}
    assert got == {("iqr", "x", ""): 0, ("share", "c", "a"): 0, ("share", "c", "b"): 0}


def test_histogram_last_bin_and_constant(spark):
    df = spark.range(11).selectExpr("CAST(id AS DOUBLE) AS v")
    assert {r["bin"]: r["n_rows"] for r in profile.histogram(df, "v").collect()}[9] == 2
    assert profile.histogram(df.selectExpr("5.0D AS v"), "v").count() == 1


@pytest.mark.parametrize("width", [4, 24])
def test_correlations_with_a_constant_column(spark, width):
    df = spark.range(50).selectExpr("rand(1) AS a", "rand(2) AS `b.c`", "IF(id = 3, NULL, rand(3)) AS d", "7 AS same", *[f"rand({i}) AS x{i}" for i in range(20)])
    columns = df.columns[:width]
    got = {(r.column_a, r.column_b): (r.n_rows, r.correlation) for r in profile.correlation_matrix(df, columns).collect()}
    assert len(got) == width * (width - 1) // 2 and {n for n, _ in got.values()} == {49}
    assert all((r is None) == ("same" in pair) for pair, (_, r) in got.items())
    complete = df.where("d IS NOT NULL").toPandas()
    assert np.isclose(got["a", "b.c"][1], complete["a"].corr(complete["b.c"]))
    assert {r["correlation"] for r in profile.correlation_matrix(df.limit(10), ["a", "d"]).collect()} == {None}


def test_gates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -1.0)], "id int, x double")
    with pytest.raises(ValueError):
        profile.require_unique(df, ["id"])
    assert profile.model_input_gates(df, ["x"]).first()["passed"] == 1


def test_target_encoder_median_and_fallback(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0), ("b", 4.0), (None, 9.0)], "c string, y double")
    stats, overall = encode.fit_target_encoder(train, "c", "y")
    assert overall == {"mean": statistics.mean([1, 2, 5, 4, 9]), "median": 4.0}
    test = spark.createDataFrame([("a",), ("new",), (None,)], "c string")
    got = {r["c"]: (r["c_targenc_mean"], r["c_targenc_median"]) for r in encode.apply_target_encoder(test, "c", stats, overall).collect()}
    assert got == {"a": (8 / 3, 2.0), "new": (4.2, 4.0), None: (4.2, 4.0)}


def test_scaler_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, 7.0, "x"), (3.0, 7.0, None)], "a double, flat double, c string")
    scaled = encode.apply_scaler(df, encode.fit_scaler(df, ["a", "flat"]))
    assert rows(scaled.select("a", "flat"), "a") == [(-1.0, 0.0), (1.0, 0.0)]
    hot = encode.apply_one_hot(df, encode.fit_one_hot(df, ["c"]))
    assert [r["c_x_ohe"] for r in hot.orderBy("a").collect()] == [1.0, 0.0]


def test_hash_split_is_stable_and_close_to_the_share(spark):
    df = spark.range(20_000)
    one = encode.hash_split(df, "id")
    two = encode.hash_split(df.repartition(13), "id")
    assert one.join(two.withColumnRenamed("split", "s2"), "id").where("split <> s2").count() == 0
    assert abs(one.where("split = 'train'").count() / 20_000 - 0.8) < 0.01


def test_hostile_names(spark):
    columns = ["pros_ld_``", "pros_ld_.", "pros_ld_,", "Price per square foot ($)", "Republican/lean Rep.", "A", "a_"]
    names = align.safe_names(columns)
    assert len(set(names.values())) == len(columns)
    df = spark.createDataFrame([(None, 2.0)], "`pros_ld_.` double, x double")
    out, missing = align.align_signature(align.fill_family(df, "_ld_", 0.5), columns + ["pros_ld_."], ("x",))
    assert out.columns == ["x", *columns, "pros_ld_."] and "pros_ld_." not in missing and len(missing) == 6


# ---- enrich ----------------------------------------------------------------------

def test_lookup_matches_null_keys_and_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    dim = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    assert rows(enrich.left_lookup(df, dim, {"k": "k"}, {"v": "v"}).select("i", "v"), "i") == [(1, 10), (2, 20), (3, None)]
    with pytest.raises(ValueError):
        enrich.unique_keys(dim.union(dim), ["k"], "dim")


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "g string, v string")
    assert rows(enrich.modes(df, ["g"], "v", "m")) == [("g", "a")]


def test_monthly_change_needs_the_exact_month(spark):
    df = spark.createDataFrame([("t", "2023-01-05", 10.0), ("t", "2023-03-01", 20.0), ("t", "2023-04-01", 30.0), ("t", "2024-03-09", 40.0)], "t string, d string, c double")
    got = rows(enrich.monthly_changes(df.withColumn("d", F.to_date("d")), "t", "d", "c").select("year", "month", "percchange_month", "percchange_year"), "year", "month")
    assert got == [(2023, 1, None, None), (2023, 3, None, None), (2023, 4, 0.5, None), (2024, 3, None, 1.0)]


# ---- evaluate --------------------------------------------------------------------

def test_metrics(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0), ("x", 2.0, 1.0), ("flat", 3.0, 3.0), ("flat", 3.0, 2.0)], "g string, y double, p double")
    got = {r["g"]: r for r in evaluate.regression_metrics(df, "y", "p", ("g",)).collect()}
    assert (got["x"]["mape"], got["x"]["mse"], got["x"]["r2"]) == (0.25, 0.5, 0.5)
    assert got["flat"]["r2"] is None and math.isclose(got["flat"]["rmse"], math.sqrt(0.5))


def test_calibration_uses_slope_times_prediction(spark):
    df = spark.createDataFrame([(float(p), 2.0 * p + 1) for p in range(3)], "p double, y double")
    line = evaluate.fit_calibration(df, "y", "p")
    assert np.allclose(line, (2.0, 1.0))
    assert [r[0] for r in df.select(evaluate.calibrate(F.col("p"), line)).collect()] == [1.0, 3.0, 5.0]


# ---- vectors ---------------------------------------------------------------------

@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_equal_brute_force(spark, metric):
    """Small blocks and chunks, duplicate vectors, a hot cell, ties at rank k."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 5)), np.zeros((40, 5)), rng.normal(size=(40, 5)) + 20]).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(i)) for i, r in enumerate(x)], "i long, v array<double>, y double")
    got = vectors.nearest_neighbours(df, df, "i", "v", 4, "y", metric, exclude_self=True, pivots=8, block_rows=16, chunk_rows=32).toPandas()
    d = np.abs(x[:, None] - x[None]).sum(-1) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        mine = got[got["query"] == i].sort_values("rank")
        assert list(mine["neighbour"]) == [j for _, j in want], i
        assert np.allclose(mine["distance"], [a for a, _ in want])


def test_knn_regression_weights(spark):
    df = spark.createDataFrame([(1, [0.0], 10.0), (2, [1.0], 20.0), (3, [3.0], 40.0)], "i long, v array<double>, y double")
    q = spark.createDataFrame([(9, [0.0]), (8, [2.0])], "i long, v array<double>")
    got = rows(vectors.knn_regress(q, df, "i", "v", "y", 2, weights="distance"), "query")
    assert got == [(8, 30.0), (9, 10.0)]


def test_similarity_of_a_zero_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0])], "i int, v array<float>")
    dims = spark.createDataFrame([("pay", [1.0, 0.0]), ("zero", [0.0, 0.0])], "d string, v array<float>")
    assert rows(vectors.dimension_similarities(df, "v", dims, "d", "v", "sim_"), "i") == [(1, 0.0, 0.0), (2, 1.0, 0.0)]


# ---- incremental -----------------------------------------------------------------

def test_quarantine_null_rule_fails(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "i int, v double")
    good, bad = tables.quarantine(df, {"present": F.col("v").isNotNull(), "small": F.col("v") < 10})
    assert rows(good.select("i")) == [(1,)]
    assert rows(bad.select("i", "reason"), "i") == [(2, "present"), (3, "small")]


def test_csv_keeps_awkward_texts(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", "", None, " lead", "back\\slash\"", "a,b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert [r[1] for r in rows(tables.read_csv(spark, str(tmp_path / "c"), "i int, t string"), "i")] == texts


def test_folder_scan_test_mode_and_company(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"T{i}_reviews.csv").write_text(f"a,b\n{i},x\n")
    everything = tables.read_folder(spark, str(tmp_path), "a int, b string")
    few = tables.read_folder(spark, sorted(str(p) for p in tmp_path.glob("*.csv"))[:5], "a int, b string")
    assert everything.count() == 7
    assert [r[0] for r in rows(few.select(tables.company_from_file(F.col("file_name")).alias("c")), "c")] == [f"T{i}" for i in range(5)]


def test_replace_refuses_its_own_input(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.replace_table(spark.range(1), str(tmp_path), (str(tmp_path) + "/",))


def test_placing_by_many_centres_is_bounded_in_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    a, centres = rng.normal(size=(5_000, 8)), rng.normal(size=(4_096, 8))
    for metric in ("euclidean", "manhattan"):
        rows_ = a if metric == "euclidean" else a[:300]
        tracemalloc.start()
        cell, away = vectors._placing_function(metric)(rows_, centres)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20  # all distances at once take 164 MB
        d = np.abs(centres - rows_[7]).sum(1) if metric == "manhattan" else np.sqrt(((centres - rows_[7]) ** 2).sum(1))
        assert cell[7] == d.argmin() and math.isclose(away[7], d.min())


def test_neighbours_of_separate_places_meet_their_own_blocks_only(spark, monkeypatch):
    """Rows far apart in eight places of 40: after the first block no other is visited, so that each query hands on k rows."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)) + 1000 * g for g in range(8)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    sizes, kept = [], vectors.written
    monkeypatch.setattr(vectors, "written", lambda d, name: (lambda out: (sizes.append(out.count()), out)[1])(kept(d, name)))
    got = vectors.nearest_neighbours(df, df, "i", "v", 3, exclude_self=True, pivots=24, block_rows=64)
    assert got.count() == 960 and got.where("abs(query - neighbour) >= 40").count() == 0 and sizes == [320 * 4]
