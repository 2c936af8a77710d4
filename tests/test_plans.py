"""Plan shapes that must hold at any scale."""

import pathlib
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
PLANNED = [n for n, f in sorted(QUERIES.items()) if f.__module__.startswith("reviewloom.plans.") and not f.__module__.endswith((".models", ".streams"))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(QUERIES["one_company"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_texts_stay_at_the_scan(spark):
    """The dedup key table has no text column, so no shuffle carries one."""
    text = plan(QUERIES["review_merge_dedup"](spark, SF))
    assert not re.search(r"\btext#", text)


def test_top_words_are_cut_before_the_shuffle(spark):
    assert plan(QUERIES["keyword_topn_by_class"](spark, SF)).count("WindowGroupLimit") == 2


def test_keep_first_combines_on_the_map_side(spark):
    from reviewloom.operators.dedup import keep_first

    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    text = plan(keep_first(df, "k", ["id"]))
    assert "partial_min_by" in text and "Window" not in text


def test_tasks_do_not_need_the_package(spark, tmp_path):
    """Python tasks get their functions by value: a session started elsewhere runs them."""
    repo = str(pathlib.Path(entry.__file__).resolve().parent)
    script = f"""
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from tests.compare import session
s = session(2)
for n in ("knn_regress", "dimension_similarity", "csv_ranges", "pca_groups", "row_features", "entity_presence"):
    assert e.queries()[n](s, {SF!r}).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
