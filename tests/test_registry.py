import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from clickpath.plans.oracles import ORACLES
from clickpath.plans.queries import REGISTRY
from conftest import SF

TABLES = "customer supplier part orders lineitem events embeddings".split()
# a cross-section; the driver compares every key
COMPARED = ["session_summary", "user_histories", "users_without_rare_domains", "sessions_bounded", "collapse_runs",
            "run_keyword_mean", "item_knn", "session_popular_scores", "session_vector_scores", "eval_knn",
            "eval_by_position", "loss_bpr_max", "training_examples", "vector_ranks_with_ties", "sessionize_split",
            "loss_bpr_max_dense", "loss_cross_entropy_dense", "eval_factors", "vector_block_share", "pipeline_sessions",
            "histories_roundtrip", "dictionary_roundtrip", "scan_partitioned_week"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


#: Learned by iteration; tested on planted patterns.
WITHOUT_SQL = {"eval_als"}


def test_keys():
    assert set(REGISTRY) - set(ORACLES) == WITHOUT_SQL
    assert set(REGISTRY) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_optional_queries_may_not_import():
    """Without a package that only they need, the other queries are still there."""
    code = """
import sys
sys.modules['xxhash'] = None
import __spark_entry__ as driver
assert set(driver.queries()) == set(driver.REGISTRY), sorted(driver.queries())
assert set(driver.oracle_sql()) == set(driver.ORACLES)
"""
    home = os.path.dirname(os.path.abspath(driver.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=home, check=True)


def test_entry(spark):
    assert driver.entry(spark).count() == 585


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql_runs(duck, key):
    assert duck.sql(driver.oracle_sql()[key]).fetchall()


@pytest.mark.parametrize("key", COMPARED)
def test_query_equals_sql(spark, duck, key):
    expected = duck.sql(driver.oracle_sql()[key])
    found = driver.queries()[key](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in found.columns]
    want = sorted(tuple(repr(row[i]) for i in order) for row in expected.fetchall())
    assert sorted(tuple(map(repr, row)) for row in found.collect()) == want
