"""Every registered job against its SQL, and one check of the check itself."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from textwarden.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_matches_sql(spark, con, tiny, name):
    ok, note = compare(spark, con, tiny, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_every_job_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_a_changed_row_is_noticed(spark, con, tiny):
    def flipped(spark, sf_dir):
        rows = queries()["gate_docs"](spark, sf_dir)
        return rows.withColumn(
            "blocked", F.when(F.col("doc_id") == 7, ~F.col("blocked")).otherwise(F.col("blocked"))
        )

    ok, _ = compare(spark, con, tiny, "flipped", flipped, oracle_sql()["gate_docs"])
    assert not ok


def test_entry(spark):
    assert entry(spark).count() > 0
