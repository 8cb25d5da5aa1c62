"""Every registered query against its SQL on the smallest tables; sinks read back; plan shape of the hot paths."""

import os
import re

import pytest

import __spark_entry__ as entry
import check
from mirrorledger.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(oracle.sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module", autouse=True)
def default_engine(spark):
    """Queries run as users run them, with whole-stage code generation."""
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", before)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    problem, rows = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_inventory_scan_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["preset_filter"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("mtime" not in s and "n_chars" not in s for s in schemas)


def test_fingerprints_are_computed_in_the_scan_stage(spark):
    assert "Exchange" not in _plan(entry.queries()["fingerprint_full"](spark, SF))


def test_matching_shuffles_no_content_and_uses_no_cross_join(spark):
    plan = _plan(entry.queries()["match_full"](spark, SF))
    assert "content" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
