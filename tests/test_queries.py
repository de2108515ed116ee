"""Every registered query of the library against its SQL twin, and the contract of the entry module."""


from pathlib import Path

import duckdb
import pytest
from compare import SF, TABLES, same

from rulewright import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    same(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_action_order_of_ties_and_nulls(spark, tmp_path):
    lines = """(1, 1, 5, 'R'), (1, 1, 5, 'N'), (2, 1, 5, 'N'), (2, 1, 5, 'R'), (3, NULL, 5, 'R'), (3, 2, 5, 'N'), (4, 1, NULL, 'R'), (4, 1, 7, 'N'),
        (5, 1, 1, 'N'), (5, 2, 1, NULL), (6, 1, 1, NULL), (7, 1, 1, NULL), (7, 2, 1, 'A'), (NULL, 1, 1, 'N'), (8, 2, 1, 'R'), (8, 1, 1, 'N')"""
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(Path(SF, f"{t}.parquet"))
    duckdb.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INT AS l_linenumber, l_partkey::BIGINT AS l_partkey, l_returnflag, 'O' AS l_linestatus FROM (VALUES {lines}) AS t(l_orderkey, l_linenumber, l_partkey, l_returnflag)) TO '{tmp_path}/lineitem.parquet'")
    assert same(plans.QUERIES["action_order"](spark, str(tmp_path)), plans.ORACLES["action_order"], str(tmp_path)) == 9
