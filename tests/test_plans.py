"""What Spark plans for nation_revenue."""

import datetime as dt
import io
import re
from contextlib import redirect_stdout

import pytest

from sumtrail.plans import nation_revenue
from sumtrail.sources import read_table


TABLES = ("lineitem", "orders", "customer", "nation")


def explain(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def plan(spark, since=None):
    tables = [read_table(spark, "/root/testdata/sf0.01", t) for t in TABLES]
    return explain(nation_revenue(*tables, since=since))


@pytest.fixture
def large_tables(spark, shuffled_joins):
    return plan(spark, since=dt.date(1998, 1, 1))


def test_scans_read_only_the_needed_columns(large_tables):
    schemas = re.findall(r"ReadSchema: struct<(.*)>", large_tables)
    columns = [re.findall(r"(\w+):", s) for s in schemas]
    assert sorted(columns) == [
        ["c_custkey", "c_nationkey"],
        ["l_orderkey", "l_extendedprice", "l_discount"],
        ["n_nationkey", "n_name"],
        ["o_orderkey", "o_custkey", "o_orderdate"],
    ]


def test_date_filter_reaches_the_scan(large_tables):
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in large_tables


def test_each_table_is_shuffled_once_per_key(large_tables):
    keys = re.findall(r"Arguments: hashpartitioning\((\w+)#", large_tables)
    assert sorted(keys) == [
        "c_custkey",
        "c_nationkey",
        "l_orderkey",
        "n_name",
        "n_nationkey",
        "o_custkey",
        "o_orderkey",
    ]


def test_only_sums_are_shuffled_by_nation(large_tables):
    (exchange,) = re.findall(
        r"Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\(c_nationkey", large_tables
    )
    assert "sum#" in exchange


def test_lines_are_summed_before_their_shuffle(large_tables):
    (exchange,) = re.findall(
        r"Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\(l_orderkey", large_tables
    )
    assert "sum#" in exchange
    assert "l_extendedprice" not in exchange


def test_no_broadcast_beyond_the_threshold(large_tables):
    assert "Broadcast" not in large_tables
    assert "Cartesian" not in large_tables
    assert large_tables.count("SortMergeJoin Inner") == 3


def test_small_tables_are_broadcast(spark):
    assert "SortMergeJoin" not in plan(spark)


def test_bucketed_tables_are_not_shuffled_for_their_join(spark, shuffled_joins, tmp_path):
    buckets = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    tables = []
    try:
        for t in TABLES:
            df = read_table(spark, "/root/testdata/sf0.01", t)
            if t in buckets:
                writer = df.write.bucketBy(8, buckets[t]).sortBy(buckets[t])
                writer.option("path", str(tmp_path / t)).saveAsTable(f"bucketed_{t}")
                df = spark.table(f"bucketed_{t}")
            tables.append(df)
        df = nation_revenue(*tables)
        keys = re.findall(r"Arguments: hashpartitioning\((\w+)#", explain(df))
        assert "o_custkey" in keys
        assert not {"l_orderkey", "o_orderkey"} & set(keys)
        plain = nation_revenue(*[read_table(spark, "/root/testdata/sf0.01", t) for t in TABLES])
        assert sorted(df.collect()) == sorted(plain.collect())
    finally:
        for t in buckets:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{t}")
