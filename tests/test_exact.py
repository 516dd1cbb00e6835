"""Wrong inputs end in an error, never in another number."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sumtrail.functions import amount, net_price
from sumtrail.operators import join_totals
from sumtrail.sources import read_table


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def total(spark, rows):
    df = spark.createDataFrame(rows, "p double, d double")
    parts = [c.alias(n) for c, n in zip(net_price("p", "d"), ("u", "h", "l"), strict=True)]
    sums = df.select(*parts).agg(*[F.sum(c).alias(c) for c in ("u", "h", "l")])
    return sums.select(amount("u", "h", "l").cast("double")).first()[0]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1000.0, 0.075)], 925.0),
        ([(1000.0, 0.065)], 935.0),
        ([(0.004, 0.0)] * 1000, 4.0),
        ([(-12.34, 0.5)], -6.17),
        ([(None, 0.5), (2.0, 0.5)], 1.0),
        ([(1e14, 0.0)], 1e14),
    ],
)
def test_exact_sum(spark, ansi, rows, expected):
    assert total(spark, rows) == expected


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf"), 1e15, 0.00001, 1 / 3])
def test_other_values_are_errors(spark, ansi, value):
    with pytest.raises(PySparkException, match="p: not a decimal with 4 digits"):
        total(spark, [(value, 0.0), (5.0, 0.0)])


def test_discount_with_too_many_digits(spark, ansi):
    with pytest.raises(PySparkException, match="d: not a decimal with 6 digits"):
        total(spark, [(1.0, 1e-7)])


def test_totals_with_equal_key_names(spark):
    facts = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int")
    parent = spark.createDataFrame([(1, "a"), (3, "c")], "k int, name string")
    assert [tuple(r) for r in join_totals(facts, "k", parent, "k", ["v"]).collect()] == [(1, "a", 5)]


def test_totals_with_a_clashing_column(spark):
    facts = spark.createDataFrame([(1, 2)], "k int, v int")
    parent = spark.createDataFrame([(1, 9)], "id int, v int")
    with pytest.raises(ValueError, match="name of a total: v"):
        join_totals(facts, "k", parent, "id", ["v"])


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="no table 'events'; known are customer"):
        read_table(spark, "/root/testdata/sf0.001", "events")


@pytest.mark.parametrize("column, message", [("n_title", "no such column"), ("n_name", "string wanted, int found")])
def test_wrong_columns(spark, tmp_path, column, message):
    rows = spark.createDataFrame([(1, 2, 3)], f"n_nationkey int, {column} int, n_regionkey int")
    rows.write.parquet(str(tmp_path / "nation.parquet"))
    with pytest.raises(ValueError, match=f"n_name: .*{message}"):
        read_table(spark, str(tmp_path), "nation")
