from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import amount, net_price
from sumtrail.operators import join_totals

TOTALS = ("units", "high", "low", "n_lines")


def nation_revenue(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    since: dt.date | None = None,
) -> DataFrame:
    """Net revenue and number of order lines per nation of the customer.

    With ``since``, only orders of that day or later count. Every table is added up
    before it is shuffled; nations are joined last, when there is a row for each.
    """
    if since is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(since))
    orders = orders.select("o_orderkey", "o_custkey")
    customer = customer.select("c_custkey", "c_nationkey")
    nation = nation.select("n_nationkey", "n_name")

    units, high, low = net_price("l_extendedprice", "l_discount")
    lines = lineitem.select(
        "l_orderkey",
        units.alias("units"),
        high.alias("high"),
        low.alias("low"),
        F.lit(1).cast("bigint").alias("n_lines"),
    )
    # No broadcast hints: Spark broadcasts a table only when its size is below
    # spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise.
    per_order = join_totals(lines, "l_orderkey", orders, "o_orderkey", TOTALS)
    per_customer = join_totals(per_order, "o_custkey", customer, "c_custkey", TOTALS)
    per_key = join_totals(per_customer, "c_nationkey", nation, "n_nationkey", TOTALS)
    per_name = per_key.groupBy("n_name").agg(*[F.sum(c).alias(c) for c in TOTALS])
    return per_name.select(
        "n_name",
        F.round(amount("units", "high", "low"), 2).cast("double").alias("revenue"),
        "n_lines",
    )
