"""nation_revenue against a plain Python join over small hand-made tables."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sumtrail.plans import nation_revenue
from sumtrail.sources import read_table

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}
DAY = dt.datetime(1998, 1, 1)


def frames(spark, tables):
    return [spark.createDataFrame(tables[t], SCHEMAS[t]) for t in SCHEMAS]


def run(spark, tables, since=None):
    df = nation_revenue(*frames(spark, tables), since=since)
    return {r["n_name"]: (r["revenue"], r["n_lines"]) for r in df.collect()}


def brute_force(tables, since=None):
    out = defaultdict(lambda: [None, 0])
    for lk, price, discount in tables["lineitem"]:
        for ok, ock, day in tables["orders"]:
            if lk is None or lk != ok or (since and (day is None or day.date() < since)):
                continue
            for ck, cn in tables["customer"]:
                if ock is None or ock != ck:
                    continue
                for nk, name in tables["nation"]:
                    if cn is None or cn != nk:
                        continue
                    acc = out[name]
                    acc[1] += 1
                    if price is not None and discount is not None:
                        net = Decimal(str(price)) * (1 - Decimal(str(discount)))
                        acc[0] = net if acc[0] is None else acc[0] + net
    cents = Decimal("0.01")
    return {
        name: (None if s is None else float(s.quantize(cents, ROUND_HALF_UP)), n)
        for name, (s, n) in out.items()
    }


def small(**changes):
    tables = {
        "lineitem": [(1, 100.0, 0.1), (1, 50.05, 0.0), (2, 10.01, 0.05), (3, 7.0, 0.5)],
        "orders": [(1, 10, DAY), (2, 11, DAY), (3, 12, DAY - dt.timedelta(days=1))],
        "customer": [(10, 0), (11, 1), (12, 0)],
        "nation": [(0, "PERU"), (1, "CHAD"), (2, "FIJI")],
    }
    return tables | changes


CASES = {
    "plain": {},
    "no lines": {"lineitem": []},
    "no nation": {"nation": []},
    "unknown keys": {
        "lineitem": [(1, 1.0, 0.0), (99, 2.0, 0.0)],
        "orders": [(1, 10, DAY), (2, 99, DAY)],
        "customer": [(10, 0), (11, 77)],
    },
    "null keys": {
        "lineitem": [(None, 1.0, 0.0), (1, 2.0, 0.0), (2, 4.0, 0.0), (3, 8.0, 0.0)],
        "orders": [(None, 10, DAY), (1, None, DAY), (2, 11, DAY), (3, 10, None)],
        "customer": [(None, 0), (10, None), (11, 1)],
    },
    "null money": {"lineitem": [(1, None, 0.1), (2, 3.0, None), (2, 3.0, 0.0), (3, 5.0, 0.0)]},
    "only null money": {"lineitem": [(2, None, 0.1), (2, 3.0, None)]},
    "repeated order key": {"orders": [(1, 10, DAY), (1, 11, DAY), (1, 11, DAY)]},
    "repeated customer key": {"customer": [(10, 0), (10, 1), (10, 1)]},
    "two nations of one name": {"nation": [(0, "PERU"), (1, "PERU")]},
    "null name": {"nation": [(0, None), (1, "CHAD")]},
    "ends in half a cent": {"lineitem": [(1, 0.1, 0.05), (2, 0.3, 0.05), (2, -0.6, 0.05)]},
    "returns": {"lineitem": [(1, -20.0, 0.1), (1, 20.0, 0.1)]},
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("since", [None, DAY.date()])
def test_against_brute_force(spark, case, since):
    tables = small(**CASES[case])
    assert run(spark, tables, since) == brute_force(tables, since)


@pytest.mark.parametrize("case", CASES)
def test_shuffled_joins_against_brute_force(spark, shuffled_joins, case):
    tables = small(**CASES[case])
    assert run(spark, tables) == brute_force(tables)


def key(top):
    return st.one_of(st.none(), st.integers(0, top))


cents = st.integers(-10_000_00, 10_000_00).map(lambda n: n / 100)
rates = st.integers(0, 100).map(lambda n: n / 100)
days = st.sampled_from([DAY - dt.timedelta(seconds=1), DAY, DAY + dt.timedelta(days=400)])
any_tables = st.fixed_dictionaries(
    {
        "lineitem": st.lists(st.tuples(key(4), st.none() | cents, st.none() | rates), max_size=25),
        "orders": st.lists(st.tuples(key(4), key(3), days), max_size=8),
        "customer": st.lists(st.tuples(key(3), key(2)), max_size=6),
        "nation": st.lists(st.tuples(key(2), st.sampled_from(["A", "B"])), max_size=4),
    }
)


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(tables=any_tables, since=st.sampled_from([None, DAY.date()]))
def test_any_tables_against_brute_force(spark, tables, since):
    assert run(spark, tables, since) == brute_force(tables, since)


def test_one_order_with_a_third_of_the_lines(spark, shuffled_joins):
    lines = spark.range(300_000).selectExpr(
        "IF(id % 3 = 0, 0, id) AS l_orderkey",
        "CAST(id % 997 AS double) / 100 AS l_extendedprice",
        "CAST(id % 11 AS double) / 100 AS l_discount",
    )
    orders = spark.range(300_000).selectExpr(
        "id AS o_orderkey", "IF(id % 3 = 1, 1, id) AS o_custkey", "NULL AS o_orderdate"
    )
    customer = spark.range(300_000).selectExpr(
        "id AS c_custkey", "CAST(IF(id % 3 = 2, 2, id % 5) AS int) AS c_nationkey"
    )
    nation = spark.range(5).selectExpr("CAST(id AS int) AS n_nationkey", "'N' || id AS n_name")
    got = {r[0]: (r[1], r[2]) for r in nation_revenue(lines, orders, customer, nation).collect()}

    units, n_lines = defaultdict(int), defaultdict(int)
    for i in range(300_000):
        order = 0 if i % 3 == 0 else i
        cust = 1 if order % 3 == 1 else order
        name = f"N{2 if cust % 3 == 2 else cust % 5}"
        units[name] += (i % 997) * (100 - i % 11)
        n_lines[name] += 1
    expected = {
        n: (float((Decimal(u) / 10_000).quantize(Decimal("0.01"), ROUND_HALF_UP)), n_lines[n])
        for n, u in units.items()
    }
    assert got == expected


def test_other_columns_do_not_matter(spark):
    tables = frames(spark, small())
    wider = [t.selectExpr("*", "1 AS units", "2 AS parts", "3 AS n_lines") for t in tables]
    assert sorted(nation_revenue(*wider).collect()) == sorted(nation_revenue(*tables).collect())


def test_totals_beyond_a_bigint(spark):
    lines = spark.range(2_000).selectExpr(
        "1L AS l_orderkey", "9e11D AS l_extendedprice", "0D AS l_discount"
    )
    _, *others = frames(spark, small())
    (row,) = nation_revenue(lines, *others).collect()
    assert tuple(row) == ("PERU", 1.8e15, 2_000)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_result_does_not_depend_on_partitioning(spark, parts):
    tables = [
        read_table(spark, "/root/testdata/sf0.01", t)
        for t in ("lineitem", "orders", "customer", "nation")
    ]
    expected = sorted(nation_revenue(*tables).collect())
    shuffled = [t.repartition(parts) for t in tables]
    assert sorted(nation_revenue(*shuffled).collect()) == expected


@pytest.mark.parametrize(
    "setting, value",
    [("spark.sql.ansi.enabled", "false"), ("spark.sql.session.timeZone", "Pacific/Auckland")],
)
def test_result_does_not_depend_on_session_settings(spark, setting, value):
    tables = small(**CASES["ends in half a cent"])
    since = DAY.date()
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        assert run(spark, tables, since) == brute_force(tables, since)
    finally:
        spark.conf.set(setting, before)


def test_since_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    tables = [read_table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation")]
    got = sorted(map(tuple, nation_revenue(*tables, since=dt.date(1998, 1, 1)).collect()))
    expected = duckdb.sql(
        f"""
        SELECT n_name,
               CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2))
                              * (1 - CAST(l_discount AS DECIMAL(3, 2)))), 2) AS DOUBLE) AS revenue,
               count(*) AS n_lines
        FROM '{folder}/lineitem.parquet'
        JOIN '{folder}/orders.parquet' ON l_orderkey = o_orderkey
        JOIN '{folder}/customer.parquet' ON o_custkey = c_custkey
        JOIN '{folder}/nation.parquet' ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1998-01-01'
        GROUP BY n_name
        """
    ).fetchall()
    assert got == sorted(expected)


def test_money_columns_hold_hundredths():
    """net_price is exact only for such columns."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        (worst,) = duckdb.sql(
            f"""
            SELECT max(greatest(abs(l_extendedprice - round(l_extendedprice, 2)),
                                abs(l_discount - round(l_discount, 2))))
            FROM '/root/testdata/{sf}/lineitem.parquet'
            """
        ).fetchall()[0]
        assert worst == 0
