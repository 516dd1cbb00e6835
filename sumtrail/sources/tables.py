from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns of the input tables.
SCHEMAS = {
    "lineitem": """
        l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz
    """,
    "orders": """
        o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string
    """,
    "customer": """
        c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string
    """,
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read ``<directory>/<name>.parquet``, either one file or a folder of part files.

    Raises ValueError for a table that is not known here, and for files that lack one of
    its columns or have it with another type. Other columns of the files are left out.
    """
    if name not in SCHEMAS:
        raise ValueError(f"no table {name!r}; known are {', '.join(sorted(SCHEMAS))}")
    found = spark.read.parquet(f"{directory}/{name}.parquet")
    types = dict(found.dtypes)
    wanted = [c.split() for c in SCHEMAS[name].split(",")]
    wrong = [f"{c}: {t} wanted, {types.get(c, 'no such column')} found" for c, t in wanted if types.get(c) != t]
    if wrong:
        raise ValueError(f"{directory}/{name}.parquet: {'; '.join(wrong)}")
    return found.select(*[c for c, _ in wanted])
