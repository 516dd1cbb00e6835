"""Splitting a table into ranges of a key, in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_number(docs: DataFrame, key: str, n: int | None = None) -> Column:
    """The number, from 0, of the range of ``key`` that a row belongs to.

    There are at most ``n`` ranges (by default as many as shuffle partitions) with about
    as many rows each; what reaches the driver are their bounds.
    """
    n = n or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [k / n for k in range(1, n)] or [0.5]
    bounds = docs.agg(F.percentile_approx(key, at, 10_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def number(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(bounds, k.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    return number(F.col(key))


def by_range(rows: DataFrame, n: int, column: str = "range") -> DataFrame:
    """``rows`` in ``n`` partitions, one for each of the range numbers 0 to ``n - 1``.

    Hashing the numbers themselves would put several into one partition; each is replaced
    by the least integer whose hash falls into the partition of that number.
    """
    spark = rows.sparkSession
    own = spark.range(20 * n + 1000).select(F.col("id").cast("int").alias("k"))
    found = own.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    key = {r["p"]: r["k"] for r in found}
    keys = F.array(*[F.lit(key.get(p, p)) for p in range(n)])
    return rows.withColumn("__key", keys[F.col(column)]).repartition(n, "__key").drop("__key")
