from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_totals(
    facts: DataFrame, key: str, parent: DataFrame, parent_key: str, totals: Sequence[str]
) -> DataFrame:
    """Add up ``totals`` per ``key``, then inner-join the sums to ``parent``.

    The result has the columns of ``parent``, then the totals. Gives the same sums as
    joining first. Adding up first means a task sends at most one row per key into the
    shuffle, however many rows a hot key has, and the join reuses the partitioning of the
    aggregation.
    """
    if clashing := sorted(set(totals) & set(parent.columns)):
        raise ValueError(f"columns of the parent with the name of a total: {', '.join(clashing)}")
    own = "__key"
    summed = facts.groupBy(F.col(key).alias(own)).agg(*[F.sum(c).alias(c) for c in totals])
    return summed.join(parent, F.col(own) == F.col(parent_key)).select(*parent.columns, *totals)
