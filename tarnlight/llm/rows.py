"""Rows written twice, each once, without moving the rows that stand alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.session import cut

#: Repeated keys up to which their list is broadcast.
MOST_REPEATED = 500_000


def each_once(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over the rows, of those with the same key only one; rows with a null key all stay.

    Only the keys are grouped. Rows whose key occurs once go to ``work`` where they are read; the few others are reduced
    first. If there are more than ``MOST_REPEATED`` repeated keys the join is left to Spark instead of being a broadcast.
    """
    repeated = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    some = repeated.limit(MOST_REPEATED + 1).count()
    if not some:
        return work(df)
    known = F.broadcast(repeated) if some <= MOST_REPEATED else repeated
    return work(df.join(known, key, "left_anti")).union(work(df.join(known, key, "left_semi").dropDuplicates([key])))
