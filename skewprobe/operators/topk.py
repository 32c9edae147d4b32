"""Ranking of hits that a scan has already reduced to ``k`` per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: hits per query.
TOP_K = 10


def topk(scored: DataFrame, keys: Sequence[str] = ("q_id",), k: int = TOP_K) -> DataFrame:
    """The ``k`` best rows per key: highest score first, ties to the lowest ``vec_id``.

    Catalyst limits each group before and after the shuffle. Adds the rank ``rk``.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def kth_threshold(
    scored: DataFrame, keys: Sequence[str] = ("q_id",), k: int = TOP_K, strict: bool = False
) -> DataFrame:
    """The k-th largest score per key, as ``thr``.

    With fewer than ``k`` rows it is the least of them; ``strict`` gives minus
    infinity instead, since nothing can then be ruled out.
    """
    thr = F.min("score")
    if strict:
        thr = F.when(F.count("*") >= k, thr).otherwise(F.lit(float("-inf")))
    return topk(scored, keys, k).groupBy(*keys).agg(thr.alias("thr"))
