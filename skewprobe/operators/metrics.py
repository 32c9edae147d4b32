"""Loads, imbalance, latency and throughput as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewprobe.operators.order import DIRECT_ROWS, null_safe_join, order_statistics
from skewprobe.session import stage

# Fixed value: the percentiles of a latency summary.
PERCENTILES = (95, 99)


def fill_loads(loads: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """One row per bucket of ``every``; a bucket without load counts 0."""
    values = [c for c in loads.columns if c != key]
    return every.select(key).distinct().join(loads, key, "left").fillna(0, values)


def load_by(
    df: DataFrame, key: str, every: DataFrame | None = None, value: str | None = None
) -> DataFrame:
    """Rows per key, or the sum of ``value``, zero-filled over ``every``."""
    amount = F.count("*") if value is None else F.sum(value)
    loads = df.groupBy(key).agg(amount.alias("load"))
    return loads if every is None else fill_loads(loads, every, key)


def imbalance(loads: DataFrame, value: str = "load", name: str = "imbalance") -> DataFrame:
    """Largest over mean load; 0 when there is no load."""
    mean = F.avg(value)
    ratio = F.when(mean > 0, F.max(value) / mean).otherwise(F.lit(0.0))
    return loads.agg(F.coalesce(ratio, F.lit(0.0)).alias(name))


def throughput(df: DataFrame, col: str) -> DataFrame:
    """Queries per second of summed time; 0 when no time was spent."""
    total = F.sum(col)
    rate = F.when(total > 0, F.count(col) / total).otherwise(F.lit(0.0))
    return df.agg(F.coalesce(rate, F.lit(0.0)).alias("qps"))


def latency_summary(
    df: DataFrame,
    col: str,
    by: str | None = None,
    percentiles: Sequence[float] = PERCENTILES,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """Count, mean, and percentiles with linear interpolation, optionally per group.

    The percentiles come from exact order statistics: the built-in exact
    percentile gathers all distinct values of a group in one task. Everything
    after the first aggregate has a few rows per group.
    """
    group = F.lit(0) if by is None else F.col(by)
    sizes = df.groupBy(group.alias("grp")).agg(
        F.count(col).alias("queries"), F.avg(col).alias("mean")
    )
    sizes = stage(sizes, "sizes")
    place = F.col("p") / 100 * (F.col("queries") - 1)
    places = sizes.select(
        "grp", "queries", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("p")
    ).select(
        "grp",
        "p",
        (place - F.floor(place)).alias("share"),
        (F.floor(place) + 1).alias("low"),
        F.least(F.floor(place) + 2, F.col("queries")).alias("high"),
    )
    targets = places.select("grp", F.explode(F.array("low", "high")).alias("rank"))
    largest = sizes.agg(F.max("queries")).first()[0] or 0
    found = order_statistics(df, F.col(col).cast("double"), targets, group, largest, direct=direct)
    found = stage(found, "percentiles")
    below = found.select("grp", F.col("rank").alias("low"), F.col("value").alias("v0"))
    above = found.select("grp", F.col("rank").alias("high"), F.col("value").alias("v1"))
    # Equal neighbours need no step: infinite ones have no difference.
    step = (F.col("v1") - F.col("v0")) * F.col("share")
    value = F.when((F.col("v0") == F.col("v1")) | (F.col("share") == 0), F.col("v0")).otherwise(
        F.col("v0") + step
    )
    placed = null_safe_join(places, below, ["grp", "low"])
    points = (
        null_safe_join(placed, above, ["grp", "high"])
        .groupBy("grp")
        .agg(
            *[
                F.max(F.when(F.col("p") == float(p), value)).alias(f"p{p:g}")
                for p in percentiles
            ]
        )
    )
    summary = null_safe_join(sizes, points, ["grp"], "left")
    return summary.drop("grp") if by is None else summary.withColumnRenamed("grp", by)


def _fact(metric: str, value: Column, bucket: Column | None = None) -> list[Column]:
    return [
        F.lit(metric).alias("metric"),
        (F.lit(-1) if bucket is None else bucket).cast("int").alias("bucket"),
        value.cast("double").alias("value"),
    ]


def report(facts: dict[str, tuple[DataFrame, str | None]], **tags: str) -> DataFrame:
    """Small aggregates stacked as ``metric, bucket, value`` with constant tags.

    Each fact is a table and the column that numbers its buckets, or None for a
    single figure; its value is the remaining column.
    """
    rows = []
    for metric, (table, bucket) in facts.items():
        value = next(c for c in table.columns if c != bucket)
        rows.append(
            table.select(*_fact(metric, F.col(value), F.col(bucket) if bucket else None))
        )
    stacked = reduce(DataFrame.unionByName, rows)
    return stacked.select(*[F.lit(v).alias(k) for k, v in tags.items()], "metric", "bucket", "value")


def preprocess_report(
    clean: DataFrame,
    base: DataFrame,
    query: DataFrame,
    uniform: DataFrame,
    skewed: DataFrame,
    files: int | None = None,
) -> DataFrame:
    """File count, clean rows, dimensions and set sizes, as ``metric, value``."""

    def fact(name: str, table: DataFrame, value: Column) -> DataFrame:
        return table.agg(value.cast("long").alias("value")).select(
            F.lit(name).alias("metric"), "value"
        )

    n_files = len(clean.inputFiles()) if files is None else files
    every = F.count("*")
    rows = [
        clean.sparkSession.createDataFrame([("files", n_files)], "metric string, value long"),
        fact("clean_rows", clean, every),
        fact("dims", base.limit(1), F.max(F.size("embedding"))),
        fact("base_vectors", base, every),
        fact("query_vectors", query, every),
        fact("uniform_queries", uniform, every),
        fact("skewed_queries", skewed, every),
    ]
    return reduce(DataFrame.unionByName, rows)
