"""Base/query split and query workloads.

Every sample is "the first rows in a seeded random order of ids". The last key
that still belongs to it is found by order statistics; taking the sample
is then a filter on the key, so no vector is ever shuffled and a class that
holds most rows costs no more than a small one. Samples have exactly the size asked for, also where
rows share an id or have none: of the rows that tie at the end, as many are taken as fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.functions.keys import HOT_PATTERNS, SEED, is_hot, order_key
from skewprobe.operators.order import mark_first
from skewprobe.session import stage

# Share of queries, workload size, hot share of a skewed workload.
QUERY_FRACTION = 0.1
WORKLOAD_SIZE = 5000
SKEW_RATIO = 0.8


def label_quotas(counts: DataFrame, total: int, wanted: int) -> DataFrame:
    """Share ``wanted`` rows over the labels in proportion, by largest remainder.

    ``counts`` has ``label`` and ``n``. Ties between remainders go by label. The
    window runs over one row per label.
    """
    # Decimals, since rows times rows does not fit a long at full size.
    product = f"cast(n as decimal(19,0)) * cast({wanted} as decimal(19,0))"
    shares = counts.select(
        "label",
        F.expr(f"{product} div {total}").alias("base"),
        F.expr(f"{product} % {total}").alias("rest"),
    )
    left = F.lit(wanted) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "label"))
    return shares.select("label", (F.col("base") + (place <= left).cast("long")).alias("quota"))


def split_roles(
    df: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    fraction: float = QUERY_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """Add ``role``, ``base`` or ``query``, keeping the label proportions; null is a label too.

    A map over ``df``: join with one row per label, compare keys. Of each label the query set has
    exactly its quota.
    """
    counts = stage(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), "labels")
    total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    quotas = label_quotas(counts, total, math.ceil(fraction * total))
    targets = quotas.select(F.col("label").alias("grp"), F.col("quota").alias("rank"))
    marked = mark_first(df, order_key(id, seed), targets, F.col(label), largest, "__first")
    role = F.when(F.col("__first"), "query").otherwise("base")
    return marked.withColumn("role", role).drop("__first")


def stratified_split(
    df: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    fraction: float = QUERY_FRACTION,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Base and query rows of :func:`split_roles`, as two filters over ``df``."""
    roles = split_roles(df, id, label, fraction, seed)
    return roles.where("role = 'base'").drop("role"), roles.where("role = 'query'").drop("role")


def uniform_sample(
    df: DataFrame, id: str = "vec_id", size: int = WORKLOAD_SIZE, seed: int = SEED
) -> DataFrame:
    """``min(size, n)`` rows without replacement.

    Not a sort with a limit: that sends ``size`` rows of every task to one task.
    """
    if size <= 0:
        return df.where(F.lit(False))
    rows = df.count()
    if rows <= size:
        return df
    targets = df.sparkSession.range(1).select(
        F.lit(0).alias("grp"), F.lit(size).cast("long").alias("rank")
    )
    marked = mark_first(df, order_key(id, seed), targets, largest=rows, name="__first")
    return marked.where("__first").drop("__first")


def sample_per_group(
    df: DataFrame, group: str, id: str = "vec_id", size: int = 1000, seed: int = SEED
) -> DataFrame:
    """``min(size, n)`` rows of every group, without replacement."""
    counts = stage(df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n")), "groups")
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest <= size:
        return df
    targets = counts.select("grp", F.lit(size).cast("long").alias("rank"))
    marked = mark_first(df, order_key(id, seed), targets, F.col(group), largest, "__first")
    return marked.where("__first").drop("__first")


def skewed_sample(
    df: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    size: int = WORKLOAD_SIZE,
    ratio: float = SKEW_RATIO,
    patterns: Sequence[str] = HOT_PATTERNS,
    seed: int = SEED,
) -> DataFrame:
    """A workload in which ``ratio`` of the rows carry a hot label.

    Cold rows fill up for missing hot ones, not the other way round. Adds the
    column ``hot``.
    """
    marked = df.withColumn("hot", is_hot(label, patterns))
    sizes = marked.agg(
        F.count_if("hot").alias("hot"), F.count_if(~F.col("hot")).alias("cold")
    ).first()
    if not sizes["hot"] or not sizes["cold"]:
        raise ValueError("a skewed workload needs both hot and cold rows")
    total = min(size, sizes["hot"] + sizes["cold"])
    n_hot = min(int(total * ratio), sizes["hot"])
    n_cold = min(total - n_hot, sizes["cold"])

    targets = df.sparkSession.createDataFrame(
        [(True, n_hot), (False, n_cold)], "grp boolean, rank long"
    )
    largest = max(sizes["hot"], sizes["cold"])
    first = mark_first(marked, order_key(id, seed), targets, F.col("hot"), largest, "__first")
    return first.where("__first").drop("__first")
