"""Exact order statistics without sorting the table.

A global ``row_number`` or ``ntile`` runs in one task, and one per label does so
for a dominant label. Here each pass counts rows in the bins of a histogram,
combined on the map side, and narrows every wanted rank to one bin. Only the bin
counts are shuffled, and the passes read just the group and the value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.session import stage

BINS = 1 << 12
# A group of at most this many (group, value) rows is ranked by one sort.
DIRECT_ROWS = 1 << 20


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on columns of the same names in which null is a value like any other."""
    other = {key: f"__right_{key}" for key in keys}
    on = [F.col(key).eqNullSafe(F.col(name)) for key, name in other.items()]
    joined = left.join(right.withColumnsRenamed(other), reduce(Column.__and__, on), how)
    return joined.drop(*other.values())


def order_statistics(
    df: DataFrame,
    value: Column,
    targets: DataFrame,
    group: Column | None = None,
    largest: int | None = None,
    bins: int = BINS,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """The value at each wanted rank, counting from 1 in ascending order.

    ``targets`` has ``grp`` and ``rank``; the result adds ``value`` and how many rows of the
    group are ``below`` it and ``tied`` with it, itself included. ``grp`` is
    compared with ``group``, null with null, or is 0 when no group is given. A
    rank beyond the rows of its group, or below 1, has no result row. Null values
    have no rank; infinite ones come first and last, NaN after all. ``largest`` is
    the row count of the largest group, counted here when not known: if it is
    small, the groups are simply ranked.
    """
    group = F.lit(0) if group is None else group
    rows = df.select(group.alias("grp"), value.alias("v")).where("v is not null")
    wanted = targets.select("grp", F.col("rank").cast("long")).where("rank >= 1").distinct()
    if largest is None:
        largest = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    if largest <= direct:
        by_value = Window.partitionBy("grp").orderBy("v")
        ranked = rows.select(
            "*",
            F.row_number().over(by_value).cast("long").alias("rank"),
            (F.rank().over(by_value) - 1).cast("long").alias("below"),
            F.count("*").over(Window.partitionBy("grp", "v")).alias("tied"),
        )
        joined = null_safe_join(ranked, wanted, ["grp", "rank"])
        return joined.select("grp", "rank", F.col("v").alias("value"), "below", "tied")

    # Values that no bin width fits are kinds of their own, each with one value.
    v = F.col("v").cast("double")
    infinite = v.isin(float("inf"), float("-inf"))
    kind = F.when(F.isnan(v), 2).when(infinite, F.signum(v).cast("int")).otherwise(0)
    kinds = rows.groupBy("grp", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    # At most four rows per window.
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("kind"))
    spans = kinds.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
    start = null_safe_join(wanted, spans, ["grp"]).where("rank > below and rank <= upto")
    pending = stage(start.select("grp", "rank", "lo", "hi", "below", "n"), "ranks")
    # NaN equals NaN here, as in any comparison of the engine.
    found = [pending.where("lo = hi")]
    pending = pending.where("lo < hi")
    finite = rows.where(kind == 0)
    while not pending.isEmpty():
        pending = stage(_narrow(finite, pending, bins), "ranks")
        found.append(pending.where("lo = hi"))
        pending = pending.where("lo < hi")
    done = reduce(DataFrame.unionByName, found)
    # A range of one value holds all rows of that value.
    return done.select("grp", "rank", F.col("lo").alias("value"), "below", F.col("n").alias("tied"))


def _narrow(rows: DataFrame, pending: DataFrame, width: int) -> DataFrame:
    """Replace the range of each rank by the one histogram bin that holds it.

    The ends of a range fall into different bins, so every pass narrows it.
    """
    ranges = pending.select(F.col("grp").alias("of"), "lo", "hi", "below").distinct()
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    share = (v - lo).cast("double") / (hi - lo)
    if dict(rows.dtypes)["v"] in ("double", "float"):
        # The distance of the ends may exceed the largest number.
        halves = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
        share = F.when(hi - lo == float("inf"), halves).otherwise(share)
    bins = (
        rows.join(ranges, F.col("grp").eqNullSafe(F.col("of")) & v.between(lo, hi))
        .groupBy("of", "lo", "hi", "below", F.floor(share * width).alias("bin"))
        .agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        .withColumnRenamed("of", "grp")
    )
    # At most width + 1 rows per window, whatever the size of the group.
    so_far = Window.partitionBy("grp", "lo", "hi").orderBy("bin")
    counted = bins.withColumn("upto", F.col("below") + F.sum("n").over(so_far)).drop("below")
    return (
        null_safe_join(pending.drop("below", "n"), counted, ["grp", "lo", "hi"])
        .where("rank > upto - n and rank <= upto")
        .select(
            "grp",
            "rank",
            F.col("first").alias("lo"),
            F.col("last").alias("hi"),
            (F.col("upto") - F.col("n")).alias("below"),
            "n",
        )
    )


def numbered(df: DataFrame, groups: Sequence[str] = (), name: str = "number") -> DataFrame:
    """``df``, written, with the column ``name``: a number from 1 among the rows of a group.

    The rows are numbered where they were written, task by task, and the rows of the earlier
    tasks are added, so no task holds a whole group. Null is a group like any other.
    """
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    # The upper bits are those of the task that wrote the row.
    rows = rows.withColumn("__task", F.shiftright("__row", 33))
    keys = [*groups, "__task"]
    counts = stage(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "numbered-counts")
    earlier = Window.partitionBy(*groups).orderBy("__task")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    starts = counts.select(*keys, before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("__row"))
    joined = null_safe_join(rows.withColumn("__inside", inside), starts, keys)
    joined = joined.withColumn(name, F.col("__before") + F.col("__inside"))
    return joined.drop("__row", "__task", "__inside", "__before")


def mark_first(
    df: DataFrame,
    key: Column,
    targets: DataFrame,
    group: Column | None = None,
    largest: int | None = None,
    name: str = "first",
) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first of its group in the order of ``key``.

    ``targets`` has ``grp`` and ``rank``, the number of rows wanted; a group without a row there, or
    with a rank below 1, has none, one with fewer rows has all of them. ``key`` must
    not be null. Exactly so many rows are marked: where only some of the rows with the last key
    fit, these are numbered. Otherwise this is a map over ``df``, joined with one row per group.
    """
    found = order_statistics(df, key, targets, group, largest)
    cuts = null_safe_join(targets.select("grp", "rank").distinct(), found, ["grp", "rank"], "left")
    cuts = stage(
        cuts.select(
            F.col("grp").alias("__grp"),
            F.col("rank").alias("__rank"),
            F.col("value").alias("__cut"),
            # Of the rows at the cut so many fit, where not all do.
            F.when(F.col("rank") - F.col("below") < F.col("tied"), F.col("rank") - F.col("below")).alias("__fit"),
        ),
        "cuts",
    )
    of = F.lit(0) if group is None else group
    joined = df.withColumn("__key", key).join(cuts, of.eqNullSafe(F.col("__grp")), "left")
    wanted = F.coalesce(F.col("__rank") >= 1, F.lit(False))
    within = wanted & F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(True))
    helpers = ("__key", "__grp", "__rank", "__cut", "__fit")
    if cuts.where("__fit is not null").isEmpty():
        return joined.withColumn(name, within).drop(*helpers)
    tied = F.col("__fit").isNotNull() & (F.col("__key") == F.col("__cut"))
    some = numbered(joined.where(tied), ["__grp"], "__number")
    some = some.withColumn(name, F.col("__number") <= F.col("__fit")).drop("__number")
    rest = joined.where(~F.coalesce(tied, F.lit(False))).withColumn(name, within)
    return rest.unionByName(some).drop(*helpers)
