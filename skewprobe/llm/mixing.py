"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. A target of r times the words a source has
means floor(r) certain copies of each of its documents and, for the rest, a
sample of fixed size (in words) drawn in Pareto order: documents are ranked by
the odds of a random number over the odds of their inclusion, and taken from the
front until the rest of the target is met.

Only DataFrame functions; a source is never brought into one task: the rank order
is first counted in bins, and only the documents of the one bin in which the
target falls are ranked one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.llm.common import replaced, word_count
from skewprobe.operators.order import numbered
from skewprobe.session import stage

# No document is taken more than so many times.
MOST = 3
# Bins of the rank order of each source.
BINS = 1 << 12
# 52 bits of a digest, as many as a double holds exactly.
DIGITS, STEPS = 13, float(1 << 52)


def cycle_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sizes`` (a row per source) with ``weight``: the given ones in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    return sizes.withColumn("weight", turn)


def targets(sizes: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """``source, source_size, weight`` with ``target``, the words to take.

    The targets share ``share`` of all words by weight. None is above ``most``
    times its source; what is cut off there is shared by the others by weight,
    until none is above. Sources fill up in the order of size over weight, so one
    running sum over the source rows finds the level. A weight that is null or
    not positive counts as zero.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    cap = F.col("source_size") * most
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    total = Window.partitionBy()
    full = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    rows = rows.withColumn("full", full).withColumn(
        "wanted", F.sum("source_size").over(total) * F.lit(share)
    )
    # Before a source fills up, those ahead of it are full and the others stand
    # at the same level: wanted words less the full ones, over the weight left.
    before = Window.orderBy(F.col("full").asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    done = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(left > 0, (F.col("wanted") - done) / left)
    rows = rows.withColumn("level", level)
    # The first source that does not fill up sets the level of all after it.
    open_level = F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "source", "level"))).over(total)
    rows = rows.withColumn("at", open_level["level"])
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(
        F.col("at").isNull() | (F.col("full") <= F.col("at")), F.col("cap").cast("double")
    ).otherwise(F.col("weight") * F.col("at"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def random_unit(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    bits = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(STEPS)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | DataFrame,
    share: float = 1.0,
    most: int = MOST,
    seed: int = 0,
    prefer: Column | None = None,
    bins: int = BINS,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. ``weights`` are given in
    turn to the sources in code point order, or as a table of ``source, weight``
    (a source without a row weighs nothing). ``prefer`` (a positive column, for
    example a quality) multiplies the inclusion odds of a document, so the same
    words are drawn from other documents.

    Size is the number of words; a null or empty text has 0. A null source is a
    source of its own, the last. ``copies`` is at most ``most``; ``taken`` is
    ``copies * size``. Documents without words are taken once where their source
    has no rest to draw, and otherwise like any other. Of repeated rows, each counts. Rows of a source
    with equal ids (null is an id) draw the same number; of rows with equal ids and sizes at the end of a draw as many
    are taken as fit, whichever of them. Reruns agree in what each id takes. An empty table gives an empty one. A source whose rest is smaller than its
    first document may stay below it by half of that document at most. Columns of
    ``docs`` with the names of the result are replaced.
    """
    # Source, id and size are written once; the texts are read again only at the end.
    liking = (F.lit(1.0) if prefer is None else prefer).cast("double").alias("__prefer")
    size = word_count(F.col("text")).alias("size")
    slim = stage(docs.select("source", "doc_id", size, liking), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.max("weight").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    else:
        sizes = cycle_weights(sizes, weights)
    plan = stage(_plan(targets(sizes, share, most)), "mix-targets")

    drawn = _drawn(slim, plan, seed, bins)
    counts = drawn.where("__bin is not null").groupBy("source", "__bin").agg(
        F.sum("size").alias("n"), F.first("__rest").alias("rest")
    )
    # At most `bins` rows for a source.
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("__bin"))
    reached = counts.withColumn("upto", upto).where("upto > rest").groupBy(
        F.col("source").alias("__s")
    ).agg(
        F.min("__bin").alias("__cut"), F.min_by(F.col("upto") - F.col("n"), "__bin").alias("__below")
    )
    cut = stage(reached, "mix-cuts")

    # Only the documents of the cut bin, about 1 in `bins`, are ranked singly; those that tie as one.
    order = Window.partitionBy("source").orderBy("__place", "doc_id", "size")
    near = _by_source(drawn, cut).where("__bin = __cut").groupBy("source", "__place", "doc_id", "size").agg(
        F.count("*").alias("tied"), F.first("__cut").alias("__cut"),
        F.first("__below").alias("below"), F.first("__rest").alias("rest"),
    )
    words = F.col("size") * F.col("tied")
    before = F.col("below") + F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words
    # A document is taken if half of it still fits: so many of those that tie.
    fit = F.floor((F.col("rest") - F.col("before")) / F.nullif("size", F.lit(0)) + F.lit(0.5))
    fit = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("rest"), F.col("tied")).otherwise(0)).otherwise(fit)
    near = near.withColumn("before", before)
    near = near.withColumn("fit", F.greatest(F.least(fit, F.col("tied")), F.lit(0)).cast("long"))
    last = near.groupBy(F.col("source").alias("__s")).agg(
        F.first("__cut").alias("__cut"),
        F.max(F.when(F.col("fit") > 0, F.struct("__place", "doc_id", "size", "fit", "tied"))).alias("__end"),
    )
    last = last.select(
        "__s", "__cut", F.expr("struct(__end.__place, __end.doc_id, __end.size)").alias("__last"),
        F.when(F.col("__end.fit") < F.col("__end.tied"), F.col("__end.fit")).alias("__fit"),
    )
    last = stage(last.withColumn("__last", F.when(F.col("__last.__place").isNotNull(), F.col("__last"))), "mix-bounds")
    bounds = plan.withColumnRenamed("__s", "source").join(last, F.col("source").eqNullSafe(F.col("__s")), "left")
    bounds = stage(bounds.drop("__s").withColumnRenamed("source", "__s"), "mix-plan")

    docs = replaced(docs.withColumn("__prefer", liking), {"size": size})
    known = _drawn(docs, bounds, seed, bins)
    own = F.struct("__place", "doc_id", "size")
    split = F.col("__fit").isNotNull() & (F.col("__bin") == F.col("__cut")) & (own == F.col("__last"))
    split = F.coalesce(split, F.lit(False))
    extra = (
        F.when(F.col("__bin").isNull(), F.lit(False))
        .when(F.col("__cut").isNull(), F.lit(True))
        .otherwise((F.col("__bin") < F.col("__cut")) | (F.col("__bin") == F.col("__cut")) & (own <= F.col("__last")))
    )
    known = known.withColumn("__extra", F.coalesce(extra, F.lit(False)))
    if last.where("__fit is not null").limit(1).count():
        # Rows that tie at the end of a draw, of which only some fit.
        some = numbered(known.where(split), ["source"], "__number")
        some = some.withColumn("__extra", F.col("__number") <= F.col("__fit")).drop("__number")
        known = known.where(~split).unionByName(some)
    extra = F.col("__extra")
    copies = F.col("__whole") + extra.cast("int")
    out = replaced(
        known,
        {
            "source_size": F.col("__source_size"),
            "target": F.col("__target"),
            "copies": copies.cast("int"),
            "taken": (copies * F.col("size")).cast("long"),
        },
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _plan(rows: DataFrame) -> DataFrame:
    """Per source: whole copies, and the part and the words that are left to draw."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    rest = F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))
    return rows.select(
        F.col("source").alias("__s"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        whole.cast("int").alias("__whole"),
        rest.alias("__rest"),
        (ratio - whole).alias("__part"),
    )


def _by_source(df: DataFrame, plan: DataFrame) -> DataFrame:
    return df.join(plan, df["source"].eqNullSafe(plan["__s"]), "left").drop("__s")


def _drawn(docs: DataFrame, plan: DataFrame, seed: int, bins: int) -> DataFrame:
    """Each document with its place in the Pareto order, as a number in (0, 1), and its bin."""
    u = random_unit(seed, F.col("source"), F.col("doc_id"))
    odds = F.col("__part") / (1 - F.col("__part")) * F.col("__prefer")
    quotient = (u / (1 - u)) / odds
    # q / (1 + q) grows with the quotient.
    place = F.when((F.col("__part") > 0) & (F.col("__prefer") > 0), quotient / (1 + quotient))
    rows = _by_source(docs, plan).withColumn("__place", place)
    bin_ = F.least(F.floor(F.col("__place") * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("__bin", bin_)
