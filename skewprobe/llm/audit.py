"""What each filter of a chain removes, in every order of the chain.

The removals of all coalitions of filters are tabulated: a set of filters removes the
documents that fail any of them. Every count of a chain is a difference of coalitions: a step removes what
the filters up to it remove, less what those before it do.

The Shapley value of a filter is found by exact constrained least squares: shares of the
filters that add up to the removals of all of them, fitted to the removals of the other
coalitions with the Shapley kernel as weights. The normal equations do not depend on the data, so they
are solved once, in rationals, for every right side; what is left per part is a sum of whole
numbers.

Documents meet by the digest of the text and by id only, in rows of a few bytes.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial, lcm
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.llm.common import WORD
from skewprobe.session import stage

NAMES = "ABCDE"
#: Fewest words; hundredths of distinct words; hundredths of capitals; marks that no text may hold.
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"


def failures(text: Column, words: int = WORDS, distinct: int = DISTINCT, capitals: int = CAPITALS) -> list[Column]:
    """Whether a text fails the filters that look at the text alone: A, B, C, D."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    return [
        F.size(found) < words,
        100 * F.size(F.array_distinct(found)).cast("long") < distinct * F.size(found).cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capitals * F.length(text).cast("long"),
        text.rlike(MARKS),
    ]


def shapley_weights(filters: int) -> tuple[list[list[int]], int]:
    """Whole weights of all coalitions for each filter, and their common divisor.

    The value of filter ``i`` is the sum of ``weights[i][s] * removals[s]`` over the divisor; bit ``i`` of ``s`` is
    set if filter ``i`` belongs to the coalition.
    """
    every = (1 << filters) - 1
    if filters == 1:
        return [[0, 1]], 1
    kernel = {
        s: Fraction(filters - 1, comb(filters, s.bit_count()) * s.bit_count() * (filters - s.bit_count()))
        for s in range(1, every)
    }
    members = [[s >> i & 1 for i in range(filters)] for s in range(every + 1)]
    normal = [[sum(w * members[s][i] * members[s][j] for s, w in kernel.items()) for j in range(filters)] for i in range(filters)]
    inverse = _inverse(normal)
    spread = [sum(row) for row in inverse]
    weights = []
    for i in range(filters):
        mine = []
        for s in range(every + 1):
            right = [kernel.get(s, 0) * m for m in members[s]]
            free = [sum(a * b for a, b in zip(row, right, strict=True)) for row in inverse]
            # The multiplier that makes the shares add up.
            excess = sum(free) - (s == every)
            mine.append(free[i] - spread[i] * excess / sum(spread))
        weights.append(mine)
    over = lcm(*(Fraction(w).denominator for mine in weights for w in mine))
    return [[int(w * over) for w in mine] for mine in weights], over


def _inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    n = len(matrix)
    rows = [[*map(Fraction, row), *[Fraction(i == j) for j in range(n)]] for i, row in enumerate(matrix)]
    for i in range(n):
        lead = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[lead] = rows[lead], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[n:] for row in rows]


def failure_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of each part that fail the same filters.

    Bit ``i`` of ``mask`` is set for filter ``i``, the last for texts that an earlier id has.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [fails.cast("int") * (1 << i) for i, fails in enumerate(failures(text))]
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        reduce(add, bits).alias("mask"),
    )
    # Rows of equal id and text count together from here on.
    same = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    # Null ids meet no label; dealt out by their texts they do not meet in one task either.
    missing = F.col("doc_id").isNull()
    same = same.withColumn("spot", F.when(missing, F.xxhash64("digest", "part")).otherwise(F.col("doc_id")))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = known.withColumn("has_id", F.lit(True))
    same = same.withColumn("has_id", ~missing)
    joined = same.join(
        known, (same["spot"] == known["labelled"]) & (same["has_id"] == known["has_id"]), "left"
    ).select(
        "doc_id", "part", "digest", "mask", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    groups = joined.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # At most a row for each part and label of a text.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", first)
    at_first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    groups = groups.withColumn("fresh", F.col("unnumbered") + at_first)
    last = 1 << len(bits)
    both = F.explode(
        F.array(
            F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
            F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
        )
    )
    split = groups.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.*")
    table = split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    return stage(table, "filter-failures")


def coalitions(table: DataFrame, filters: int) -> DataFrame:
    """``part, total, removed, good, toxic``: the last three are arrays over all sets of filters."""
    sets = F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1)))
    hit = F.col("mask").bitwiseAND(F.col("set")) != 0
    sums = table.select("*", sets.alias("set")).groupBy("part", "set").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")],
    )
    rows = F.array_sort(F.collect_list(F.struct("set", "n", "good", "toxic")))
    listed = sums.groupBy("part").agg(F.max("total").alias("total"), rows.alias("rows"))
    return listed.select(
        "part", "total", F.col("rows.n").alias("removed"), F.col("rows.good").alias("good"), F.col("rows.toxic").alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step.

    ``docs`` has ``doc_id, text, source``, ``labels`` has ``doc_id, quality, toxic``. Filters: A fewer than 50
    words, B under 65 % of the words distinct, C over 5 % capitals, D a mark of ``#$%&*|``, E the
    text of a smaller id anywhere in the table, whether that is removed or not.

    A null text is empty, a null source the part of the empty string. Every row is a document, a repeated
    one too: it has no smaller id than itself, so E passes it. A null id is smaller and greater than none: E passes
    it and it marks no other; it has no labels. Of several labels of an id the highest counts,
    null labels are none. An empty table gives an empty one; other columns are not read.
    """
    filters = len(NAMES)
    every = (1 << filters) - 1
    weights, over = shapley_weights(filters)
    runs = factorial(filters)
    steps = []
    for order in permutations(range(filters)):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(NAMES[j] for j in order)
            steps.append(f"struct('{name}' as filter_order, {step} as step, {i} as filter, {before} as before)")
            before |= 1 << i
    parts = coalitions(failure_table(docs, labels), filters)
    # The sum over all orders is so many times the value: whole, and divided last.
    values = [
        reduce(add, [F.col("removed")[s] * w for s, w in enumerate(mine) if w]) * runs for mine in weights
    ]
    parts = parts.withColumn("values", F.array(*[F.expr("0L") + v for v in values]))
    rows = parts.select("*", F.expr(f"inline(array({', '.join(steps)}))"))
    one = F.expr("shiftleft(1, filter)")
    after = F.col("before").bitwiseOR(one)

    def of(column: str, coalition: Column) -> Column:
        return F.get(column, coalition)

    removed = of("removed", after) - of("removed", F.col("before"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - of("removed", after)).alias("kept"),
        removed.alias("removed"),
        (of("removed", one) - removed).alias("redundant"),
        (of("removed", F.lit(every)) - of("removed", F.lit(every) - one)).alias("unique_fails"),
        (of("good", after) - of("good", F.col("before"))).alias("good_lost"),
        (of("toxic", after) - of("toxic", F.col("before"))).alias("toxic_lost"),
        F.expr(f"element_at(values, filter + 1) div {over}L").alias("shapley"),
    )
