"""Column expressions on array columns, for tables that already hold pairs.

These stay in the JVM and suit linear work such as explaining hits. Searching
goes through :mod:`skewprobe.operators.scan`, which never forms pair rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Blocks = Sequence[tuple[int, int]]


def dim_blocks(dim: int, n: int = 4) -> list[tuple[int, int]]:
    """``n`` half-open dimension ranges with evenly spaced edges, cut to int."""
    if n < 1 or dim < 0:
        raise ValueError("need at least one block and a non-negative dimension")
    step = dim / n
    edges = [int(i * step) for i in range(n)] + [dim]
    return list(zip(edges[:-1], edges[1:]))


def search_cast(df: DataFrame, *cols: str) -> DataFrame:
    """Store vectors in single precision, which halves the scan; scores are summed in double."""
    return df.withColumns({c: F.col(c).cast("array<float>") for c in cols})


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two array columns in double precision."""
    x = _column(a).cast("array<double>")
    y = _column(b).cast("array<double>")
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)


def dot_scores(pairs: DataFrame, a: str = "qv", b: str = "bv") -> DataFrame:
    """Add ``score``, the inner product of two columns."""
    return pairs.withColumn("score", dot(a, b))


def scores_of(base: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """Add ``score``: the inner product of every row with one query."""
    return base.withColumn("score", dot(vector, F.lit([float(x) for x in query])))


def _range(vector: str, block: tuple[int, int]) -> Column:
    start, end = block
    return F.slice(F.col(vector).cast("array<double>"), start + 1, end - start)


def block_scores(pairs: DataFrame, blocks: Blocks, a: str = "qv", b: str = "bv") -> DataFrame:
    """Add ``score_b``: the inner product over each dimension block."""
    return pairs.withColumns(
        {f"score_{i}": dot(_range(a, r), _range(b, r)) for i, r in enumerate(blocks)}
    )


def block_bounds(
    pairs: DataFrame, blocks: Blocks, a: str = "qv", b: str = "bv", bound: str = "abs"
) -> DataFrame:
    """Add ``bound_b``: the most a block can add to a score.

    ``abs`` sums the absolute products; ``norm`` multiplies the block lengths.
    """
    if bound not in ("abs", "norm"):
        raise ValueError("bound must be 'abs' or 'norm'")

    def of(r: tuple[int, int]) -> Column:
        x, y = _range(a, r), _range(b, r)
        if bound == "abs":
            return dot(F.transform(x, F.abs), F.transform(y, F.abs))
        return F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))

    return pairs.withColumns({f"bound_{i}": of(r) for i, r in enumerate(blocks)})


def suffix_bounds(pairs: DataFrame, n: int) -> DataFrame:
    """Add ``suffix_b``: ``bound_b`` plus the bounds of all later blocks."""
    sums: dict[str, Column] = {}
    running: Column | None = None
    for i in reversed(range(n)):
        running = F.col(f"bound_{i}") if running is None else running + F.col(f"bound_{i}")
        sums[f"suffix_{i}"] = running
    return pairs.withColumns(dict(reversed(sums.items())))
