"""Groups of alike rows inside each partition, and bounds that rule out whole groups.

A partition is cut into a few groups around pivots that are fitted on a sample of it. For
every group the index keeps a summary: its pivot ``c``, how far its rows are from it at most (``radius``,
and ``radii`` per block of dimensions), and the range of their lengths per block (``shortest``,
``longest``). No row of a group scores more with a query ``q`` than the least of

* ``q.c + |q| radius``,
* ``q.c + sum |q_b| radii_b`` and
* ``sum |q_b| longest_b``.

A search compares that with a query's threshold and leaves the files of a group unread if no query needs them.
There are as many summaries as groups, so the bounds are computed by a map over the table of
summaries with a block of queries sent along, like any other search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewprobe.functions.keys import SEED
from skewprobe.functions.vectors import dim_blocks
from skewprobe.operators.sampling import sample_per_group
from skewprobe.operators.scan import DECIMALS, QueryBlock, by_part, matrix, query_blocks

# Groups of a partition, and blocks of dimensions in a summary.
GROUPS, BLOCKS = 16, 4
# Rows of the sample for each group, and rounds of fitting its pivots.
SAMPLE_ROWS, ROUNDS = 64, 8
# Pairs of a query and a group worked on at a time.
PAIRS = 1 << 21

SUMMARY = (
    "part int, cell int, n long, c array<double>, radius double, radii array<double>, "
    "shortest array<double>, longest array<double>"
)
PAIR = "q int, part int, cell int, n long, near double, bound double"


def fit_groups(base: DataFrame, groups: int = GROUPS, seed: int = SEED) -> DataFrame:
    """Pivots ``part, cell, c`` of up to ``groups`` groups for each partition.

    Fitted on at most ``groups * 64`` rows of a partition, in a task for each. Cells are numbered
    across partitions: ``cell div groups`` is the partition.
    """
    rows = base.select("vec_id", "embedding", F.col("part").cast("int").alias("part"))
    sample = sample_per_group(rows, "part", "vec_id", groups * SAMPLE_ROWS, seed)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        part = int(frame["part"].iloc[0])
        found = _pivots(np.stack(frame["embedding"].to_list()).astype(np.float64), groups, [seed, part])
        cells = part * groups + np.arange(len(found))
        return pd.DataFrame({"part": part, "cell": cells.astype(np.int32), "c": list(found)})

    return sample.groupBy("part").applyInPandas(fit, "part int, cell int, c array<double>")


def _pivots(v: np.ndarray, groups: int, seed: list[int]) -> np.ndarray:
    """Different points that the rows lie around; the origin if there is no usable row."""
    v = v[np.isfinite(v).all(axis=1)]
    if not len(v):
        return np.zeros((1, v.shape[1]))
    # Each next start is drawn by its distance to those before it.
    rng = np.random.default_rng(seed)
    starts, apart = [int(rng.integers(len(v)))], np.full(len(v), np.inf)
    while len(starts) < groups:
        apart = np.minimum(apart, ((v - v[starts[-1]]) ** 2).sum(axis=1))
        if not apart.sum() > 0:
            break
        starts.append(int(rng.choice(len(v), p=apart / apart.sum())))
    pivots = v[starts]
    for _ in range(ROUNDS):
        near = _distances(v, pivots).argmin(axis=1)
        pivots = np.stack([v[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(pivots)])
    return pivots


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rough: they choose a group, they do not bound it."""
    lengths = np.einsum("ij,ij->i", centres, centres)
    return np.einsum("ij,ij->i", v, v)[:, None] + lengths - 2.0 * (v @ centres.T)


def assign_groups(base: DataFrame, pivots: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Add ``cell``: the group of the row's own partition whose pivot is nearest.

    A map over ``base``, one for each block of pivots within the broadcast bound. A row with a component that is
    no number goes to the first group of its partition.
    """
    fields = [f for f in base.schema.fields if f.name != "cell"]
    start = (F.col("part").cast("int") * groups).alias("cell")
    table = base.select(*[f.name for f in fields], start, F.lit(float("inf")).alias("__near"))
    schema = T.StructType(
        [*fields, T.StructField("cell", T.IntegerType()), T.StructField("__near", T.DoubleType())]
    )
    context = base.sparkSession.sparkContext
    for block in query_blocks(pivots, "cell", "c"):
        order = np.argsort(block.ids)
        shared = context.broadcast((block.ids[order], block.vectors[order]))

        def nearer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cells, centres = shared.value
            for batch in batches:
                yield _nearer(batch, cells, centres, groups)

        table = table.mapInArrow(nearer, schema)
    return table.drop("__near")


def _nearer(batch: pa.RecordBatch, cells: np.ndarray, centres: np.ndarray, groups: int) -> pa.RecordBatch:
    if batch.num_rows == 0:
        return batch
    names = batch.schema.names
    v = matrix(batch.column(names.index("embedding"))).astype(np.float64, copy=False)
    parts = batch.column(names.index("part")).to_numpy(zero_copy_only=False)
    cell = batch.column(names.index("cell")).to_numpy(zero_copy_only=False).copy()
    near = batch.column(names.index("__near")).to_numpy(zero_copy_only=False).copy()
    for part, rows in by_part(parts):
        low, high = np.searchsorted(cells, [part * groups, (part + 1) * groups])
        if low == high:
            continue
        apart = _distances(v[rows], centres[low:high])
        first = apart.argmin(axis=1)
        d = apart[np.arange(len(rows)), first]
        better = d < near[rows]
        cell[rows[better]] = cells[low:high][first[better]]
        near[rows[better]] = d[better]
    columns = list(batch.columns)
    columns[names.index("cell")] = pa.array(cell, type=pa.int32())
    columns[names.index("__near")] = pa.array(near, type=pa.float64())
    return pa.RecordBatch.from_arrays(columns, names=names)


def summarise(grouped: DataFrame, pivots: DataFrame, n_blocks: int = BLOCKS) -> DataFrame:
    """The summary of every group that has a usable row, see :data:`SUMMARY`.

    One map over the table; what leaves a task is a row for each group and block of dimensions it has met.
    """
    table = grouped.select("embedding", F.col("part").cast("int").alias("part"), F.col("cell").cast("int").alias("cell"))
    context = grouped.sparkSession.sparkContext
    found = []
    schema = "part int, cell int, block int, n long, radius double, far double, low double, high double"
    for block in query_blocks(pivots, "cell", "c"):
        order = np.argsort(block.ids)
        shared = context.broadcast((block.ids[order], block.vectors[order]))

        def measure(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _measured(batches, *shared.value, n_blocks)

        cells = pivots.select("cell") if block.slots == 1 else pivots.select(F.col("cell").alias("q_id"))
        own = table
        if block.slots > 1:
            own = table.join(block.own(cells).withColumnRenamed("q_id", "cell"), "cell", "left_semi")
            own = own.select("embedding", "part", "cell")
        found.append(own.mapInArrow(measure, schema))
    if not found:
        return grouped.sparkSession.createDataFrame([], SUMMARY)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    per_block = rows.groupBy("part", "cell", "block").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("far").alias("far"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block", "far", "low", "high")))
    summed = per_block.groupBy("part", "cell").agg(
        F.max("n").alias("n"), F.max("radius").alias("radius"), ordered.alias("b")
    )
    joined = summed.join(pivots.select("cell", "c"), "cell")
    return joined.select(
        "part", "cell", "n", "c", "radius", F.col("b.far").alias("radii"),
        F.col("b.low").alias("shortest"), F.col("b.high").alias("longest"),
    )


def _measured(
    batches: Iterator[pa.RecordBatch], cells: np.ndarray, centres: np.ndarray, n_blocks: int
) -> Iterator[pa.RecordBatch]:
    # Per group: partition, rows, and a row per block of radius, largest distance, least and largest length.
    found: dict[int, tuple[int, int, np.ndarray]] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        v = matrix(batch.column(0)).astype(np.float64, copy=False)
        good = np.isfinite(v).all(axis=1)
        v = v[good]
        parts = batch.column(1).to_numpy(zero_copy_only=False)[good]
        ranges = dim_blocks(v.shape[1], n_blocks)
        for cell, rows in by_part(batch.column(2).to_numpy(zero_copy_only=False)[good]):
            x = v[rows]
            away = x - centres[np.searchsorted(cells, cell)]
            now = np.empty((n_blocks, 4))
            now[:, 0] = np.linalg.norm(away, axis=1).max()
            for b, (s, e) in enumerate(ranges):
                lengths = np.linalg.norm(x[:, s:e], axis=1)
                now[b, 1:] = np.linalg.norm(away[:, s:e], axis=1).max(), lengths.min(), lengths.max()
            if cell in found:
                part, n, old = found[cell]
                now[:, [0, 1, 3]] = np.maximum(now[:, [0, 1, 3]], old[:, [0, 1, 3]])
                now[:, 2] = np.minimum(now[:, 2], old[:, 2])
                found[cell] = part, n + len(rows), now
            else:
                found[cell] = int(parts[rows[0]]), len(rows), now
    for cell, (part, n, table) in found.items():
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.full(n_blocks, part), pa.int32()),
                "cell": pa.array(np.full(n_blocks, cell), pa.int32()),
                "block": pa.array(np.arange(n_blocks), pa.int32()),
                "n": pa.array(np.full(n_blocks, n), pa.int64()),
                **{name: pa.array(table[:, i]) for i, name in enumerate(("radius", "far", "low", "high"))},
            }
        )


def group_bounds(
    block: QueryBlock,
    summaries: DataFrame,
    visits: dict[int, tuple[np.ndarray, None]] | None = None,
    thr: np.ndarray | None = None,
) -> DataFrame:
    """For each query position ``q`` and group: rows ``n``, score of the pivot ``near``, and ``bound``.

    ``visits`` names the query positions that visit a partition, by default all do. With ``thr``, one
    threshold for each query, pairs below it are left out. A bound is raised by the rounding that
    the sums behind it may have.
    """
    columns = ("part", "cell", "n", "c", "radius", "radii", "longest")
    table = summaries.select(*columns)
    if visits is not None:
        table = table.where(F.col("part").isin([int(p) for p in visits]))
    context = summaries.sparkSession.sparkContext
    queries, limits = block.send(context), context.broadcast((visits, thr))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, q = queries.value
        visiting, least = limits.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts, cells, n, radius = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            c, radii, longest = (matrix(batch.column(i)) for i in (3, 5, 6))
            for part, rows in by_part(parts):
                where = np.arange(len(q)) if visiting is None else visiting[part][0]
                step = max(1, PAIRS // max(1, len(where)))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    near, upper = _bounds(q[where], c[some], radius[some], radii[some], longest[some])
                    keep = ~np.isnan(upper) if least is None else upper >= least[where, None]
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(where[i], pa.int32()), pa.array(np.full(len(i), part), pa.int32()),
                            pa.array(cells[some][j], pa.int32()), pa.array(n[some][j], pa.int64()),
                            pa.array(near[i, j]), pa.array(upper[i, j]),
                        ],
                        names=["q", "part", "cell", "n", "near", "bound"],
                    )

    return table.mapInArrow(bound, PAIR)


def _bounds(q, c, radius, radii, longest):
    near = q @ c.T
    length = np.linalg.norm(q, axis=1)
    blocks = [np.linalg.norm(q[:, s:e], axis=1) for s, e in dim_blocks(q.shape[1], radii.shape[1])]
    by_block = np.stack(blocks, axis=1)
    upper = near + np.minimum(length[:, None] * radius, by_block @ radii.T)
    upper = np.minimum(upper, by_block @ longest.T)
    # A sum of d products is off by at most about d roundings of the lengths.
    size = np.linalg.norm(c, axis=1) + radius
    return near, upper + 8 * (q.shape[1] + 8) * 2.0**-53 * length[:, None] * size + 2 * 10.0**-DECIMALS
