"""Assigning stored vectors to partitions; every assignment is a map over the table."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewprobe.functions.keys import SEED, order_key
from skewprobe.operators.order import order_statistics
from skewprobe.operators.scan import DECIMALS, matrix, query_blocks

# Partitions by default, and k-means restarts.
NUM_PARTS = 4
RESTARTS = 10
# A run ends when no centroid moves further; runs that look for their starts side by side; rows compared at once.
TOLERANCE = 1e-4
STARTS_AT_ONCE = 4
LLOYD_ROWS = 1 << 12


def random_shards(
    base: DataFrame, n: int = NUM_PARTS, id: str = "vec_id", seed: int = SEED
) -> DataFrame:
    """Add ``part``: ``n`` near-equal slices of a random order, larger slices first.

    Equal to ``ntile(n)`` over that order, found from ``n - 1`` exact cut keys.
    """
    rows = base.count()
    sizes = [rows // n + (i < rows % n) for i in range(n)]
    ends = np.cumsum(sizes)[:-1].tolist()
    spark = base.sparkSession
    targets = spark.createDataFrame([(0, e) for e in sorted(set(ends))], "grp int, rank long")
    found = order_statistics(base, order_key(id, seed), targets, largest=rows).collect()
    cut = {row["rank"]: row["value"] for row in found}
    key = order_key(id, seed)
    cuts = [cut[e] for e in ends if e in cut]

    def place(low: int, high: int) -> Column:
        """How many of the cuts from ``low`` to ``high`` are below the key, by bisection."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(cuts[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    return base.withColumn("part", place(0, len(cuts)))


def mean_centroids(base: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """One centroid per value of an integer column: the mean of its vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return base.groupBy(F.col(by).cast("int").alias("part")).agg(
        F.transform(vector_to_array(mean), lambda x: F.round(x, DECIMALS)).alias("c")
    )


def fit_centroids(
    base: DataFrame,
    k: int = NUM_PARTS,
    restarts: int = RESTARTS,
    seed: int = SEED,
    max_iter: int = 300,
    vector: str = "embedding",
) -> DataFrame:
    """k-means centroids ``part``, ``c``: the cheapest of several seeded runs.

    The outcome depends on how the input is partitioned, so write the centroids
    and let queries read them. Every run has the starts that MLlib gives for its seed and moves
    its centroids as MLlib does, but one pass over the rows serves all runs that still move.
    """
    points = base.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    # All passes are over the same rows; kept by the executors, they are computed once, and
    # again where an executor is lost. MLlib needs them as its own vectors, later passes as stored.
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    points.count()

    runs = [KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=TOLERANCE) for i in range(restarts)]

    def start(run: KMeans) -> np.ndarray:
        return np.array(run.fit(points, {run.maxIter: 0}).clusterCenters())

    # Each run keeps numbers for every row while it starts, so only some start side by side.
    with ThreadPoolExecutor(max_workers=min(restarts, STARTS_AT_ONCE)) as pool:
        centres = list(pool.map(start, runs))
    points.unpersist()
    points = base.select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    cost, moving = [0.0] * restarts, list(range(restarts))
    for _ in range(max_iter):
        if not moving:
            break
        sums = _lloyd_sums(points, {i: centres[i] for i in moving})
        for i in list(moving):
            # A centroid without rows stays where it is.
            new = centres[i].copy()
            for j, (n, total) in sums[i][1].items():
                new[j] = total / n
            if (((new - centres[i]) ** 2).sum(axis=1) <= TOLERANCE**2).all():
                moving.remove(i)
            centres[i], cost[i] = new, sums[i][0]
    points.unpersist()
    best = min(range(restarts), key=cost.__getitem__)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres[best])]
    return base.sparkSession.createDataFrame(rows, "part int, c array<double>")


def _lloyd_sums(
    points: DataFrame, centres: dict[int, np.ndarray]
) -> dict[int, tuple[float, dict[int, tuple[int, np.ndarray]]]]:
    """For each run its cost, and for each of its centroids that has rows their number and sum."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, stacked = list(shared.value), np.concatenate(list(shared.value.values()))
        ends = np.cumsum([len(c) for c in shared.value.values()])
        lengths = np.einsum("ij,ij->i", stacked, stacked)
        many, sums = np.zeros(len(stacked), np.int64), np.zeros(stacked.shape)
        cost = np.zeros(len(stacked))
        for batch in batches:
            rows = matrix(batch.column(0)).astype(np.float64, copy=False)
            for lo in range(0, len(rows), LLOYD_ROWS):
                chunk = rows[lo : lo + LLOYD_ROWS]
                squares = np.einsum("ij,ij->i", chunk, chunk)
                far = lengths[:, None] - 2.0 * (stacked @ chunk.T)
                mine = np.zeros(far.shape)
                for end, c in zip(ends, shared.value.values(), strict=True):
                    own = far[end - len(c) : end]
                    first = own.argmin(axis=0)
                    mine[end - len(c) + first, np.arange(len(chunk))] = 1.0
                    cost[end - 1] += np.maximum(own.min(axis=0) + squares, 0.0).sum()
                sums += mine @ chunk
                many += mine.sum(axis=1).astype(np.int64)
        run = np.repeat(runs, [len(c) for c in shared.value.values()])
        part = np.concatenate([np.arange(len(c)) for c in shared.value.values()])
        columns = [pa.array(run, pa.int32()), pa.array(part, pa.int32()), pa.array(many), pa.array(cost)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums))], names=["run", "part", "n", "cost", "total"])

    sums = points.mapInArrow(add_up, "run int, part int, n long, cost double, total array<double>")
    # One row for each task and centroid is added up.
    found = sums.groupBy("run", "part").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
    ).collect()
    shared.unpersist()
    out = {}
    for i in centres:
        mine = sorted((row for row in found if row["run"] == i), key=lambda row: row["part"])
        out[i] = (
            sum(row["cost"] for row in mine),
            {row["part"]: (row["n"], np.array(row["total"])) for row in mine if row["n"]},
        )
    return out


def assign_nearest(
    base: DataFrame, centroids: DataFrame, vector: str = "embedding"
) -> DataFrame:
    """Add ``part``: the centroid at the least Euclidean distance, ties to the lowest.

    Centroids beyond the broadcast bound are compared block by block, in further
    maps over the same rows.
    """
    fields = [f for f in base.schema.fields if f.name != "part"]
    table = base.select(*[f.name for f in fields]).withColumns(
        {"part": F.lit(None).cast("int"), "__near": F.lit(None).cast("double")}
    )
    schema = T.StructType(
        [*fields, T.StructField("part", T.IntegerType()), T.StructField("__near", T.DoubleType())]
    )
    context = base.sparkSession.sparkContext
    for block in query_blocks(centroids, "part", "c"):
        order = np.argsort(block.ids)
        shared = context.broadcast((block.ids[order], block.vectors[order]))

        def nearer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _nearer(batch, *shared.value, vector)

        table = table.mapInArrow(nearer, schema)
    return table.drop("__near")


def _nearer(batch, parts, centres, vector):
    if batch.num_rows == 0:
        return batch
    v = matrix(batch.column(batch.schema.get_field_index(vector))).astype(np.float64, copy=False)
    at, far = batch.schema.get_field_index("part"), batch.schema.get_field_index("__near")
    part = batch.column(at).fill_null(np.iinfo(np.int32).max).to_numpy(zero_copy_only=False).copy()
    near = batch.column(far).fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
    lengths = np.einsum("ij,ij->i", centres, centres)
    # Row chunks keep the distance table small next to many centroids.
    step = max(1, (1 << 21) // len(centres))
    for lo in range(0, len(v), step):
        rows = slice(lo, lo + step)
        chunk = v[rows]
        squares = np.einsum("ij,ij->i", chunk, chunk)[:, None]
        dist = np.round(squares + lengths - 2.0 * (chunk @ centres.T), DECIMALS)
        first = dist.argmin(axis=1)
        d, p = dist[np.arange(len(chunk)), first], parts[first]
        better = (d < near[rows]) | ((d == near[rows]) & (p < part[rows]))
        near[rows] = np.where(better, d, near[rows])
        part[rows] = np.where(better, p, part[rows])
    columns = list(batch.columns)
    columns[at] = pa.array(part, type=pa.int32())
    columns[far] = pa.array(near, type=pa.float64())
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
