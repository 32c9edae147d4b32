"""Exact searches: all rows, random shards, and routed partitions.

Query tables have ``q_id`` and ``qv``, stored tables ``vec_id`` and
``embedding``, sharded ones also ``part``. Hits are ``q_id, part, vec_id, score,
rk``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewprobe.operators.metrics import fill_loads
from skewprobe.operators.scan import (
    VISIT_BYTES,
    Probes,
    QueryBlock,
    by_part,
    hits_of,
    query_blocks,
    scan,
)
from skewprobe.operators.topk import TOP_K, topk
from skewprobe.session import stage

# Fixed value: partitions a query visits.
NPROBE = 2

HITS = "q_id long, part int, vec_id long, score double, rk int"


@dataclass(frozen=True)
class Search:
    """Hits, and pairs scanned per partition."""

    hits: DataFrame
    loads: DataFrame


def union_or_empty(frames: Iterable[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    frames = list(frames)
    if not frames:
        return like.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, frames)


def search_block(
    block: QueryBlock,
    base: DataFrame,
    k: int,
    visits: dict | None = None,
    keys: Sequence[str] = ("q_id",),
) -> DataFrame:
    """The best ``k`` rows per key of one block: one map over the table and one shuffle.

    ``visits`` names the query positions that visit a partition; by default
    every query visits every partition. A task keeps ``k`` rows per (query, partition), or per query if
    that is all that is asked for.
    """
    merged = visits is None and tuple(keys) == ("q_id",)
    return topk(hits_of(scan(base, Probes(block, visits), k, merged=merged)), keys, k)


def local_topk(queries: DataFrame, sharded: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best ``k`` rows of every (query, partition), every query visiting every partition."""
    return _all_rows(queries, sharded, k, ("q_id", "part"))


def _all_rows(queries: DataFrame, base: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    found = [search_block(block, base, k, None, keys) for block in query_blocks(queries)]
    return union_or_empty(found, base, HITS)


def full_search(queries: DataFrame, base: DataFrame, k: int = TOP_K) -> DataFrame:
    """The exact top-k of the whole table: one map over it and one small shuffle."""
    whole = base.select("vec_id", "embedding")
    return _all_rows(queries, whole, k, ("q_id",)).drop("part")


def sharded_search(
    queries: DataFrame, sharded: DataFrame, k: int = TOP_K, shards: int | None = None
) -> Search:
    """Search every shard and merge the local hits.

    Name the number of ``shards`` to have those without rows among the loads.
    """
    hits = _all_rows(queries, sharded, k, ("q_id",))
    rows = sharded.groupBy("part").agg(F.count("*").alias("n"))
    loads = rows.select("part", (F.col("n") * F.lit(queries.count())).alias("load"))
    if shards is not None:
        every = sharded.sparkSession.range(shards).select(F.col("id").cast("int").alias("part"))
        loads = fill_loads(loads, every, "part")
    return Search(hits, loads)


def centroid_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inner product of every query with every centroid."""
    return route(queries, centroids, max(1, centroids.count())).drop("probe")


def route(queries: DataFrame, centroids: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """The ``nprobe`` best partitions of each query, best first, as ``probe`` 1, 2, ...

    This is the same search with the centroids as the stored table, so neither
    side needs to be small.
    """
    table = centroids.select(F.col("part").alias("vec_id"), F.col("c").alias("embedding"))
    return full_search(queries, table, nprobe).select(
        "q_id",
        F.col("vec_id").cast("int").alias("part"),
        F.col("score").alias("cscore"),
        F.col("rk").alias("probe"),
    )


def route_block(
    block: QueryBlock, centroids: DataFrame, nprobe: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, partitions and probe ranks; ``nprobe`` rows per query of the block."""
    table = centroids.select(F.col("part").alias("vec_id"), F.col("c").alias("embedding"))
    found = search_block(block, table, nprobe).select("q_id", "vec_id", "rk").toArrow()
    where = block.positions(found["q_id"].to_numpy())
    return where, found["vec_id"].to_numpy(), found["rk"].to_numpy()


def open_visits(where: np.ndarray, parts: np.ndarray) -> dict[int, tuple[np.ndarray, None]]:
    """Visits without thresholds."""
    return {p: (np.sort(where[rows]), None) for p, rows in by_part(parts)}


def routed_topk(
    queries: DataFrame,
    base: DataFrame,
    routes: DataFrame,
    k: int = TOP_K,
    keys: Sequence[str] = ("q_id", "part"),
    most: int | None = None,
) -> DataFrame:
    """The best ``k`` rows of each routed (query, partition), or of each query.

    Pairs each query with the rows of its partitions only, inside the scan. The
    rows of a hot partition stay spread over the tasks that read it. The visits of a block are sent along with its
    queries, so they count for its size: name the ``most`` that a query has to save counting them.
    """
    found = []
    if most is None:
        blocks = query_blocks(queries, visits=routes)
    else:
        blocks = query_blocks(queries, extra=VISIT_BYTES * most)
    for block in blocks:
        table = block.own(routes).select("q_id", "part").toArrow()
        where = block.positions(table["q_id"].to_numpy())
        visits = open_visits(where, table["part"].to_numpy())
        found.append(search_block(block, base, k, visits, keys))
    return union_or_empty(found, base, HITS)


def attach_vectors(hits: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """Hits with both vectors, ``qv`` and ``bv``, for :mod:`skewprobe.functions.vectors`.

    The hits are written first. While they are few, Catalyst knows so and sends them to the rows. With more of
    them both sides are shuffled; the planner then drops rows that are no hits by a Bloom filter on the ids of the hits
    before the exchange, where the stored table is large enough to be worth it
    (``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``, 10 GB by default).
    """
    rows = base.select("vec_id", F.col("embedding").alias("bv"))
    # Every hit has a score. The planner makes a filter only from a side that it takes for selective.
    found = stage(hits, "hits").where(F.col("score") >= F.lit(float("-inf")))
    return found.join(rows, "vec_id").join(queries.select("q_id", "qv"), "q_id")


def routed_candidates(routes: DataFrame, base: DataFrame) -> DataFrame:
    """How many rows each routed (query, partition) has to look at.

    The pairs themselves exist only inside the scan of :func:`routed_topk`.
    """
    rows = base.groupBy("part").agg(F.count("*").alias("candidates"))
    return routes.join(rows, "part", "left").fillna(0, ["candidates"])


def scan_loads(routes: DataFrame, base: DataFrame, centroids: DataFrame) -> DataFrame:
    """Pairs scanned per partition: visits times rows, without forming the pairs."""
    visits = routes.groupBy("part").agg(F.count("*").alias("visits"))
    pairs = routed_candidates(visits, base).select(
        "part", (F.col("visits") * F.col("candidates")).alias("load")
    )
    return fill_loads(pairs, centroids, "part")


def ivf_search(
    queries: DataFrame,
    base: DataFrame,
    centroids: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
) -> Search:
    """Search the partitions each query is routed to; ``base`` carries ``part``."""
    routes = route(queries, centroids, nprobe)
    hits = routed_topk(queries, base, routes, k, ("q_id",), nprobe)
    return Search(hits, scan_loads(routes, base, centroids))
