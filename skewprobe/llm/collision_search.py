"""Nearest neighbours by collision-counting hashing.

Every row is projected on fixed random directions, and each block of rows keeps
one sorted array per direction. A query opens a window around its own
projection in every array. The windows grow together (virtual rehashing: no
array is built again for a larger radius), and a row that lies in the windows of
enough directions is verified with its true distance. A query is done in a
block once the k-th verified distance is within the radius of the windows: a
row closer than that radius is in each window with a known probability, so that it
misses the collision threshold with a small known probability.

A few blocks are searched first. The k-th distance found there is at least the final one, so no
window of any other block grows beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.llm.vectors import rows_of, staged_vectors, usable
from skewprobe.session import broadcast_bytes, stage

# Directions, half width of a window over the radius, standard deviations that
# the collision threshold lies below the mean of a row at that radius.
DIRECTIONS, HALF_WIDTH, SAFETY = 256, 1.25, 2.0
# First radius over the distance of a near row of the block, and its growth.
FIRST, GROWTH = 0.9, 1.12
# That distance: the median over some rows of the block of their distance to the row at this place.
PLACE, PROBES = 11, 16
BLOCK_ROWS = 4096
# Blocks that are searched first.
FIRST_BLOCKS = 2
INDEX = "block long, n int, ids binary, rows binary, places binary, order binary, typical double"
HITS = "query_id long, vec_id long, score double"


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count))


def build_index(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    count: int = DIRECTIONS, block_rows: int = BLOCK_ROWS, seed: int = 7,
) -> DataFrame:
    """The written index: a row for each block of rows, with its sorted arrays.

    Every usable row is in it once. Rows are dealt to blocks by a hash of id and vector, so a label
    or a run of equal vectors is not together.
    """
    rows = staged_vectors(df, vec_id, vector, "search-rows")
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))

    def build(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows share a block; it is cut where they make it too long.
        pieces = [part[at : at + 2 * block_rows] for at in range(0, len(part), 2 * block_rows)]
        return pd.DataFrame([_block(key[0], piece, count, seed) for piece in pieces])

    return stage(dealt.groupBy("block").applyInPandas(build, INDEX), "collision-index")


def _block(block: int, part: pd.DataFrame, count: int, seed: int) -> dict:
    rows = rows_of(part["v"])
    shadow = (rows @ directions(rows.shape[1], count, seed)).T.astype(np.float32)
    order = shadow.argsort(1, kind="stable").astype(np.uint16)
    probes = rows[:: max(1, len(rows) // PROBES)][:PROBES]
    squares = (rows * rows).sum(1)
    apart = np.sqrt(np.maximum(squares[:: max(1, len(rows) // PROBES)][:PROBES, None] + squares - 2 * probes @ rows.T, 0))
    typical = float(np.median(np.sort(apart, 1)[:, min(PLACE, len(rows)) - 1]))
    return {
        "block": block, "n": len(part), "ids": part["id"].to_numpy(np.int64).tobytes(),
        "rows": rows.tobytes(), "places": np.take_along_axis(shadow, order.astype(int), 1).tobytes(),
        "order": order.tobytes(), "typical": typical,
    }


def search(
    df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    count: int = DIRECTIONS, block_rows: int = BLOCK_ROWS, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each query.

    ``queries`` has the columns of ``df``. ``score`` is the Euclidean distance of
    the original vectors in double precision; ties go to the smaller id. Rows of
    ``df`` with the id of the query are not its neighbours. Fewer than ``k`` other
    rows are all returned. The search is approximate: see the module.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, on either side; nor do rows with a null id. Repeated rows with another id are found
    each; several queries of one id are answered as one, by the vector that comes first. Vectors of
    different lengths are an error, and no query or no row gives no result.
    """
    if block_rows > 1 << 15:
        raise ValueError("a block holds at most 32,768 rows")
    df, queries = (t.where(F.col(vec_id).isNotNull()) for t in (df, queries))
    index = build_index(df, vec_id, vector, count, block_rows, seed)
    asked = queries.where(usable(F.col(vector))).groupBy(F.col(vec_id).cast("long").alias("query_id")).agg(
        F.min(F.col(vector).cast("array<double>")).alias("q")
    )
    asked = stage(asked, "search-queries")
    size = asked.agg(F.sum(8 * F.size("q")).alias("bytes")).first()["bytes"] or 0
    # The queries go out in blocks of bounded size, one scan of the index for each.
    blocks = max(1, -(-size // min(broadcast_bytes(df.sparkSession), 1 << 23)))
    results = []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        bounds = _bounds(index.where(F.col("block") < FIRST_BLOCKS), some, k, count, seed)
        found = index.mapInPandas(_searcher(some, bounds, k, count, seed), HITS)
        results.append(stage(_ranked(found, k), "search-hits"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    # A row can be found once only for each query, a repeated row as often as it is there.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(index: DataFrame, asked: pd.DataFrame, k: int, count: int, seed: int) -> np.ndarray:
    """For each query the k-th distance among the rows of some blocks, without a bound if they are fewer."""
    bounds = np.full(len(asked), np.inf)
    found = _ranked(index.mapInPandas(_searcher(asked, bounds, k, count, seed), HITS), k)
    last = found.where(F.col("rank") == k).select("query_id", "score").toPandas()
    order = np.argsort(asked["query_id"].to_numpy(np.int64))
    at = order[np.searchsorted(asked["query_id"].to_numpy(np.int64), last["query_id"], sorter=order)]
    bounds[at] = last["score"]
    return bounds


def _searcher(asked: pd.DataFrame, bounds: np.ndarray, k: int, count: int, seed: int):
    ids = asked["query_id"].to_numpy(np.int64)
    rows = rows_of(asked["q"])

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(ids):
            return
        shadow = rows @ directions(rows.shape[1], count, seed)
        for frame in frames:
            for block in frame.itertuples(index=False):
                own = Block(block, count)
                found = own.nearest(ids, rows, shadow, k, bounds)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, [len(near) for near, _ in found]),
                        "vec_id": np.concatenate([near for near, _ in found] or [ids[:0]]),
                        "score": np.concatenate([score for _, score in found] or [np.zeros(0)]),
                    }
                )

    return find


class Block:
    """One block of the index, opened."""

    def __init__(self, block, count: int):
        n = block.n
        self.ids = np.frombuffer(block.ids, np.int64)
        self.rows = np.frombuffer(block.rows, np.float64).reshape(n, -1)
        self.places = np.frombuffer(block.places, np.float32).reshape(count, n)
        self.order = np.frombuffer(block.order, np.uint16).reshape(count, n).astype(np.intp)
        self.typical = block.typical
        inside = 2 * NormalDist().cdf(HALF_WIDTH) - 1
        self.least = math.floor(count * inside - SAFETY * math.sqrt(count * inside * (1 - inside)))

    def nearest(
        self, queries: np.ndarray, rows: np.ndarray, shadow: np.ndarray, k: int, bounds: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances found for each query, nearest first; rows beyond its bound are of no use."""
        # Where all rows are equal, a millionth of the length of the query.
        length = np.sqrt((rows * rows).sum(1))
        least = np.maximum(1e-6 * length, 1e-300)
        most = np.maximum(bounds, least)
        radius = np.minimum(np.maximum(self.typical * FIRST, least), most)
        lower, upper = self._windows(shadow, radius)
        states = [_State(self, *x) for x in zip(queries, rows, lower.T, upper.T, strict=True)]
        live = [i for i, s in enumerate(states) if not s.verify(self, k, radius[i]) and radius[i] < most[i]]
        while live:
            radius[live] = np.minimum(radius[live] * GROWTH, most[live])
            lower, upper = self._windows(shadow[live], radius[live])
            for i, a, b in zip(live, lower.T, upper.T, strict=True):
                states[i].grow(self, a, b)
            live = [i for i in live if not states[i].verify(self, k, radius[i]) and radius[i] < most[i]]
        return [(s.near, s.score) for s in states]

    def _windows(self, shadow: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, exclusive, of each window: a row for each direction."""
        half = HALF_WIDTH * radius
        lower = [p.searchsorted((x - half).astype(p.dtype)) for p, x in zip(self.places, shadow.T, strict=True)]
        upper = [p.searchsorted((x + half).astype(p.dtype), "right") for p, x in zip(self.places, shadow.T, strict=True)]
        return np.array(lower), np.array(upper)


class _State:
    """One query in one block: its windows, the collisions counted and the rows verified."""

    def __init__(self, block: Block, query: int, row: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        count, n = block.order.shape
        self.row, self.lower, self.upper = row, lower, upper
        self.seen = block.ids == query  # never a neighbour of itself
        self.near, self.score = np.zeros(0, np.int64), np.zeros(0)
        ends = zip(block.order, lower.tolist(), upper.tolist(), strict=True)
        if int((upper - lower).sum()) * 2 <= count * n:
            self.hits = _count([o[a:b] for o, a, b in ends], n)
        else:
            # Most rows are inside: those outside are counted instead.
            self.hits = count - _count([p for o, a, b in ends for p in (o[:a], o[b:])], n)

    def grow(self, block: Block, lower: np.ndarray, upper: np.ndarray) -> None:
        """Only what comes into the windows is counted."""
        lower, upper = np.minimum(lower, self.lower), np.maximum(upper, self.upper)
        ends = zip(
            block.order, lower.tolist(), self.lower.tolist(), self.upper.tolist(), upper.tolist(), strict=True
        )
        self.hits += _count([p for o, a, b, c, d in ends for p in (o[a:b], o[c:d])], len(self.hits))
        self.lower, self.upper = lower, upper

    def verify(self, block: Block, k: int, radius: float) -> bool:
        """Measure the rows that have collided often enough; whether the query is done."""
        fresh = np.flatnonzero((self.hits >= block.least) & ~self.seen)
        if len(fresh):
            self.seen[fresh] = True
            apart = block.rows[fresh] - self.row
            near = np.concatenate([self.near, block.ids[fresh]])
            score = np.concatenate([self.score, np.sqrt((apart * apart).sum(1))])
            best = np.lexsort((near, score))[:k]
            self.near, self.score = near[best], score[best]
        return bool(self.seen.all() or (len(self.score) == k and self.score[-1] <= radius))


def _count(parts: list[np.ndarray], n: int) -> np.ndarray:
    return np.bincount(np.concatenate(parts), minlength=n)
