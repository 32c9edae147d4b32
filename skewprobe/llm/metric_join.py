"""Exact near-duplicates among embeddings: a metric range join over pivot cells.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2 c) of each
other. Every vector belongs to the cell of its nearest pivot. By the triangle
inequality a partner of x lies in another cell only if the pivot of that cell
is at most 2 eps farther from x than its own, and x is at most eps from the plane
between both pivots; x is then replicated there. Cells join independently.

A cell of any size is cut into chunks, and chunk pairs join independently, so
a dense cell costs many tasks and not a large one. Equal vectors are one node
with a count. A chunk pair sends on, per vector, its number of links and one
link of a star, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.components import components, local_stars
from skewprobe.llm.vectors import staged_vectors, unit_rows, usable
from skewprobe.session import stage

# Vectors of one chunk; a task holds two chunks and one block of products.
CHUNK = 4096
BLOCK = 512
# Most pivots, and rows they are chosen among: any choice gives the same links.
PIVOTS, PIVOT_ROWS = 1024, 4096
# Cells of a replication table that a task works out at once.
FLAGS = 1 << 24
# A product of unit vectors in single precision errs by less than so many roundings for each dimension; what
# is closer is summed in double.
ROUNDINGS = 4
# Room for the rounding of distances in the bounds.
SLACK = 1e-9
FOUND = "u long, v long, n long"


def vector_groups(
    df: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
    chunk: int = CHUNK, pivots: int = PIVOTS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row for each row of ``df``.

    Vectors link if their cosine, in double precision, is at least ``cosine``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable, ``kept`` tells the row that names its component.

    Rows whose vector is null, empty, zero or holds a null or non-finite
    component link with nothing and are components of their own. Repeated rows
    are rows of their own and link with each other. A null id is joined like others but names
    nothing; its ``component_id`` is null only if nothing else is reached, and it is never
    ``kept``. Vectors of different lengths are an error. Other columns are not read. An empty table gives
    an empty one.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = staged_vectors(df, vec_id, vector, "vectors")
    # Equal vectors once.
    nodes = rows.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # The number is that of the written row: unique, and fixed once it is written.
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    joined = stage(_joined(nodes, cosine, chunk, pivots), "vector-links")
    sums = joined.groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(joined.where("v is not null").select("u", "v"))
    known = (
        nodes.select("v", "node", "first", "copies")
        .join(sums, F.col("node") == F.col("u"), "left").drop("u")
        .join(roots, "node", "left")
        .select("v", "first", "copies", F.coalesce("others", F.lit(0)).alias("others"),
                F.coalesce("root", "node").alias("root"))
    )
    known = stage(known, "vector-roots")
    names = known.groupBy("root").agg(F.min("first").alias("name"))
    known = known.join(names, "root").select(
        F.col("v").alias("w"), (F.col("copies") - 1 + F.col("others")).alias("n"), "name"
    )
    named = rows.join(stage(known, "vector-classes"), F.col("v") == F.col("w")).select(
        F.col("id").alias(vec_id), F.col("n").alias("n_links"), F.col("name").alias("component_id")
    )
    own = F.col(vec_id).cast("long")
    alone = df.where(~usable(F.col(vector))).select(
        own.alias(vec_id), F.lit(0).cast("long").alias("n_links"), own.alias("component_id")
    )
    out = named.unionByName(alone)
    kept = F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False))
    return out.withColumn("kept", kept)


def _joined(nodes: DataFrame, cosine: float, chunk: int, most_pivots: int) -> DataFrame:
    """``u, v, n``: numbers of links per vector (``v`` null) and links that make stars (``n`` 0)."""
    eps = math.sqrt(2 - 2 * cosine)
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("v"), "node").limit(PIVOT_ROWS).select("v").toPandas()["v"]
    wanted = min(max(1, -(-total // chunk)), most_pivots)
    pivots = far_apart(unit_rows(sample), wanted)

    @pandas_udf("cell int, away double")
    def home(v: pd.Series) -> pd.DataFrame:
        apart = _distances(unit_rows(v), pivots)
        cell = apart.argmin(1) if apart.size else np.zeros(len(v), int)
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": apart.min(1, initial=np.inf)})

    homed = nodes.select("node", "v", "copies", home("v").alias("home")).select(
        "node", "v", "copies", "home.cell", "home.away"
    )
    homed = stage(homed, "cells")
    # One row for each pivot.
    cells = homed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).toPandas()
    layout = Layout(pivots, eps, cells, chunk)

    @pandas_udf("array<long>")
    def tasks(node: pd.Series, v: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(layout.tasks(node.to_numpy(), unit_rows(v), cell.to_numpy()), dtype=object)

    dealt = homed.select("node", "v", "copies", F.explode(tasks("node", "v", "cell")).alias("task"))
    size = len(layout.cell_of)
    dealt = dealt.select(
        F.expr("task div 2").alias("pair"), (F.col("task") % 2).cast("int").alias("side"), "node", "v", "copies"
    )

    def join(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        same = key[0] // size == key[0] % size
        left = rows[rows["side"] == 0]
        right = left if same else rows[rows["side"] == 1]
        return join_chunks(left, right, same, cosine)

    return dealt.groupBy("pair").applyInPandas(join, FOUND)


def far_apart(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Rows picked in turn, each the farthest from those before it."""
    if not len(rows):
        return rows
    picked = [0]
    near = _distances(rows, rows[:1])[:, 0]
    while len(picked) < min(wanted, len(rows)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(rows, rows[picked[-1:]])[:, 0])
    return rows[picked]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not rows.size:
        return np.zeros((len(rows), len(pivots)))
    return np.sqrt(np.maximum(2 - 2 * (rows @ pivots.T), 0))


class Layout:
    """Chunks of the cells, and the chunk pairs each vector has to be in."""

    def __init__(self, pivots: np.ndarray, eps: float, cells: pd.DataFrame, chunk: int):
        self.pivots, self.eps = pivots, eps
        count, far = np.zeros(len(pivots), int), np.zeros(len(pivots))
        count[cells["cell"]], far[cells["cell"]] = cells["n"], cells["far"]
        self.chunks = -(-count // chunk)
        self.first = np.cumsum(self.chunks) - self.chunks
        # The cell of each chunk.
        self.cell_of = np.repeat(np.arange(len(pivots)), self.chunks)
        self.between = _distances(pivots, pivots)
        self.meet = self.between <= far[:, None] + far[None, :] + eps + SLACK

    def tasks(self, node: np.ndarray, rows: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
        """For each vector the tasks ``2 * (left chunk * chunks + right chunk) + side``."""
        size, out = len(self.cell_of), []
        step = max(1, FLAGS // max(size, 1))
        mix = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        for at in range(0, len(node), step):
            part = slice(at, at + step)
            own_cell = cell[part]
            chunk = self.first[own_cell] + (mix[part] % self.chunks[own_cell].astype(np.uint64)).astype(int)
            # The bounds hold for both sides of a pair: it goes to the lower chunk's task with the higher one.
            near = self.replicas(rows[part], own_cell)[:, self.cell_of]
            left = near & (np.arange(size) >= chunk[:, None])
            right = near & (np.arange(size) < chunk[:, None])
            for own, to, of in zip(chunk, left, right, strict=True):
                out.append(
                    np.concatenate([2 * (own * size + np.flatnonzero(to)), 2 * (np.flatnonzero(of) * size + own) + 1])
                )
        return out

    def replicas(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Cells that may hold a partner of each vector."""
        apart = _distances(rows, self.pivots)
        own = apart[np.arange(len(rows)), cell]
        triangle = apart <= own[:, None] + 2 * self.eps + SLACK
        # Distance to the plane between both pivots; a pivot has none to itself.
        gap = np.maximum(self.between[cell], 1e-12)
        plane = (apart**2 - own[:, None] ** 2) / (2 * gap) <= self.eps + 1e-6
        near = triangle & plane & self.meet[cell]
        near[np.arange(len(rows)), cell] = True
        return near


def join_chunks(left: pd.DataFrame, right: pd.DataFrame, same: bool, cosine: float) -> pd.DataFrame:
    """The links between two chunks: how many each vector has, and stars."""
    a, b = unit_rows(left["v"]), unit_rows(right["v"])
    ids, others = left["node"].to_numpy(), right["node"].to_numpy()
    weight, weights = left["copies"].to_numpy(float), right["copies"].to_numpy(float)
    n, m = np.zeros(len(ids)), np.zeros(len(others))
    u = v = np.zeros(0, np.int64)
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    margin = ROUNDINGS * (a.shape[1] + 8) * 2.0**-24 if a.size else 0.0
    for at in range(0, len(ids) if len(others) else 0, BLOCK):
        score = a32[at : at + BLOCK] @ b32.T
        i, j = np.nonzero(score >= cosine - margin)
        near = score[i, j]
        i += at
        keep = i < j if same else np.ones(len(i), bool)
        unsure = np.flatnonzero(keep & (near < cosine + margin))
        keep[unsure] = np.einsum("ij,ij->i", a[i[unsure]], b[j[unsure]]) >= cosine
        i, j = i[keep], j[keep]
        n += np.bincount(i, weights[j], len(ids))
        m += np.bincount(j, weight[i], len(others))
        u, v = local_stars(np.concatenate([u, ids[i]]), np.concatenate([v, others[j]]))
    counts = pd.concat([pd.DataFrame({"u": ids, "n": n}), pd.DataFrame({"u": others, "n": m})])
    counts = counts[counts["n"] > 0].assign(v=pd.NA)
    stars = pd.DataFrame({"u": u, "v": v, "n": 0})
    both = pd.concat([counts[["u", "v", "n"]].astype(object), stars.astype(object)])
    return both.astype({"u": "int64", "v": "Int64", "n": "int64"})
