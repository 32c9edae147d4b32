"""Connected components of a link table, by alternating stars.

Each round joins every node's neighbours to the smallest of them, first above
and then below the node, until the links are stars around the smallest node
of each component. Every round is written, so no lineage builds up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewprobe.session import stage

# The neighbours of one node are dealt over as many keys.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``links`` (``u, v`` long) the smallest one it reaches.

    Links may repeat and may point either way; a link of a node to itself only makes it known.
    """
    # Written once: finding links costs more than reading them, and each round below reads its edges several times.
    links = stage(links.select("u", "v"), "links")
    loops = links.select(F.col("u").alias("node")).union(links.select("v"))
    nodes = stage(loops.distinct(), "nodes")
    edges = stage(_ordered(links), "edges")
    mark = None
    while True:
        edges = stage(_small_star(stage(_large_star(edges), "stars")), "stars")
        # The same links in the same number, twice in a row: nothing moved.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node ``u`` to the smaller ``v``."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pairs.distinct()


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds ``m``, the least of ``u`` and all its ``v``; the neighbours of one ``u`` are dealt out."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return pairs.withColumn("salt", salt).join(least, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every link already points to the smaller node.
    met = _with_least(edges)
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components from fewer links: each node of ``u, v`` with its root, roots left out."""
    if not len(u):
        return u, v
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # Hook the roots of both ends, then shorten the paths.
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
    apart = np.flatnonzero(root != np.arange(len(names)))
    return names[apart], names[root[apart]]
