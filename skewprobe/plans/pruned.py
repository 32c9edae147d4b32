"""Searches that drop pairs early, by dimension blocks and running thresholds.

``mode="exact"`` uses only thresholds that cannot exceed a query's final k-th
score, so hits equal those of the unpruned search. Every threshold is fixed
before a pass starts, hence hits and counters do not depend on how rows are
spread over tasks, and one pass suffices.

Where the index has group summaries, the exact searches compare them first: a group whose bound is
below a query's threshold is not scored for that query, and not read if no query needs it.

``mode="compat"`` takes the k-th best *partial* score after each block as the
next threshold, and one pooled threshold for all queries. That may drop answers;
it exists to compare pruning counts. A threshold depends on all rows of a
partition, so each block takes a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewprobe.functions.keys import SEED
from skewprobe.functions.vectors import dim_blocks
from skewprobe.operators.groups import group_bounds
from skewprobe.operators.metrics import fill_loads, load_by
from skewprobe.operators.sampling import sample_per_group, uniform_sample
from skewprobe.operators.scan import (
    DECIMALS,
    SLACK,
    Probes,
    QueryBlock,
    by_part,
    counts_of,
    hits_of,
    query_blocks,
    scan,
)
from skewprobe.operators.topk import TOP_K, kth_threshold, topk
from skewprobe.plans.search import (
    HITS,
    NPROBE,
    full_search,
    open_visits,
    route_block,
    routed_topk,
    search_block,
    union_or_empty,
)
from skewprobe.session import broadcast_bytes, stage

# Dimension blocks, and the sizes of the warm-up sample.
NUM_BLOCKS = 4
WARMUP_QUERIES = 32
WARMUP_VECTORS = 1000

COUNTS = "part int, block int, load long, pruned long"
THRESHOLDS = "q_id long, part int, thr double"
PART_HITS = "q_id long, part int, vec_id long, score double"
# Bytes of a fetched pair of a query and a group.
PAIR_BYTES = 40

Visits = dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Pruned:
    """Hits, and pairs scored (``load``) and dropped per partition and block.

    A search by groups drops pairs before the first block only. ``groups`` then counts, for each partition, the
    pairs of a query and a group that were ``seen`` and ``skipped``.
    """

    hits: DataFrame
    counts: DataFrame
    groups: DataFrame | None = None

    def blocks(self) -> DataFrame:
        return self.counts.groupBy("block").agg(
            F.sum("load").alias("load"), F.sum("pruned").alias("pruned")
        )

    def partitions(self, every: DataFrame) -> DataFrame:
        return load_by(self.counts, "part", every, "load")


@dataclass(frozen=True)
class Stage:
    """Local hits of one set of (query, partition) pairs, and their final thresholds."""

    hits: DataFrame
    counts: DataFrame
    thresholds: DataFrame


def _check(mode: str, bound: str, groups: DataFrame | None = None) -> None:
    if mode not in ("exact", "compat"):
        raise ValueError("mode must be 'exact' or 'compat'")
    if bound not in ("abs", "norm"):
        raise ValueError("bound must be 'abs' or 'norm'")
    if groups is not None and mode != "exact":
        raise ValueError("groups prune in the exact mode only")


def bound_filter(pairs: DataFrame, thr: DataFrame, block: int, slack: float = 0.0) -> DataFrame:
    """Keep pairs that may still reach the threshold before ``block`` is scored.

    ``pairs`` carries block scores and suffix bounds, ``thr`` one threshold per
    ``q_id``.
    """
    partial = F.lit(0.0)
    for i in range(block):
        partial = partial + F.col(f"score_{i}")
    optimistic = F.round(partial + F.col(f"suffix_{block}"), DECIMALS)
    return pairs.join(thr.select("q_id", "thr"), "q_id").where(
        optimistic >= F.col("thr") - F.lit(slack)
    )


def prewarm_pooled(
    queries: DataFrame,
    base: DataFrame,
    k: int = TOP_K,
    n_q: int = WARMUP_QUERIES,
    n_v: int = WARMUP_VECTORS,
    seed: int = SEED,
) -> float:
    """k-th best score over all pairs of a query sample and a row sample.

    Minus infinity when there are fewer than ``k`` pairs.
    """
    sampled = uniform_sample(queries, "q_id", n_q, seed)
    rows = uniform_sample(base, "vec_id", n_v, seed)
    best = full_search(sampled, rows, k).orderBy(F.desc("score")).limit(k)
    found = best.agg(F.count("*").alias("n"), F.min("score").alias("thr")).first()
    return found["thr"] if found["n"] >= k else float("-inf")


def prewarm_per_query(
    queries: DataFrame,
    base: DataFrame,
    k: int = TOP_K,
    n_v: int = WARMUP_VECTORS,
    routes: DataFrame | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``q_id, thr``: each query's k-th best score within a row sample.

    With ``routes`` the sample is taken per partition and a query sees only the
    partitions it visits: a sample of other rows could overrate what they hold.
    A query with fewer than ``k`` sampled rows gets minus infinity.
    """
    if routes is None:
        sample = uniform_sample(base, "vec_id", n_v, seed)
        return kth_threshold(full_search(queries, sample, k).drop("rk"), ("q_id",), k, strict=True)
    sample = sample_per_group(base, "part", "vec_id", n_v, seed)
    hits = routed_topk(queries, sample, routes, k, ("q_id",)).drop("rk")
    return kth_threshold(hits, ("q_id",), k, strict=True)


def _raise_by_query(thr: np.ndarray, block: QueryBlock, hits: DataFrame, k: int) -> None:
    """Raise each query's threshold to the k-th score among ``hits``, once it has ``k``."""
    table = kth_threshold(hits, ("q_id",), k, strict=True).toArrow()
    where = block.positions(table["q_id"].to_numpy())
    thr[where] = np.maximum(thr[where], table["thr"].to_numpy())


def _kth_by_pair(scanned: DataFrame, k: int, strict: bool) -> DataFrame:
    """k-th local score of each (query, partition): one number per pair."""
    return kth_threshold(hits_of(scanned), ("q_id", "part"), k, strict)


def _by_pair(table: pa.Table, block: QueryBlock) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Thresholds per partition, as query positions and values."""
    where = block.positions(table["q_id"].to_numpy())
    values = table["thr"].to_numpy()
    for p, rows in by_part(table["part"].to_numpy()):
        yield p, where[rows], values[rows]


@dataclass(frozen=True)
class _Groups:
    """What a search by groups of one block of queries gives; the counts are per partition."""

    hits: list[DataFrame]
    counts: list[DataFrame]
    groups: list[pd.DataFrame]


def _search_groups(
    block: QueryBlock,
    base: DataFrame,
    groups: DataFrame,
    pairs: DataFrame,
    thr: np.ndarray | None,
    k: int,
    n_blocks: int,
) -> _Groups:
    """Score the groups of ``pairs`` (see :func:`group_bounds`) that can reach a query's threshold.

    Without ``thr``, each query first searches the group whose pivot it is nearest to; its k-th score there is
    the threshold for all others. The pairs are fetched in pieces within the broadcast bound.
    """
    pairs = stage(pairs, "pairs")
    pieces = max(1, -(-pairs.count() * PAIR_BYTES // broadcast_bytes(base.sparkSession)))
    units = base.select("vec_id", "embedding", F.col("cell").alias("part"))
    out = _Groups([], [], [])
    for piece in range(pieces):
        own = pairs if pieces == 1 else pairs.where(F.pmod("q", F.lit(pieces)) == piece)
        table = own.toArrow().to_pandas()
        if table.empty:
            continue
        q, cell = table["q"].to_numpy(), table["cell"].to_numpy()
        scored = np.ones(len(table), bool)
        scans, limits = [], thr
        if thr is None:
            order = np.lexsort((cell, -table["near"].to_numpy(), q))
            first = order[np.unique(q[order], return_index=True)[1]]
            warm = scan(units, Probes(block, open_visits(q[first], cell[first])), k, counters=True)
            scans.append(stage(warm, "scan"))
            limits = np.full(len(block.ids), -np.inf)
            _raise_by_query(limits, block, hits_of(scans[0]), k)
            scored = table["bound"].to_numpy() >= limits[q]
            scored[first] = False
        if scored.any():
            at, where = cell[scored], q[scored]
            visits = _visits(where, at, limits[where])
            visits = {c: (i, t[:, None]) for c, (i, t) in visits.items()}
            scans.append(stage(scan(units, Probes(block, visits), k, counters=True), "scan"))
        if thr is None:
            scored[first] = True
        rows = table.assign(skipped=~scored, pairs=np.where(scored, 0, table["n"]))
        out.groups.append(
            rows.groupby("part", as_index=False).agg(
                seen=("q", "size"), rows=("n", "sum"), skipped=("skipped", "sum"), pruned=("pairs", "sum")
            )
        )
        for scanned in scans:
            found = _with_parts(scanned, groups)
            out.hits.append(hits_of(found))
            loads = counts_of(found).select("part", "load", F.lit(0).cast("long").alias("pruned"))
            every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
            out.counts.append(loads.select("part", every, "load", "pruned"))
    return out


def _with_parts(scanned: DataFrame, groups: DataFrame) -> DataFrame:
    """A scan of cells with the partition of each."""
    cells = groups.select(F.col("cell").alias("__cell"), F.col("part").alias("__part"))
    joined = scanned.join(cells, scanned["part"] == cells["__cell"])
    return joined.withColumn("part", F.col("__part")).drop("__cell", "__part")


def _group_counts(found: list[pd.DataFrame], base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dropped pairs as counts of the first block, and pairs of queries and groups, per partition."""
    columns = ["part", "seen", "skipped", "pruned"]
    empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    table = pd.concat([empty, *[f[columns] for f in found]]).groupby("part", as_index=False).sum().astype("int64")
    rows = base.sparkSession.createDataFrame(table, "part long, seen long, skipped long, pruned long")
    rows = rows.withColumn("part", F.col("part").cast("int"))
    zero = F.lit(0).cast("long")
    counts = rows.select("part", F.lit(0).alias("block"), zero.alias("load"), "pruned")
    return counts, rows.select("part", "seen", "skipped")


def dimension_search(
    queries: DataFrame,
    base: DataFrame,
    k: int = TOP_K,
    n_blocks: int = NUM_BLOCKS,
    mode: str = "exact",
    bound: str = "abs",
    n_v: int = WARMUP_VECTORS,
    seed: int = SEED,
    sample: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> Pruned:
    """Top-k of the whole table, by blocks; the first block is scored for every row.

    ``sample`` replaces the warm-up rows of the exact mode; any rows of ``base``
    will do, and writing them once saves a pass per workload. With ``groups``, the summaries of an index
    whose rows have ``part`` and ``cell``, the exact mode prunes by groups instead of by pairs.
    """
    _check(mode, bound, groups)
    whole = base.select("vec_id", "embedding")
    if mode == "exact" and sample is None:
        sample = stage(uniform_sample(whole, "vec_id", n_v, seed), "sample")
    hits, counts, skipped = [], [], []
    for block in query_blocks(queries):
        ranges = dim_blocks(block.vectors.shape[1], n_blocks)
        limits = np.full((len(block.ids), n_blocks), -np.inf)
        if mode == "exact":
            thr = np.full(len(block.ids), -np.inf)
            warm = search_block(block, sample.select("vec_id", "embedding"), k).drop("rk")
            _raise_by_query(thr, block, warm, k)
            limits[:, 1:] = thr[:, None]
        else:
            for b in range(1, n_blocks):
                partial = scan(whole, Probes(block, None, limits), k, ranges, b, bound)
                for _, where, values in _by_pair(_kth_by_pair(partial, k, strict=False).toArrow(), block):
                    limits[where, b] = values
        if groups is not None:
            # Pairs below the threshold never leave the tasks, so they are counted from the summaries.
            found = _search_groups(
                block, base, groups, group_bounds(block, groups, None, thr), thr, k, n_blocks
            )
            hits.append(topk(union_or_empty(found.hits, base, PART_HITS), ("q_id",), k))
            counts += found.counts
            skipped.append(_skipped(found.groups, groups, len(block.ids)))
            continue
        slack = SLACK if mode == "exact" else 0.0
        done = stage(
            scan(whole, Probes(block, None, limits), k, ranges, None, bound, slack, True), "scan"
        )
        hits.append(topk(hits_of(done), ("q_id",), k))
        counts.append(counts_of(done))
    if groups is not None:
        dropped, seen = _group_counts(skipped, base)
        summed = _summed([*counts, dropped], base)
        return Pruned(union_or_empty(hits, base, HITS).drop("part"), summed, seen)
    return Pruned(
        union_or_empty(hits, base, HITS).drop("part"), union_or_empty(counts, base, COUNTS)
    )


def _skipped(found: list[pd.DataFrame], summaries: DataFrame, queries: int) -> pd.DataFrame:
    """All pairs of queries and groups per partition, those searched taken off."""
    every = summaries.groupBy("part").agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).toPandas()
    mine = pd.concat(found).groupby("part").sum() if found else pd.DataFrame(columns=["seen", "rows"])
    every = every.set_index("part")
    searched = mine["seen"].reindex(every.index).fillna(0) if found else 0
    rows = mine["rows"].reindex(every.index).fillna(0) if found else 0
    table = pd.DataFrame(
        {
            "seen": every["groups"] * queries,
            "skipped": every["groups"] * queries - searched,
            "pruned": every["rows"] * queries - rows,
        }
    )
    return table.reset_index()


def _summed(counts: list[DataFrame], base: DataFrame) -> DataFrame:
    """Counts of several passes over a partition add up."""
    return union_or_empty(counts, base, COUNTS).groupBy("part", "block").agg(
        F.sum("load").alias("load"), F.sum("pruned").alias("pruned")
    )


def _stage_pass(
    base: DataFrame,
    block: QueryBlock,
    visits: Visits,
    ranges: list[tuple[int, int]],
    k: int,
    mode: str,
    bound: str,
    final: bool = True,
    written: bool = True,
) -> tuple[DataFrame, list[DataFrame], np.ndarray]:
    """Search the visited partitions.

    Returns the written scan; tables ``q_id, part, thr`` of what the thresholds rise to, if they are to be
    ``written``; and the highest threshold of each query. Without ``final`` they leave out what the last scores add.
    """
    n = len(ranges)
    limits = {p: np.repeat(thr[:, None], n, axis=1) for p, (_, thr) in visits.items()}
    raised: list[DataFrame] = []
    highest = np.full(len(block.ids), -np.inf)

    def found(scanned: DataFrame, strict: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        kth = _kth_by_pair(scanned, k, strict)
        if written:
            kth = stage(kth, "kth")
            raised.append(kth)
        for p, where, values in _by_pair(kth.select("q_id", "part", "thr").toArrow(), block):
            highest[where] = np.maximum(highest[where], values)
            yield p, where, values

    def probes() -> Probes:
        return Probes(block, {p: (where, limits[p]) for p, (where, _) in visits.items()})

    if mode == "compat":
        for b in range(1, n):
            for p, where, values in found(scan(base, probes(), k, ranges, b, bound), strict=False):
                at = np.searchsorted(visits[p][0], where)
                limits[p][at, b:] = np.maximum(limits[p][at, b:], values[:, None])
    slack = SLACK if mode == "exact" else 0.0
    done = stage(scan(base, probes(), k, ranges, None, bound, slack, True), "scan")
    if final and written:
        raised.append(stage(_kth_by_pair(done, k, strict=mode == "exact"), "kth"))
    elif final:
        for _ in found(done, strict=mode == "exact"):
            pass
    return done, raised, highest


def _visits(where: np.ndarray, parts: np.ndarray, thr: np.ndarray) -> Visits:
    """Ascending query positions and their thresholds, per partition."""
    found = {}
    for p, rows in by_part(parts):
        rows = rows[np.argsort(where[rows])]
        found[p] = where[rows], thr[rows]
    return found


def dimension_pipeline(
    queries: DataFrame,
    base: DataFrame,
    probes: DataFrame,
    k: int = TOP_K,
    n_blocks: int = NUM_BLOCKS,
    mode: str = "exact",
    bound: str = "abs",
) -> Stage:
    """Pruned local top-k within each (query, partition) of ``probes``.

    ``probes`` has ``q_id, part, thr``; the threshold applies from the first
    block on and never falls. An empty partition has no hits and keeps its
    threshold.
    """
    _check(mode, bound)
    probes = probes.select("q_id", F.col("part").cast("int").alias("part"), F.col("thr").cast("double").alias("thr"))
    hits, counts, after = [], [], []
    # A visit is sent along with a threshold for each block.
    for block in query_blocks(queries, visits=probes, visit_bytes=8 * (n_blocks + 1)):
        ranges = dim_blocks(block.vectors.shape[1], n_blocks)
        own = block.own(probes)
        table = own.toArrow()
        where = block.positions(table["q_id"].to_numpy())
        visits = _visits(where, table["part"].to_numpy(), table["thr"].to_numpy())
        done, raised, _ = _stage_pass(base, block, visits, ranges, k, mode, bound)
        hits.append(topk(hits_of(done), ("q_id", "part"), k))
        counts.append(counts_of(done))
        rises = union_or_empty(raised, base, THRESHOLDS).groupBy("q_id", "part").agg(F.max("thr").alias("__to"))
        risen = own.join(rises, ["q_id", "part"], "left")
        after.append(risen.select("q_id", "part", F.greatest("thr", "__to").alias("thr")))
    return Stage(
        union_or_empty(hits, base, HITS),
        union_or_empty(counts, base, COUNTS),
        union_or_empty(after, base, THRESHOLDS),
    )


def vector_pipeline(
    queries: DataFrame,
    base: DataFrame,
    routes: DataFrame,
    thr: float | DataFrame,
    k: int = TOP_K,
    n_blocks: int = NUM_BLOCKS,
    mode: str = "exact",
    bound: str = "abs",
) -> Stage:
    """All queries routed at one probe rank, over all partitions at once.

    ``routes`` has ``q_id, part``, one row per query; ``thr`` is one number for
    all queries or a table ``q_id, thr``.
    """
    pairs = routes.select("q_id", "part")
    if isinstance(thr, DataFrame):
        start = F.coalesce("thr", F.lit(float("-inf")))
        pairs = pairs.join(thr, "q_id", "left").withColumn("thr", start)
    else:
        pairs = pairs.withColumn("thr", F.lit(float(thr)))
    return dimension_pipeline(queries, base, pairs, k, n_blocks, mode, bound)


def carry_thresholds(
    before: DataFrame, hits: DataFrame, after: DataFrame, k: int = TOP_K
) -> DataFrame:
    """Thresholds for the next probe: the largest of three.

    The old one, the k-th of all hits so far once there are ``k``, and the final
    one of the partition just searched.
    """
    merged = kth_threshold(hits, ("q_id",), k, strict=True).withColumnRenamed("thr", "merged")
    local = after.groupBy("q_id").agg(F.max("thr").alias("local"))
    joined = before.join(merged, "q_id", "left").join(local, "q_id", "left")
    return joined.select("q_id", F.greatest("thr", "merged", "local").alias("thr"))


def full_pipeline(
    queries: DataFrame,
    base: DataFrame,
    centroids: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    n_blocks: int = NUM_BLOCKS,
    mode: str = "exact",
    bound: str = "abs",
    n_q: int = WARMUP_QUERIES,
    n_v: int = WARMUP_VECTORS,
    seed: int = SEED,
    sample: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> Pruned:
    """Prewarm, route, then search the routed partitions best first with carried thresholds.

    ``base`` carries ``part``. ``sample`` replaces the warm-up rows of the exact
    mode; any rows of ``base``, with their ``part``, will do.

    With ``groups``, the summaries of an index whose rows also have ``cell``, the exact mode warms up on the group that a
    query is nearest to, and one more pass searches those of its other routed groups that can
    still reach the threshold found there; two passes, whatever ``nprobe``.
    """
    _check(mode, bound, groups)
    if groups is not None:
        return _full_by_groups(queries, base, centroids, k, nprobe, n_blocks, groups)
    pooled = prewarm_pooled(queries, base, k, n_q, n_v, seed) if mode == "compat" else None
    if mode == "exact" and sample is None:
        sample = stage(sample_per_group(base, "part", "vec_id", n_v, seed), "sample")

    hits, counts = [], []
    # A query has a threshold for each block and visit of a pass, and its routes.
    for block in query_blocks(queries, extra=8 * (n_blocks + 1) + 24 * nprobe):
        ranges = dim_blocks(block.vectors.shape[1], n_blocks)
        where, parts, ranks = route_block(block, centroids, nprobe)
        thr = np.full(len(block.ids), -np.inf if pooled is None else pooled)
        if mode == "exact":
            warm = search_block(block, sample, k, open_visits(where, parts)).drop("rk")
            _raise_by_query(thr, block, warm, k)

        found: list[DataFrame] = []
        last = ranks.max(initial=0)
        for rank in range(1, last + 1):
            now = ranks == rank
            visits = _visits(where[now], parts[now], thr[where[now]])
            # The k-th of the merged hits, below, covers that of the exact mode.
            carry = mode == "compat" and rank < last
            done, _, highest = _stage_pass(base, block, visits, ranges, k, mode, bound, carry, False)
            found.append(hits_of(done))
            counts.append(counts_of(done))
            if rank < last:
                thr = np.maximum(thr, highest)
                _raise_by_query(thr, block, union_or_empty(found, base, HITS), k)
        if found:
            hits.append(topk(union_or_empty(found, base, HITS), ("q_id",), k))
    return Pruned(union_or_empty(hits, base, HITS), _summed(counts, base))


def _full_by_groups(
    queries: DataFrame, base: DataFrame, centroids: DataFrame, k: int, nprobe: int, n_blocks: int, groups: DataFrame
) -> Pruned:
    hits, counts, seen = [], [], []
    for block in query_blocks(queries, extra=24 * nprobe):
        where, parts, _ = route_block(block, centroids, nprobe)
        pairs = group_bounds(block, groups, open_visits(where, parts))
        found = _search_groups(block, base, groups, pairs, None, k, n_blocks)
        hits.append(topk(union_or_empty(found.hits, base, PART_HITS), ("q_id",), k))
        counts += found.counts
        seen += found.groups
    dropped, seen = _group_counts(seen, base)
    return Pruned(union_or_empty(hits, base, HITS), _summed([*counts, dropped], base), seen)


def routing_load(routes: DataFrame, centroids: DataFrame) -> DataFrame:
    """Queries routed to each partition; unvisited ones count 0."""
    return fill_loads(load_by(routes, "part"), centroids, "part")
