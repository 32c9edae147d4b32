"""The one scan all searches share: stored vectors against a block of queries.

The stored table is read where it lies and never shuffled, whatever its layout
and however many rows one partition or one group of copies holds. A block of
queries of checked size is broadcast; each task multiplies its Arrow batches
with it and keeps only the best ``k`` rows per (query, partition), or per query where the
partitions do not matter, so no pair row is ever formed. A task whose best rows outgrow
the bound of its memory hands them on and starts anew; the ranking afterwards sorts that out.

Scores are rounded to ``DECIMALS`` places before they are compared. Summation
order inside a matrix product depends on batch shape, and equal vectors must get
equal scores if ties are to be broken by ``vec_id`` alone.

A stored vector with a null, NaN or infinite component is left out of the search,
that row only; a query with one has no hits.

Most pairs are settled by a single precision product with a proven error margin;
only those within the margin of a decision, and the hits, are summed in double.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewprobe.session import STATE_BYTES, broadcast_bytes, state_bytes

DECIMALS = 9
# Tolerance of a sound bound against differently ordered sums.
SLACK = 1e-9
# Pairs and rows worked on at a time inside a task: keeps the work in the cache
# and bounds its memory, not its result.
TILE_PAIRS, TILE_ROWS = 1 << 18, 1024
# Below this share of live pairs, single pairs are cheaper than a full product.
SPARSE_SHARE = 0.05

# Bytes of a visit without thresholds: a query and a partition.
VISIT_BYTES = 16

SCHEMA = "q_id long, part int, vec_id long, score double, block int, load long, pruned long"
ARROW_SCHEMA = pa.schema(
    [
        ("q_id", pa.int64()),
        ("part", pa.int32()),
        ("vec_id", pa.int64()),
        ("score", pa.float64()),
        ("block", pa.int32()),
        ("load", pa.int64()),
        ("pruned", pa.int64()),
    ]
)


@dataclass
class QueryBlock:
    """Queries that fit one broadcast: those whose id hashes to ``slot`` of ``slots``."""

    ids: np.ndarray
    vectors: np.ndarray
    slot: int = 0
    slots: int = 1
    sent: Broadcast | None = field(default=None, repr=False)

    def send(self, context: SparkContext) -> Broadcast:
        """The block as a broadcast, made once however many passes use it."""
        if self.sent is None:
            self.sent = context.broadcast((self.ids, self.vectors))
        return self.sent

    def positions(self, ids: np.ndarray) -> np.ndarray:
        order = np.argsort(self.ids)
        return order[np.searchsorted(self.ids, ids, sorter=order)]

    def own(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose ``q_id`` belongs to this block."""
        return df if self.slots == 1 else df.where(_slot(self.slots) == self.slot)


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col("q_id").cast("long")), F.lit(slots))


@dataclass
class Probes:
    """Which queries visit which partition, and the thresholds they bring.

    ``by_part`` maps a partition to query positions and a thresholds array of one
    row per query and one column per block; None means every query visits every
    partition with the thresholds in ``everywhere``. A search without blocks takes the first
    column: rows that score less are of no use.
    """

    block: QueryBlock
    by_part: dict[int, tuple[np.ndarray, np.ndarray | None]] | None = None
    everywhere: np.ndarray | None = None

    def of(self, part: int) -> tuple[np.ndarray, np.ndarray | None] | None:
        if self.by_part is not None:
            return self.by_part.get(part)
        return np.arange(len(self.block.ids)), self.everywhere


@dataclass(frozen=True)
class Pruning:
    blocks: Sequence[tuple[int, int]]
    upto: int
    bound: str
    slack: float


class _Best:
    """The best ``k`` rows so far for each probe of one partition, or of all (``part`` None)."""

    def __init__(self, queries: np.ndarray, k: int, steps: int, part: int | None):
        self.queries, self.part = queries, part
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.parts = np.zeros((len(queries), k), np.int32) if part is None else None
        self.loads, self.drops = np.zeros(steps, dtype=np.int64), np.zeros(steps, dtype=np.int64)

    @property
    def bytes(self) -> int:
        return self.scores.nbytes + self.ids.nbytes + (self.parts.nbytes if self.part is None else 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a rows x dimensions array, in the stored precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = len(flat) // len(column)
    lengths = column.value_lengths()
    if lengths.null_count or not (lengths.to_numpy() == dim).all():
        raise ValueError("vectors must be present and of one length")
    return flat.reshape(len(column), dim)


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition with the indexes of its rows, in row order."""
    order = np.argsort(parts, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
        if len(rows):
            yield int(parts[rows[0]]), rows


def query_blocks(
    queries: DataFrame, id: str = "q_id", vector: str = "qv",
    visits: DataFrame | None = None, visit_bytes: int = VISIT_BYTES, extra: int = 0,
) -> Iterator[QueryBlock]:
    """The query set in blocks of at most the broadcast bound.

    Normally one block. A larger set is cut by a hash of the id, with the block
    sizes counted before any of them is fetched. ``visits`` (``q_id``) are sent along with the
    queries, ``visit_bytes`` each, and count as well, as do ``extra`` bytes for each query. Only a single
    query may be over the bound.
    """
    table = queries.select(
        F.col(id).cast("long").alias("q_id"), F.col(vector).cast("array<double>").alias("qv")
    )
    size = table.agg(F.count("*").alias("n"), F.max(F.size("qv")).alias("dim")).first()
    if not size["n"]:
        return
    most = broadcast_bytes(queries.sparkSession)
    row_bytes = 8 * (size["dim"] + 1) + extra
    total = row_bytes * size["n"]
    rows = table.select("q_id", F.lit(1).alias("query"), F.lit(row_bytes).cast("long").alias("bytes"))
    if visits is not None:
        total += visit_bytes * visits.count()
        more = visits.select("q_id", F.lit(0).alias("query"), F.lit(visit_bytes).cast("long").alias("bytes"))
        rows = rows.unionByName(more)
    slots = max(1, -(-total // most))
    while slots > 1:
        sizes = rows.groupBy(_slot(slots).alias("slot")).agg(F.sum("query").alias("n"), F.sum("bytes").alias("bytes"))
        if sizes.where((F.col("n") > 1) & (F.col("bytes") > most)).isEmpty():
            break
        slots *= 2
    for slot in range(slots):
        part = table if slots == 1 else table.where(_slot(slots) == slot)
        fetched = part.toArrow()
        if fetched.num_rows:
            vectors = matrix(fetched["qv"])
            # All NaN beats no threshold, one infinite component might.
            vectors = np.where(np.isfinite(vectors).all(axis=1, keepdims=True), vectors, np.nan)
            yield QueryBlock(fetched["q_id"].to_numpy(), vectors, slot, slots)


def scan(
    base: DataFrame,
    probes: Probes,
    k: int,
    blocks: Sequence[tuple[int, int]] | None = None,
    upto: int | None = None,
    bound: str | None = None,
    slack: float = 0.0,
    counters: bool = False,
    merged: bool = False,
) -> DataFrame:
    """One pass over ``base`` (``vec_id``, ``embedding``, optionally ``part``).

    Without ``bound`` the rows hold the local top-k by full score. With ``bound``
    (``abs`` or ``norm``) a pair is dropped before a block when its score so far
    plus the bound of the remaining dimensions is below the threshold the probe
    brings for that block. Only the first ``upto`` blocks are scored when the
    thresholds of later ones are not yet known; ``score`` is then partial.

    With ``counters`` there are also rows with ``block`` set, holding the pairs
    scored and dropped by that task; hits have ``block`` null. With ``merged``, for a search in which
    every query visits every partition, a task keeps ``k`` rows per query over all partitions.
    """
    if merged and (counters or probes.by_part is not None):
        raise ValueError("partitions can be merged only in a plain search of all of them")
    part = F.col("part").cast("int") if "part" in base.columns else F.lit(0)
    table = base.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", part.alias("part")
    )
    if probes.by_part is not None:
        # Reaches the files as a partition filter when the table is laid out by part.
        table = table.where(F.col("part").isin([int(p) for p in probes.by_part]))
    context = base.sparkSession.sparkContext
    queries = probes.block.send(context)
    visits = context.broadcast((probes.by_part, probes.everywhere))
    prune = None if bound is None else Pruning([tuple(b) for b in blocks], upto or len(blocks), bound, slack)
    limit = state_bytes(base.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Probes(QueryBlock(*queries.value), *visits.value)
        yield from _scan_task(batches, mine, k, prune, counters, merged, limit)

    return table.mapInArrow(run, SCHEMA)


def hits_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("block is null").select("q_id", "part", "vec_id", "score")


def counts_of(scanned: DataFrame) -> DataFrame:
    """Pairs scored and dropped per partition and block."""
    return (
        scanned.where("block is not null")
        .groupBy("part", "block")
        .agg(F.sum("load").alias("load"), F.sum("pruned").alias("pruned"))
    )


# --- inside a task ----------------------------------------------------------


def _scan_task(batches, probes, k, prune, counters, merged=False, limit=STATE_BYTES):
    steps = prune.upto if prune else 1
    best: dict[int | None, _Best] = {}
    held = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = matrix(batch.column(1))
        parts = batch.column(2).to_numpy(zero_copy_only=False)
        in_order = np.argsort(ids, kind="stable")
        in_order = in_order[np.isfinite(vectors).all(axis=1)[in_order]]
        ids, vectors, parts = ids[in_order], vectors[in_order], parts[in_order]
        for part, rows in [(None, slice(None))] if merged else by_part(parts):
            visit = probes.of(part)
            if visit is None or not len(ids):
                continue
            queries, thresholds = visit
            if part not in best:
                state = _Best(queries, k, steps, part)
                if best and held + state.bytes > limit:
                    yield from _handed_on(best, probes, counters)
                    best, held = {}, 0
                best[part], held = state, held + state.bytes
            _visit(best[part], ids[rows], vectors[rows], parts[rows], probes.block.vectors, thresholds, prune)
    yield from _handed_on(best, probes, counters)


def _handed_on(best, probes, counters):
    for part, found in best.items():
        q, pos = np.nonzero(found.scores > -np.inf)
        yield _rows(
            len(q),
            q_id=probes.block.ids[found.queries[q]],
            part=found.parts[q, pos] if part is None else np.full(len(q), part, dtype=np.int32),
            vec_id=found.ids[q, pos],
            score=found.scores[q, pos],
        )
        if counters:
            n = len(found.loads)
            yield _rows(
                n,
                part=np.full(n, part, dtype=np.int32),
                block=np.arange(n, dtype=np.int32),
                load=found.loads,
                pruned=found.drops,
            )


def _rows(n: int, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type)
            for f in ARROW_SCHEMA
        ],
        schema=ARROW_SCHEMA,
    )


def _visit(best, ids, vectors, parts, all_queries, thresholds, prune):
    """Score one run of rows, in id order, tile by tile."""
    rows_per = min(len(ids), TILE_ROWS)
    probes_per = max(1, TILE_PAIRS // rows_per)
    for lo in range(0, len(best.queries), probes_per):
        chosen = slice(lo, lo + probes_per)
        q = all_queries[best.queries[chosen]]
        for start in range(0, len(ids), rows_per):
            rows = slice(start, start + rows_per)
            tile = _Tile(q, vectors[rows])
            floor = None
            if prune is None:
                best.loads[0] += len(q) * len(tile.v)
                live = None
                if thresholds is not None:
                    floor = thresholds[chosen, 0]
            else:
                live = _live_pairs(tile, thresholds[chosen], prune, best)
            for pq, pv, scores in _contenders(tile, ids[rows], best, chosen, live, floor):
                _keep(best, lo + pq, ids[rows][pv], scores, parts[rows][pv])


class _Tile:
    """Some queries, some rows, and how far a rough score may be off."""

    def __init__(self, q: np.ndarray, v: np.ndarray):
        self.q, self.v = q, v
        lengths = np.linalg.norm(q, axis=1)
        longest = np.linalg.norm(v, axis=1).max(initial=0.0)
        safe = lengths.max(initial=0.0) * longest < 1e30
        self.type = np.float32 if safe else np.float64
        # A sum of d products is off by at most about d roundings of |q||v|.
        # Partial sums and bounds add a few more; the factor 4 covers them all.
        margin = 4 * (q.shape[1] + 8) * 2.0**-24 * lengths * longest + 10.0**-DECIMALS
        # Zero times an overflowed length tells nothing, so every pair is to be summed.
        self.margin = np.where(np.isnan(margin), np.inf, margin)
        self.rq, self.rv = q.astype(self.type), v.astype(self.type, copy=False)

    def exact(self, pq, pv, start=0, end=None, absolute=False):
        """Double precision sums for single pairs, a slice of pairs at a time."""
        out = np.empty(len(pq))
        for lo in range(0, len(pq), 1 << 15):
            some = slice(lo, lo + (1 << 15))
            a, b = self.q[pq[some], start:end], self.v[pv[some], start:end].astype(np.float64)
            if absolute:
                a, b = np.abs(a), np.abs(b)
            np.einsum("ij,ij->i", a, b, out=out[some])
        return out


def _contenders(tile, ids, best, chosen, live, floor=None):
    """Pairs that may enter the best rows of their probe, with exact rounded scores.

    ``live`` restricts the pairs: None for all, a matrix, or lists with scores. Pairs below
    ``floor`` may be left out.
    """
    if isinstance(live, tuple):
        pq, pv, scores = live
        yield _beating(pq, pv, np.round(scores, DECIMALS), ids, best, chosen)
        return
    k, n = best.scores.shape[1], len(tile.v)
    end = tile.scored if live is not None else None
    worst = best.scores[chosen, -1]
    if floor is not None:
        worst = np.maximum(worst, floor)
    mask = tile.partial if live is not None else tile.rq @ tile.rv.T
    mask = mask >= (worst - tile.margin).astype(tile.type)[:, None]
    if live is not None:
        mask &= live
    pq, pv = np.divmod(np.flatnonzero(mask), n)
    if len(pq) > mask.size // 64:
        # A probe with many contenders, such as one near a group of copies or one
        # that has no hits yet, is cheaper to score and select as a whole.
        crowded = np.bincount(pq, minlength=len(tile.q)) > max(4 * k, n // 64)
        whole = np.flatnonzero(crowded)
        scores = np.round(tile.q[whole, :end] @ tile.v[:, :end].astype(np.float64).T, DECIMALS)
        scores[~mask[whole]] = -np.inf
        at, row = _promising(scores, ids, best.scores[chosen][whole], best.ids[chosen][whole])
        yield whole[at], row, scores[at, row]
        few = ~crowded[pq]
        pq, pv = pq[few], pv[few]
    yield _beating(pq, pv, np.round(tile.exact(pq, pv, 0, end), DECIMALS), ids, best, chosen)


def _beating(pq, pv, scores, ids, best, chosen):
    worst, worst_id = best.scores[chosen, -1][pq], best.ids[chosen, -1][pq]
    better = (scores > worst) | ((scores == worst) & (ids[pv] < worst_id))
    return pq[better], pv[better], scores[better]


def _live_pairs(tile, limits, prune, best):
    """Filter, then add a partial product, block by block.

    Leaves the pairs that survive: a matrix beside ``tile.partial``, or lists of
    queries, rows and exact scores once few are left.
    """
    blocks, by_abs = prune.blocks, prune.bound == "abs"
    if by_abs:
        aq, av = np.abs(tile.rq), np.abs(tile.rv)
    else:
        # Lengths per block: the inner product of the tails bounds the rest.
        lq = np.stack([np.linalg.norm(tile.q[:, s:e], axis=1) for s, e in blocks], axis=1)
        v = tile.v.astype(np.float64)
        lv = np.stack([np.linalg.norm(v[:, s:e], axis=1) for s, e in blocks], axis=1)
        aq, av = lq.astype(tile.type), lv.astype(tile.type)

    def rest(pq, pv, b):
        """Exact bound of the blocks from ``b`` on, for single pairs."""
        if by_abs:
            return tile.exact(pq, pv, blocks[b][0], None, absolute=True)
        return np.einsum("ij,ij->i", lq[pq, b:], lv[pv, b:])

    shape = len(tile.q), len(tile.v)
    tile.partial = np.zeros(shape, dtype=tile.type)
    live = np.ones(shape, dtype=bool)
    pairs = None
    for b, (s, e) in enumerate(blocks[: prune.upto]):
        limit = limits[:, b] - prune.slack
        if pairs is None and (limit > -np.inf).any():
            cut = slice(s, None) if by_abs else slice(b, None)
            rough = aq[:, cut] @ av[:, cut].T
            rough += tile.partial
            before = np.count_nonzero(live)
            live &= rough >= (limit - tile.margin).astype(tile.type)[:, None]
            unsure = rough < (limit + tile.margin).astype(tile.type)[:, None]
            unsure &= live
            pq, pv = np.divmod(np.flatnonzero(unsure), shape[1])
            bound = np.round(tile.exact(pq, pv, 0, s) + rest(pq, pv, b), DECIMALS)
            out = bound < limit[pq]
            live[pq[out], pv[out]] = False
            left = np.count_nonzero(live)
            best.drops[b] += before - left
            if left < SPARSE_SHARE * live.size:
                pq, pv = np.divmod(np.flatnonzero(live), shape[1])
                pairs = pq, pv, tile.exact(pq, pv, 0, s)
        elif pairs is not None:
            pq, pv, score = pairs
            keep = np.round(score + rest(pq, pv, b), DECIMALS) >= limit[pq]
            best.drops[b] += len(pq) - int(keep.sum())
            pairs = pq[keep], pv[keep], score[keep]
        if pairs is None:
            best.loads[b] += np.count_nonzero(live)
            tile.partial += tile.rq[:, s:e] @ tile.rv[:, s:e].T
            tile.scored = e
        else:
            pq, pv, score = pairs
            best.loads[b] += len(pq)
            pairs = pq, pv, score + tile.exact(pq, pv, s, e)
            if len(pq) == 0:
                break
    return live if pairs is None else pairs


def _promising(scores, ids, kept, kept_ids):
    """At most ``k`` pairs per probe that can enter its best rows; ``ids`` ascend."""
    k = kept.shape[1]
    worst, worst_id = kept[:, -1:], kept_ids[:, -1:]
    mask = (scores > worst) | ((scores == worst) & (ids < worst_id))
    crowded = np.flatnonzero(mask.sum(axis=1) > k)
    if len(crowded):
        some = np.where(mask[crowded], scores[crowded], -np.inf)
        kth = np.partition(some, -k, axis=1)[:, -k, None]
        above, tied = some > kth, some == kth
        room = k - above.sum(axis=1, keepdims=True)
        mask[crowded] = above | (tied & (np.cumsum(tied, axis=1) <= room))
    return np.divmod(np.flatnonzero(mask), scores.shape[1])


def _keep(best, probes, ids, scores, parts):
    """Merge pairs into the best rows: highest score first, then lowest id."""
    if len(probes) == 0:
        return
    k = best.scores.shape[1]
    touched = np.unique(probes)
    probe = np.concatenate([probes, np.repeat(touched, k)])
    score = np.concatenate([scores, best.scores[touched].ravel()])
    ident = np.concatenate([ids, best.ids[touched].ravel()])
    order = np.lexsort((ident, -score, probe))
    starts = np.searchsorted(probe[order], touched)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    first = order[place < k]
    best.scores[touched] = score[first].reshape(-1, k)
    best.ids[touched] = ident[first].reshape(-1, k)
    if best.parts is not None:
        part = np.concatenate([parts, best.parts[touched].ravel()])
        best.parts[touched] = part[first].reshape(-1, k)
