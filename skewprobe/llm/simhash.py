"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints that differ in at most T bits differ, for every way of giving
the m groups of bits thresholds that sum to T - m + 1, in at most its threshold
within one of the groups (a threshold of -1 never fits). So each
fingerprint looks up, in each group, the values within its threshold.

Bits that go together are put into one group. The thresholds are chosen for
each fingerprint by dynamic programming over the groups, on the number of
lookups and of candidates that the counts of both halves of a group predict;
thus a value that very many fingerprints share is looked up with a lower
threshold than a rare one. Candidates are verified on all bits.

Equal fingerprints are one node throughout. Links are reduced to stars where
they are found, since only the components are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.common import replaced
from skewprobe.llm.components import components, local_stars
from skewprobe.session import stage

BITS = 64
SEED = 42
DISTANCE = 3
# Groups of bits that are weighed against each other.
GROUPS = (2, 3, 4)
# What it costs to verify one candidate, in lookups (a lookup is a shuffled row).
VERIFY = 0.05
# Rows of one key that are compared at once; longer keys are cut into tiles.
TILE = 4096
# Verified links that are held before they are reduced to stars.
HELD = 1 << 20
CHUNK = 1 << 17
LOOKUPS = "part int, value long, fp long, kind int"
DATA, PROBE, BOTH = 1, 2, 3


def fingerprint(text: bytes | None, words: int, seed: int = SEED) -> int:
    """The 64-bit SimHash of all shingles of ``words`` words, repeats included, unsigned.

    A-Z is lower-cased, words end at ASCII white space. A bit is 1 if it is
    set in over half the hashes. A text of fewer words is one shingle; one without words has 0.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    size = min(words, len(found))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - size + 1].tolist()
    hashes = np.fromiter(
        (
            xxhash.xxh64_intdigest(joined[a:b], seed)
            for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)
        ),
        np.uint64,
        len(starts),
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # 1 MB of unpacked bits
        part = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: Column, words: int) -> Column:
    @pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        found = [fingerprint(None if t is None else t.encode(), words) for t in texts]
        return pd.Series(np.array(found, np.uint64).view(np.int64))

    return signed(text)


@dataclass(frozen=True)
class Plan:
    """The bits of each group, and how often each value of both halves of a group occurs."""

    groups: tuple[tuple[int, ...], ...]
    counts: tuple[tuple[np.ndarray, np.ndarray], ...]
    total: int
    distance: int


def simhash_groups(
    docs: DataFrame, words: int = 3, distance: int = DISTANCE, groups: tuple[int, ...] = GROUPS
) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``docs`` needs ``doc_id`` and ``text``. Fingerprints link at ``distance`` or
    fewer differing bits; ``component_id`` is the smallest ``doc_id`` that can
    be reached over links, equal fingerprints included.

    Null and empty texts and those without words have fingerprint zero, which links
    like any other. A null id belongs to its component but does not name it; a component
    of null ids alone has a null ``component_id``. Repeated rows are equal documents. An
    empty table gives an empty one. Columns named like the result are replaced.
    """
    out = _classified(docs, words, distance, groups)
    named = {"fingerprint": F.lower(F.lpad(F.hex("__fp"), 16, "0")), "component_id": F.col("__id")}
    return replaced(out, named).drop("__fp", "__root", "__id", "__heads")


def simhash_ids(
    docs: DataFrame, words: int = 3, distance: int = DISTANCE, groups: tuple[int, ...] = GROUPS
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of each row, as in :func:`simhash_groups`.

    Without the other columns the texts are read and hashed once.
    """
    slim, classes = _classes(docs, words, distance, groups)
    named = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return slim.join(classes, slim["fp"] == classes["__f"]).select("doc_id", named, F.col("__id").alias("component_id"))


def keep_one(docs: DataFrame, words: int, distance: int = DISTANCE, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """``docs`` with one document of each component: the one that names it.

    Rules as for :func:`simhash_groups`. Of repeated rows with that id one
    stays, and of a component of null ids one row.
    """
    heads = _classified(docs, words, distance, groups).where(F.col("doc_id").eqNullSafe(F.col("__id")))
    # Only ids that repeat need a shuffle of their rows.
    single, several = heads.where("__heads = 1"), heads.where("__heads > 1").dropDuplicates(["__root"])
    return single.unionByName(several).drop("__fp", "__root", "__id", "__heads")


def _classes(
    docs: DataFrame, words: int, distance: int, groups: tuple[int, ...]
) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row, and the component of each fingerprint, both written."""
    slim = stage(docs.select("doc_id", simhash(F.col("text"), words).alias("fp")), "fingerprints")
    nodes = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = stage(nodes, "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), distance, groups))
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    known = stage(known, "fingerprint-roots")
    names = known.groupBy("root").agg(F.min("first").alias("id"))
    classes = stage(known.join(names, "root").select("fp", "root", "id"), "classes")
    # How many rows carry the id of their component.
    heads = (
        slim.join(classes, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("id")))
        .groupBy("root")
        .agg(F.count("*").alias("heads"))
    )
    classes = classes.join(heads, "root", "left").select(
        F.col("fp").alias("__f"), F.col("root").alias("__root"),
        F.col("id").alias("__id"), F.col("heads").alias("__heads"),
    )
    return slim, stage(classes, "classes")


def _classified(docs: DataFrame, words: int, distance: int, groups: tuple[int, ...]) -> DataFrame:
    _, classes = _classes(docs, words, distance, groups)
    # Hashed again: that costs less than to send the texts along.
    rows = docs.withColumn("__fp", simhash(F.col("text"), words))
    return rows.join(classes, F.col("__fp") == F.col("__f"), "left").drop("__f")


def links(nodes: DataFrame, distance: int = DISTANCE, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """``u, v``: links between different fingerprints ``fp`` that join what is within ``distance``."""
    plan = make_plan(nodes, distance, groups)
    if not plan.total:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    looked = stage(nodes.mapInPandas(_lookups(plan), LOOKUPS), "lookups")
    hot = stage(
        looked.groupBy("part", "value").count().where(F.col("count") > TILE), "long-keys"
    )
    tiles = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = looked.join(hot, ["part", "value"], "left").withColumn("tiles", tiles).withColumn("own", own)
    # A pair of tiles meets under one key, the lower tile first.
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    keyed = tiled.withColumn("other", F.explode(other)).select(
        "part", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        "fp", "kind",
    )
    dealt = keyed.repartition("part", "value", "a", "b").sortWithinPartitions("part", "value", "a", "b")
    return dealt.mapInArrow(_compare(distance), "u long, v long").distinct()


def make_plan(nodes: DataFrame, distance: int, groups: tuple[int, ...]) -> Plan:
    """Groups of correlated bits and their counts, over all fingerprints."""
    pairs = nodes.mapInArrow(_bit_pairs, "i int, n array<long>")
    sums = pairs.groupBy("i").agg(*[F.sum(F.col("n")[j]).alias(str(j)) for j in range(BITS)])
    table = np.zeros((BITS, BITS))
    for row in sums.collect():  # one row for each of the 64 bits
        table[row["i"]] = row[1:]
    total = nodes.count()
    size = min(groups, key=lambda m: _expected(total, m, distance))
    bits = correlated_groups(table, total, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros(1 << len(h), np.int64) for h in _halves(g)] for g in bits]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for group, own in zip(bits, sums, strict=True):
                for half, hist in zip(_halves(group), own, strict=True):
                    hist += np.bincount(pick(fps, half).astype(np.int64), minlength=len(hist))
        rows = [(g, h, np.flatnonzero(x), x) for g, own in enumerate(sums) for h, x in enumerate(own)]
        for g, h, at, x in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), g, np.int32)), pa.array(np.full(len(at), h, np.int32)),
                 pa.array(at), pa.array(x[at])],
                names=["part", "half", "value", "n"],
            )

    found = nodes.mapInArrow(count, "part int, half int, value long, n long")
    found = found.groupBy("part", "half", "value").agg(F.sum("n").alias("n"))
    counts = tuple(tuple(np.zeros(1 << len(h), np.int64) for h in _halves(g)) for g in bits)
    # At most 2^16 values for each half, whatever the size of the table: 6 MB at most, in one job.
    values = found.toArrow()
    part, half, value, n = (values[c].to_numpy() for c in ("part", "half", "value", "n"))
    for g, own in enumerate(counts):
        for h, hist in enumerate(own):
            mine = (part == g) & (half == h)
            hist[value[mine]] = n[mine]
    return Plan(bits, counts, total, distance)


def _expected(total: int, m: int, distance: int) -> float:
    """Lookups and weighted candidates of one fingerprint, were all bits random."""
    width = BITS // m
    least, extra = divmod(distance - m + 1, m)
    cost = 0.0
    for k in range(m):
        t = least + (k < extra)
        ball = sum(len(list(combinations(range(width), d))) for d in range(t + 1)) if t >= 0 else 0
        cost += 1 + ball + VERIFY * total * ball / 2.0**width
    return cost


def correlated_groups(table: np.ndarray, total: int, m: int) -> tuple[tuple[int, ...], ...]:
    """``m`` groups of nearly equal size; each takes the free bit that goes best with its bits."""
    share = table / max(total, 1)
    p = np.diag(share)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tie = np.abs((share - np.outer(p, p)) / scale)
    np.fill_diagonal(tie, 0)
    free = list(range(BITS))
    groups = []
    for k in range(m):
        size = len(free) // (m - k)
        start = free[int(np.argmax(tie[np.ix_(free, free)].sum(1)))]
        group = [start]
        free.remove(start)
        while len(group) < size:
            best = free[int(np.argmax(tie[np.ix_(free, group)].sum(1)))]
            group.append(best)
            free.remove(best)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def _halves(group: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return group[: len(group) // 2], group[len(group) // 2 :]


def pick(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 1 << 15):
            part = np.ascontiguousarray(fps[at : at + (1 << 15)])
            bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
            bits = bits.astype(np.float32)  # exact up to 2^24 rows
            table += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BITS, dtype=np.int32)), pa.array(table.tolist(), pa.list_(pa.int64()))],
        names=["i", "n"],
    )


def _near(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """For d = 0..most, how many fingerprints have a value in exactly d bits from each value."""
    width = len(counts).bit_length() - 1
    index, out = np.arange(len(counts)), []
    for d in range(most + 1):
        total = np.zeros(len(counts))
        for flips in combinations(range(width), d):
            total += counts[index ^ sum(1 << b for b in flips)]
        out.append(total)
    return out


def thresholds(fps: np.ndarray, plan: Plan, tables: list) -> np.ndarray:
    """The cheapest thresholds of each fingerprint, a column for each group.

    The sum is ``distance - m + 1``; -1 leaves a group out.
    """
    m = len(plan.groups)
    most = plan.distance  # no threshold can be above the distance
    budget = plan.distance + 1  # spent as threshold + 1
    best = np.full((budget + 1, len(fps)), np.inf)
    best[0] = 0
    choice = np.zeros((m, budget + 1, len(fps)), np.int8)
    for g, group in enumerate(plan.groups):
        lower, upper = (pick(fps, h).astype(np.int64) for h in _halves(group))
        near_lower, near_upper = tables[g]
        costs, seen = [np.zeros(len(fps))], np.zeros(len(fps))
        lookups = 0
        for t in range(most + 1):
            # Both halves taken as independent: expected rows in exactly t bits.
            seen = seen + sum(
                near_lower[d][lower] * near_upper[t - d][upper] for d in range(t + 1)
            ) / max(plan.total, 1)
            lookups += len(list(combinations(range(len(group)), t)))
            costs.append(lookups + VERIFY * seen)
        after = np.full_like(best, np.inf)
        for spent in range(budget + 1):
            for share in range(spent + 1):
                cost = best[spent - share] + costs[share]
                better = cost < after[spent]
                after[spent] = np.where(better, cost, after[spent])
                choice[g, spent] = np.where(better, share, choice[g, spent])
        best = after
    out = np.zeros((len(fps), m), np.int64)
    spent, rows = np.full(len(fps), budget), np.arange(len(fps))
    for g in reversed(range(m)):
        share = choice[g, spent, rows].astype(np.int64)
        out[:, g] = share - 1
        spent = spent - share
    return out


def _lookups(plan: Plan):
    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [tuple(_near(c, plan.distance) for c in pair) for pair in plan.counts]
        for frame in frames:
            for at in range(0, len(frame), 1 << 14):
                fps = frame["fp"].to_numpy()[at : at + (1 << 14)].view(np.uint64)
                chosen = thresholds(fps, plan, tables)
                for g, group in enumerate(plan.groups):
                    value = pick(fps, group).astype(np.int64)
                    kind = np.where(chosen[:, g] >= 0, BOTH, DATA)
                    yield _rows(g, value, fps, kind)
                    for t in range(1, int(chosen[:, g].max(initial=-1)) + 1):
                        far = chosen[:, g] >= t
                        for flips in combinations(range(len(group)), t):
                            mask = sum(1 << b for b in flips)
                            yield _rows(g, value[far] ^ mask, fps[far], PROBE)

    return look


def _rows(part: int, value: np.ndarray, fps: np.ndarray, kind: np.ndarray | int) -> pd.DataFrame:
    return pd.DataFrame(
        {"part": np.int32(part), "value": value, "fp": fps.view(np.int64), "kind": np.asarray(kind, np.int32)}
    )


def _compare(distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0
        for batch in batches:
            kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)]))
            held += batch.num_rows
            if held >= CHUNK:
                rows = np.concatenate(kept, 1)
                # The last key may go on in the next batch.
                last = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0))
                cut = last[-1] + 1 if len(last) else 0
                yield _stars(rows[:, :cut], distance)
                kept, held = [rows[:, cut:]], rows.shape[1] - cut
        if held:
            yield _stars(np.concatenate(kept, 1), distance)

    return compare


def _stars(rows: np.ndarray, distance: int) -> pa.RecordBatch:
    """Verified links within the runs of equal keys, as stars."""
    n = rows.shape[1]
    u = v = np.zeros(0, np.int64)
    if n:
        new = np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(0)])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)[np.cumsum(new) - 1]
        fps, kind = rows[4], rows[5]
        bits = fps.view(np.uint64)
        at, gap, found, many = np.arange(n), 1, [], 0
        while True:
            at = at[at + gap < ends[at]]
            if not len(at):
                break
            to = at + gap
            # One side must be stored here, the other look it up.
            fits = ((kind[at] & DATA) & (kind[to] >> 1)) | ((kind[to] & DATA) & (kind[at] >> 1))
            near = (np.bitwise_count(bits[at] ^ bits[to]) <= distance) & (fits > 0) & (fps[at] != fps[to])
            if near.any():
                found.append((fps[at[near]], fps[to[near]]))
                many += int(near.sum())
            if many > HELD:
                u, v = local_stars(*(np.concatenate([x[i] for x in [(u, v), *found]]) for i in (0, 1)))
                found, many = [], 0
            gap += 1
        u, v = local_stars(*(np.concatenate([x[i] for x in [(u, v), *found]]) for i in (0, 1)))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
