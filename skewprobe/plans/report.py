"""Metrics of several systems and workloads in one small table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skewprobe.operators.metrics import imbalance, latency_summary, report, throughput
from skewprobe.session import stage

# Batches in which a measured search runs.
BATCHES = 8


@dataclass(frozen=True)
class Measured:
    """Hits of a search, written, and ``batch, q_id, elapsed_s`` for each of its queries."""

    hits: DataFrame
    durations: DataFrame


def measure(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], batches: int = BATCHES
) -> Measured:
    """Run ``search`` on the queries, a batch at a time, and time each batch to its last hit.

    Queries run as a set, so a query's time is that of its batch, shared by the batch's queries: the times
    add up to the time spent, and differ between batches. Batches are dealt by a hash of the id; the hits
    are those of one run over all queries. The number of queries is observed while the batch is written.
    """
    slot = F.pmod(F.xxhash64(F.col("q_id").cast("long")), F.lit(batches))
    hits, times = [], []
    for i in range(batches):
        seen = Observation()
        batch = stage(queries.where(slot == i).observe(seen, F.count("*").alias("n")), "batch")
        if not seen.get["n"]:
            continue
        start = time.perf_counter()
        hits.append(stage(search(batch), "measured"))
        took = time.perf_counter() - start
        share = F.lit(took / seen.get["n"])
        times.append(batch.select(F.lit(i).alias("batch"), "q_id", share.alias("elapsed_s")))
    if not hits:
        empty = queries.select(F.lit(0).alias("batch"), "q_id", F.lit(0.0).alias("elapsed_s"))
        return Measured(search(queries), empty)
    return Measured(reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, times))


@dataclass(frozen=True)
class Run:
    """What one system did on one workload.

    ``loads`` maps a name to a table of bucket and load and gets an imbalance
    ratio; ``counts`` likewise but without one; both name the bucket column
    first. ``durations`` has ``elapsed_s``, one row per query.
    """

    system: str
    workload: str
    queries: DataFrame
    loads: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, DataFrame] = field(default_factory=dict)
    durations: DataFrame | None = None


def run_report(runs: Iterable[Run]) -> DataFrame:
    """``system, workload, metric, bucket, value``; bucket -1 marks single figures."""
    tables = []
    for run in runs:
        facts = {"queries": (run.queries.agg(F.count("*").alias("n")), None)}
        for name, loads in run.loads.items():
            bucket, value = loads.columns
            facts[f"{name}_load"] = (loads, bucket)
            facts[f"{name}_imbalance"] = (imbalance(loads, value), None)
        for name, counts in run.counts.items():
            facts[name] = (counts, counts.columns[0])
        if run.durations is not None:
            times = latency_summary(run.durations, "elapsed_s")
            for metric in ("mean", "p95", "p99"):
                facts[f"{metric}_latency"] = (times.select(metric), None)
            facts["qps"] = (throughput(run.durations, "elapsed_s"), None)
        tables.append(report(facts, system=run.system, workload=run.workload))
    return reduce(DataFrame.unionByName, tables)
