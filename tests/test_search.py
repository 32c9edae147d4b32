import re

import numpy as np
import pytest
from helpers import brute, frame, hits, same_hits, vectors
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skewprobe.functions import scores_of
from skewprobe.operators import partition
from skewprobe.operators.partition import (
    assign_nearest,
    fit_centroids,
    mean_centroids,
    random_shards,
)
from skewprobe.operators.topk import kth_threshold, topk
from skewprobe.plans import pruned, search
from skewprobe.plans.pruned import routing_load


@pytest.fixture(scope="module")
def data(spark):
    b, q = vectors(600, seed=1, copies=200), vectors(40, seed=2)
    q[:15] = b[0]  # a third of the queries sit on the group of copies
    q[20] = 0.0
    return b, q


def queries(spark, q, **kw):
    return frame(spark, q, id="q_id", vec="qv", **kw)


@pytest.mark.parametrize("slices", [1, 7])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_full_search_equals_brute_force(spark, data, slices, kind):
    b, q = data
    found = search.full_search(queries(spark, q), frame(spark, b, slices=slices, kind=kind), 10)
    same_hits(hits(found), brute(q, b, 10))


def test_more_hits_wanted_than_rows(spark):
    b, q = vectors(4, seed=3), vectors(3, seed=4)
    same_hits(hits(search.full_search(queries(spark, q), frame(spark, b), 9)), brute(q, b, 9))


def test_copies_rank_by_id_whatever_the_row_order(spark):
    b = np.repeat(vectors(1, seed=5), 500, axis=0)
    shuffled = np.random.default_rng(0).permutation(500)
    table = frame(spark, b, ids=shuffled, slices=6)
    found = hits(search.full_search(queries(spark, b[:2]), table, 10))
    assert [i for i, _ in found[0]] == list(range(10)) == [i for i, _ in found[1]]


def test_small_batches_and_large_numbers(spark, data):
    b, q = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        found = search.full_search(queries(spark, q), frame(spark, b), 5)
        same_hits(hits(found), brute(q, b, 5))
        big = (b * 1e4).astype(np.float32)
        found = hits(search.full_search(queries(spark, q), frame(spark, big), 5))
        expected = brute(q, big, 5)
        assert {k: [i for i, _ in v] for k, v in found.items() if k != 20} == {
            k: [i for i, _ in v] for k, v in expected.items() if k != 20
        }
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_set_beyond_the_broadcast_bound(spark, data):
    b, q = data
    spark.conf.set("skewprobe.broadcast.bytes", str(17 * 8 * 12))
    try:
        blocks = list(search.query_blocks(queries(spark, q)))
        assert len(blocks) >= 4 and max(len(x.ids) for x in blocks) <= 12
        assert sorted(np.concatenate([x.ids for x in blocks])) == list(range(40))
        found = search.full_search(queries(spark, q), frame(spark, b), 10)
        same_hits(hits(found), brute(q, b, 10))
    finally:
        spark.conf.unset("skewprobe.broadcast.bytes")


def test_no_queries_and_no_rows(spark, data):
    b, q = data
    none = queries(spark, q).where("q_id < 0")
    assert search.full_search(none, frame(spark, b)).count() == 0
    empty = frame(spark, b).where("vec_id < 0")
    assert search.full_search(queries(spark, q), empty).count() == 0


def test_vectors_of_different_length_are_refused(spark, data):
    _, q = data
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="one length"):
        search.full_search(queries(spark, q), bad.coalesce(1)).collect()


def test_random_shards_are_even_and_change_nothing(spark, data):
    b, q = data
    sharded = random_shards(frame(spark, b), 7)
    sizes = {r.part: r["count"] for r in sharded.groupBy("part").count().collect()}
    assert [sizes[i] for i in range(7)] == [86] * 5 + [85] * 2
    again = {r.vec_id: r.part for r in random_shards(frame(spark, b, slices=9), 7).collect()}
    assert again == {r.vec_id: r.part for r in sharded.collect()}
    result = search.sharded_search(queries(spark, q), sharded, 10)
    same_hits(hits(result.hits), brute(q, b, 10))
    assert {r.part: r.load for r in result.loads.collect()} == {p: n * 40 for p, n in sizes.items()}


def test_more_shards_than_rows(spark):
    sharded = random_shards(frame(spark, vectors(3)), 5)
    assert sorted(r.part for r in sharded.collect()) == [0, 1, 2]


def test_nearest_centroid_and_its_blocks(spark, data):
    b, _ = data
    c = vectors(30, seed=8)
    c[7] = c[3]
    centroids = frame(spark, c, id="part", vec="c")
    dist = np.round(((b.astype(float)[:, None] - c.astype(float)) ** 2).sum(axis=2), 9)
    expected = dict(enumerate(dist.argmin(axis=1).tolist()))
    table = frame(spark, b)
    assert {r.vec_id: r.part for r in assign_nearest(table, centroids).collect()} == expected
    spark.conf.set("skewprobe.broadcast.bytes", str(17 * 8 * 6))
    try:
        in_blocks = assign_nearest(table, centroids)
        assert {r.vec_id: r.part for r in in_blocks.collect()} == expected
    finally:
        spark.conf.unset("skewprobe.broadcast.bytes")


def test_routing_and_routed_search(spark, data):
    b, q = data
    c = vectors(6, seed=9)
    parts = np.random.default_rng(3).integers(0, 5, len(b))  # partition 5 stays empty
    table, centroids = frame(spark, b, parts), frame(spark, c, id="part", vec="c")
    cs = np.round(q.astype(float) @ c.astype(float).T, 9)
    visits = [np.lexsort((np.arange(6), -row))[:2] for row in cs]
    routes = search.route(queries(spark, q), centroids, 2)
    found = {(r.q_id, r.probe): r.part for r in routes.collect()}
    assert found == {(i, j + 1): int(p) for i, v in enumerate(visits) for j, p in enumerate(v)}
    assert search.route(queries(spark, q), centroids, 99).count() == 40 * 6

    result = search.ivf_search(queries(spark, q), table, centroids, 10, 2)
    same_hits(hits(result.hits), brute(q, b, 10, parts, visits))
    sizes = np.bincount(parts, minlength=6)
    loads = np.zeros(6, dtype=int)
    visited = np.zeros(6, dtype=int)
    for v in visits:
        loads[v] += sizes[v]
        visited[v] += 1
    assert {r.part: r.load for r in result.loads.collect()} == dict(enumerate(loads.tolist()))
    routed = routing_load(routes, centroids)
    assert {r.part: r.load for r in routed.collect()} == dict(enumerate(visited.tolist()))
    everywhere = search.ivf_search(queries(spark, q), table, centroids, 10, 6)
    same_hits(hits(everywhere.hits), brute(q, b, 10))


def test_kmeans_beats_a_random_assignment(spark):
    b = vectors(300, dim=4, seed=11)
    centroids = fit_centroids(frame(spark, b), 5, restarts=2)
    table = assign_nearest(frame(spark, b), centroids)
    c = np.array([r.c for r in centroids.orderBy("part").collect()])
    part = np.array([r.part for r in table.orderBy("vec_id").collect()])
    dist = ((b.astype(float)[:, None] - c) ** 2).sum(axis=2)
    assert (dist[np.arange(300), part] <= dist.min(axis=1) + 1e-9).all()
    shuffled = np.random.default_rng(0).permutation(part)
    assert dist[np.arange(300), part].sum() < dist[np.arange(300), shuffled].sum()


def test_registered_kmeans_does_all_restarts(spark, monkeypatch):
    from types import SimpleNamespace

    import __spark_entry__ as entry
    from skewprobe.operators import partition

    seeds = []

    class Counted(partition.KMeans):
        def __init__(self, **settings):
            seeds.append((settings["seed"], settings["maxIter"]))
            super().__init__(**settings)

    monkeypatch.setattr(partition, "KMeans", Counted)
    entry._kmeans(SimpleNamespace(base=frame(spark, vectors(100, dim=4, seed=13))))
    assert len(set(seeds)) == partition.RESTARTS == 10 and {n for _, n in seeds} == {300}


def test_mean_centroids(spark):
    b = vectors(50, dim=3, seed=12)
    group = np.arange(50) % 4
    found = mean_centroids(frame(spark, b, group), "part").collect()
    for r in found:
        assert np.allclose(r.c, b[group == r.part].astype(float).mean(axis=0), atol=1e-9)


def test_thresholds_and_ranks(spark):
    rows = [(1, 5, 0.5), (1, 4, 0.5), (1, 3, 0.9), (2, 1, 0.1)]
    table = spark.createDataFrame(rows, "q_id long, vec_id long, score double")
    ranked = {(r.q_id, r.rk): r.vec_id for r in topk(table, k=2).collect()}
    assert ranked == {(1, 1): 3, (1, 2): 4, (2, 1): 1}
    loose = {r.q_id: r.thr for r in kth_threshold(table, k=2).collect()}
    strict = {r.q_id: r.thr for r in kth_threshold(table, k=2, strict=True).collect()}
    assert loose == {1: 0.5, 2: 0.1}
    assert strict == {1: 0.5, 2: float("-inf")}


def test_scores_of_one_query(spark, data):
    b, q = data
    found = {r.vec_id: r.score for r in scores_of(frame(spark, b), q[1]).collect()}
    want = dict(enumerate(b.astype(float) @ q[1].astype(float)))
    assert found == pytest.approx(want, abs=1e-12)


def test_scan_reads_two_columns_and_visited_partitions(spark, data, tmp_path):
    b, q = data
    table = frame(spark, b, np.arange(len(b)) % 4).withColumn("label", F.lit("x"))
    table.write.partitionBy("part").parquet(str(tmp_path / "parts"))
    stored = spark.read.parquet(str(tmp_path / "parts"))
    routes = spark.createDataFrame([(1, 2)], "q_id long, part int")
    found = search.routed_topk(queries(spark, q[:2]), stored, routes, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" in plan and "label" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = 2", plan)
    assert "Join" not in plan and "Cartesian" not in plan
    assert {r.vec_id % 4 for r in found.collect()} == {2}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_a_row_with_a_bad_component_is_left_out_alone(spark, bad):
    v, q = vectors(60, seed=3), vectors(5, seed=4)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    for i in (7, 30):
        rows[i][1][2] = bad
    asked = [(i, [float(x) for x in row]) for i, row in enumerate(q)] + [(5, [bad] * v.shape[1])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    asked = spark.createDataFrame(asked, "q_id long, qv array<double>")
    kept = [i for i in range(len(v)) if i not in (7, 30)]
    expected = {i: [(kept[j], s) for j, s in h] for i, h in brute(q, v[kept], 10).items()}
    same_hits(hits(search.full_search(asked, base, 10)), expected)
    found = pruned.dimension_search(asked, base, k=10, n_v=20).hits
    same_hits(hits(found), expected)


def test_rows_that_are_no_hits_stay_out_of_the_exchange(spark, tmp_path):
    """With many hits both sides are shuffled, the stored one behind a Bloom filter of the hits' ids."""
    b, q = vectors(3000, dim=4, seed=51), vectors(20, dim=4, seed=52)
    frame(spark, b).write.parquet(str(tmp_path / "base"))
    base, qs = spark.read.parquet(str(tmp_path / "base")), frame(spark, q, id="q_id", vec="qv")
    hits_ = search.full_search(qs, base, 5)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = search.attach_vectors(hits_, qs, base)
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        rows = joined.collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "might_contain" in plan
    assert len(rows) == 100 and all(np.allclose(r.bv, b[r.vec_id]) for r in rows)


def test_shards_without_rows_have_a_load(spark):
    q, sharded = frame(spark, vectors(4), id="q_id", vec="qv"), random_shards(frame(spark, vectors(3)), 5)
    loads = search.sharded_search(q, sharded, shards=5).loads
    assert {r.part: r.load for r in loads.collect()} == {0: 4, 1: 4, 2: 4, 3: 0, 4: 0}


def test_kmeans_runs_share_their_passes(spark, monkeypatch):
    """The best of MLlib's own runs, with no pass over the rows for a single run but for its start."""
    rng = np.random.default_rng(5)
    b = rng.normal(size=(400, 6)) + rng.integers(0, 4, (400, 1))
    base = frame(spark, b).repartition(3, "vec_id").cache()
    features = base.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    # Equal partitions, so that the starts are equal.
    models = [KMeans(k=4, seed=partition.SEED + i, maxIter=300, tol=1e-4).fit(features) for i in range(3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    alone = []

    class Noted(KMeans):
        def _fit(self, dataset):
            model = super()._fit(dataset)
            alone.append(model.summary.numIter)
            return model

    monkeypatch.setattr(partition, "KMeans", Noted)
    centroids = fit_centroids(base, 4, restarts=3)
    assert alone == [0, 0, 0]
    found = np.array([r["c"] for r in centroids.orderBy("part").collect()])
    assert np.allclose(found, np.array(best.clusterCenters()), atol=1e-9)
