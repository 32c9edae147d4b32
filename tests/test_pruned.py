import numpy as np
import pytest
from helpers import brute, compat_stage, frame, hits, same_hits, scores, top, vectors

from skewprobe.functions.vectors import (
    block_bounds,
    block_scores,
    dim_blocks,
    dot,
    suffix_bounds,
)
from skewprobe.plans import pruned, search


def queries(spark, q):
    return frame(spark, q, id="q_id", vec="qv")


def by_block(result):
    return [(r.load, r.pruned) for r in result.blocks().orderBy("block").collect()]


@pytest.fixture(scope="module")
def data():
    b, q = vectors(400, dim=13, seed=21, copies=130), vectors(20, dim=13, seed=22)
    q[:6] = b[0]
    parts = np.random.default_rng(1).integers(0, 4, 400)
    parts[parts == 3] = 0  # 3 stays empty, 0 is hot
    c = vectors(4, dim=13, seed=23)
    return b, q, parts, c


def test_block_edges():
    assert dim_blocks(7, 3) == [(0, 2), (2, 4), (4, 7)]
    assert dim_blocks(2, 4) == [(0, 0), (0, 1), (1, 1), (1, 2)]
    for dim in range(1, 129):
        for n in range(1, 33):
            edges = np.linspace(0, dim, n + 1, dtype=int).tolist()
            assert dim_blocks(dim, n) == list(zip(edges[:-1], edges[1:]))


def test_blocks_add_up_and_bound_the_rest(spark, data):
    b, q, _, _ = data
    rows = [(i, [float(x) for x in q[i]], [float(x) for x in b[i]]) for i in range(20)]
    pairs = spark.createDataFrame(rows, "q_id long, qv array<double>, bv array<double>")
    blocks = dim_blocks(13, 3)
    for bound in ("abs", "norm"):
        table = suffix_bounds(block_bounds(block_scores(pairs, blocks), blocks, bound=bound), 3)
        for r in table.withColumn("s", dot("qv", "bv")).collect():
            s = [r.score_0, r.score_1, r.score_2]
            assert abs(sum(s) - r.s) < 1e-12
            assert r.suffix_0 >= r.s - 1e-12 and r.suffix_1 >= s[1] + s[2] - 1e-12
            assert abs(r.suffix_2 - r.bound_2) < 1e-12


@pytest.mark.parametrize("bound", ["abs", "norm"])
@pytest.mark.parametrize("n_v", [3, 60, 5000])
def test_exact_dimension_search_loses_nothing(spark, data, bound, n_v):
    b, q, _, _ = data
    found = pruned.dimension_search(queries(spark, q), frame(spark, b), 5, 3, "exact", bound, n_v)
    same_hits(hits(found.hits), brute(q, b, 5))
    counts = by_block(found)
    assert counts[0] == (20 * 400, 0)
    for (before, _), (load, dropped) in zip(counts, counts[1:]):
        assert load + dropped == before


def test_counters_do_not_depend_on_the_layout(spark, data):
    b, q, parts, c = data
    centroids = frame(spark, c, id="part", vec="c")
    seen = set()
    for slices in (1, 5):
        table = frame(spark, b, parts, slices=slices)
        one = pruned.dimension_search(queries(spark, q), table, 5, 3, n_v=50)
        two = pruned.full_pipeline(queries(spark, q), table, centroids, 5, 2, 3, n_v=20)
        seen.add((tuple(by_block(one)), tuple(by_block(two))))
    assert len(seen) == 1


def test_partial_thresholds_can_drop_the_answer(spark):
    b = np.array([[0.9, 0.9], [0.0, 0.5]], dtype=np.float32)
    q = np.array([[1.0, -1.0]], dtype=np.float32)
    b[1, 1] = -0.5
    base, qs = frame(spark, b), queries(spark, q)
    exact = pruned.dimension_search(qs, base, 1, 2, "exact", n_v=1)
    compat = pruned.dimension_search(qs, base, 1, 2, "compat")
    assert [i for i, _ in hits(exact.hits)[0]] == [1]
    assert [i for i, _ in hits(compat.hits)[0]] == [0]
    assert by_block(compat) == [(2, 0), (1, 1)]


def test_compat_dimension_search_equals_a_row_loop(spark, data):
    b, q, _, _ = data
    blocks = dim_blocks(13, 4)
    found = pruned.dimension_search(queries(spark, q), frame(spark, b), 5, 4, "compat")
    expected, loads, drops = {}, np.zeros(4, int), np.zeros(4, int)
    for i in range(len(q)):
        h, ld, dr, _ = compat_stage(
            q[i], b, np.arange(400), blocks, 5, -np.inf, rising=False, first=False
        )
        expected[i], loads, drops = h, loads + ld, drops + dr
    same_hits(hits(found.hits), expected)
    assert by_block(found) == list(zip(loads.tolist(), drops.tolist()))


def _routes(q, c, nprobe):
    cs = np.round(q.astype(float) @ c.astype(float).T, 9)
    return [np.lexsort((np.arange(len(c)), -row))[:nprobe] for row in cs]


@pytest.mark.parametrize("bound", ["abs", "norm"])
@pytest.mark.parametrize("nprobe", [1, 2, 9])
def test_exact_pipeline_equals_routed_search(spark, data, bound, nprobe):
    b, q, parts, c = data
    table, centroids = frame(spark, b, parts), frame(spark, c, id="part", vec="c")
    found = pruned.full_pipeline(
        queries(spark, q), table, centroids, 5, nprobe, 3, "exact", bound, n_v=10
    )
    same_hits(hits(found.hits), brute(q, b, 5, parts, _routes(q, c, nprobe)))


@pytest.mark.parametrize("n_v", [20, 5000])
def test_compat_pipeline_equals_a_row_loop(spark, data, n_v):
    b, q, parts, c = data
    table, centroids = frame(spark, b, parts), frame(spark, c, id="part", vec="c")
    qs = queries(spark, q)
    blocks, k = dim_blocks(13, 3), 5
    pooled = pruned.prewarm_pooled(qs, table, k, 8, n_v)
    expected, loads, drops = {}, np.zeros(3, int), np.zeros(3, int)
    by_part = np.zeros(4, int)
    for i, visits in enumerate(_routes(q, c, 2)):
        thr, got = pooled, []
        for p in visits:
            ids = np.flatnonzero(parts == p)
            h, ld, dr, after = compat_stage(q[i], b[ids], ids, blocks, k, thr)
            got += h
            loads, drops = loads + ld, drops + dr
            by_part[p] += sum(ld)
            merged = sorted((s for _, s in got), reverse=True)[:k]
            thr = max(thr, after, merged[-1] if len(merged) == k else -np.inf)
        expected[i] = sorted(got, key=lambda h: (-h[1], h[0]))[:k]
    found = pruned.full_pipeline(qs, table, centroids, k, 2, 3, "compat", n_q=8, n_v=n_v)
    same_hits(hits(found.hits), expected)
    assert by_block(found) == list(zip(loads.tolist(), drops.tolist()))
    loads_of = {r.part: r.load for r in found.partitions(centroids).collect()}
    assert loads_of == dict(enumerate(by_part.tolist()))


def test_prewarm(spark, data):
    b, q, parts, c = data
    qs, table = queries(spark, q), frame(spark, b, parts)
    pooled = pruned.prewarm_pooled(qs, table, 5, 100, 5000)
    assert pooled == pytest.approx(np.sort(scores(q, b).ravel())[-5])
    assert pruned.prewarm_pooled(qs, table, 50, 1, 10) == float("-inf")
    per_query = {r.q_id: r.thr for r in pruned.prewarm_per_query(qs, table, 5, 5000).collect()}
    assert per_query == pytest.approx({i: top(s, np.arange(400), 5)[-1][1] for i, s in enumerate(scores(q, b))})
    routes = search.route(qs, frame(spark, c, id="part", vec="c"), 2)
    routed = pruned.prewarm_per_query(qs, table, 5, 30, routes)
    final = {i: h[-1][1] for i, h in brute(q, b, 5, parts, _routes(q, c, 2)).items() if len(h) == 5}
    for r in routed.collect():
        assert r.thr <= final[r.q_id] + 1e-9
    too_few = pruned.prewarm_per_query(qs, table, 5, 2)
    assert {r.thr for r in too_few.collect()} == {float("-inf")}


@pytest.mark.parametrize("mode", ["exact", "compat"])
def test_dimension_pipeline_on_given_pairs(spark, data, mode):
    b, q, parts, _ = data
    rows = [(i, p, -1.0 if i % 2 else 2.0) for i in range(20) for p in range(4)]
    probes = spark.createDataFrame(rows, "q_id long, part int, thr double")
    out = pruned.dimension_pipeline(
        queries(spark, q), frame(spark, b, parts), probes, 5, 3, mode
    )
    found = {(r.q_id, r.part) for r in out.hits.collect()}
    assert found == {(i, p) for i in range(1, 20, 2) for p in range(3)}
    after = {(r.q_id, r.part): r.thr for r in out.thresholds.collect()}
    assert len(after) == 80
    assert all(after[i, p] == 2.0 for i in range(0, 20, 2) for p in range(4))
    assert all(after[i, 3] == -1.0 for i in range(1, 20, 2))
    if mode == "exact":
        for i in range(1, 20, 2):
            ids = np.flatnonzero(parts == 1)
            assert after[i, 1] == pytest.approx(top(scores(q, b)[i][ids], ids, 5)[-1][1])


def test_modes_and_bounds_are_checked(spark, data):
    b, q, _, _ = data
    with pytest.raises(ValueError):
        pruned.dimension_search(queries(spark, q), frame(spark, b), mode="fast")
    with pytest.raises(ValueError):
        pruned.dimension_search(queries(spark, q), frame(spark, b), bound="max")


def test_query_blocks_do_not_change_the_pipeline(spark, data):
    b, q, parts, c = data
    table, centroids = frame(spark, b, parts), frame(spark, c, id="part", vec="c")
    qs = queries(spark, q)
    whole = pruned.full_pipeline(qs, table, centroids, 5, 2, 3, n_v=10)
    expected, counts = hits(whole.hits), by_block(whole)
    spark.conf.set("skewprobe.broadcast.bytes", str(14 * 8 * 9))
    try:
        assert len(list(search.query_blocks(qs))) > 1
        in_blocks = pruned.full_pipeline(qs, table, centroids, 5, 2, 3, n_v=10)
        same_hits(hits(in_blocks.hits), expected)
        assert by_block(in_blocks) == counts
    finally:
        spark.conf.unset("skewprobe.broadcast.bytes")
