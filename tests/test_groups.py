import numpy as np
import pytest
from helpers import brute, frame, hits, same_hits, vectors

from skewprobe.operators import groups as g
from skewprobe.operators.scan import query_blocks
from skewprobe.plans import pruned, search
from skewprobe.session import stage
from skewprobe.sources import load_groups, load_index, write_index

GROUPS = 5


def clustered(n, dim, centres, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def data():
    b = clustered(900, 13, 30, 1)
    b[300:600] = b[7]  # a third are copies
    q = np.concatenate([b[:12], clustered(12, 13, 30, 2), np.zeros((1, 13), np.float32)])
    c = vectors(4, dim=13, seed=3)
    parts = np.argmin(((b[:, None] - c[None]) ** 2).sum(2), axis=1)
    parts[parts == 2] = 0  # 2 stays empty
    return b, q, parts, c


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    b, _, parts, c = data
    path = str(tmp_path_factory.mktemp("index"))
    write_index(path, frame(spark, b, parts), frame(spark, c, id="part", vec="c"), groups=GROUPS)
    return path


def queries(spark, q):
    return frame(spark, q, id="q_id", vec="qv")


def routes(q, c, nprobe):
    cs = np.round(q.astype(float) @ c.astype(float).T, 9)
    return [np.lexsort((np.arange(len(c)), -row))[:nprobe] for row in cs]


def test_summaries_bound_every_row(spark, data, index):
    b, q, parts, _ = data
    rows, _ = load_index(spark, index)
    cell = {r.vec_id: (r.part, r.cell) for r in rows.select("vec_id", "part", "cell").collect()}
    assert {i: p for i, (p, _) in cell.items()} == dict(enumerate(parts.tolist()))
    assert all(c // GROUPS == p for p, c in cell.values())
    table = load_groups(spark, index)
    sizes = {r.cell: r.n for r in table.collect()}
    assert sum(sizes.values()) == len(b) and max(sizes.values()) >= 300
    (block,) = query_blocks(queries(spark, q))
    at = {int(i): n for n, i in enumerate(block.ids)}
    bound = {(r.q, r.cell): (r.bound, r.n) for r in g.group_bounds(block, table).collect()}
    assert len(bound) == len(q) * len(sizes)
    scores = np.round(q.astype(float) @ b.astype(float).T, 9)
    for i in range(len(b)):
        for j in range(len(q)):
            assert bound[at[j], cell[i][1]][0] >= scores[j, i]
    # On clustered rows they rule out most groups.
    best = np.sort(scores, axis=1)[:, -5]
    tight = [bound[at[j], c][0] < best[j] for j in range(24) for c in sizes]
    assert np.mean(tight) > 0.4


@pytest.mark.parametrize("nprobe", [1, 2, 9])
def test_pipeline_by_groups_equals_routed_search(spark, data, index, nprobe):
    b, q, parts, c = data
    rows, centroids = load_index(spark, index)
    found = pruned.full_pipeline(
        queries(spark, q), rows, centroids, 5, nprobe, 3, groups=load_groups(spark, index)
    )
    same_hits(hits(found.hits), brute(q, b, 5, parts, routes(q, c, nprobe)))
    sizes = np.bincount(parts, minlength=4)
    visits = np.bincount(np.concatenate(routes(q, c, nprobe)), minlength=4)
    counts = {(r.part, r.block): (r.load, r.pruned) for r in found.counts.collect()}
    for p in range(4):
        if visits[p] and sizes[p]:
            assert sum(counts[p, 0]) == visits[p] * sizes[p]
            assert counts[p, 1] == counts[p, 2] == (counts[p, 0][0], 0)
    seen = found.groups.groupBy().sum("seen", "skipped").first()
    assert 0 < seen[1] < seen[0]


def test_dimension_search_by_groups_loses_nothing(spark, data, index):
    b, q, _, _ = data
    rows, _ = load_index(spark, index)
    found = pruned.dimension_search(queries(spark, q), rows, 5, 3, n_v=60, groups=load_groups(spark, index))
    same_hits(hits(found.hits), brute(q, b, 5))
    load, dropped = found.counts.where("block = 0").groupBy().sum("load", "pruned").first()
    assert load + dropped == len(q) * len(b) and dropped > 0


def test_small_blocks_change_nothing(spark, data, index):
    """Query blocks, pivots and pairs in pieces within a bound of a few rows."""
    b, q, parts, c = data
    rows, centroids = load_index(spark, index)
    expected = brute(q, b, 5, parts, routes(q, c, 2))
    spark.conf.set("skewprobe.broadcast.bytes", "1500")
    try:
        found = pruned.full_pipeline(
            queries(spark, q), rows, centroids, 5, 2, 3, groups=load_groups(spark, index)
        )
        same_hits(hits(found.hits), expected)
        whole = pruned.dimension_search(queries(spark, q), rows, 5, 3, n_v=60, groups=load_groups(spark, index))
        same_hits(hits(whole.hits), brute(q, b, 5))
        pivots = stage(g.fit_groups(frame(spark, b, parts), GROUPS), "pivots")
        again = g.assign_groups(frame(spark, b, parts), pivots, GROUPS)
        sizes = {r.cell: r["count"] for r in again.groupBy("cell").count().collect()}
        summed = {r.cell: r.n for r in g.summarise(again, pivots).collect()}
    finally:
        spark.conf.unset("skewprobe.broadcast.bytes")
    assert sizes == summed == {r.cell: r.n for r in load_groups(spark, index).collect()}


def test_only_the_folders_of_needed_groups_are_read(spark, data, index):
    rows, _ = load_index(spark, index)
    some = rows.where("cell in (1, 2)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert 0 < len(some.inputFiles()) or some.count() < rows.count()


def test_bad_rows_and_no_rows(spark, tmp_path):
    b = clustered(60, 6, 4, 5)
    b[::7, 2] = np.nan
    parts = np.arange(60) % 2
    b[parts == 1] = np.nan  # no usable row
    path = str(tmp_path)
    c = frame(spark, vectors(2, dim=6, seed=6), id="part", vec="c")
    write_index(path, frame(spark, b, parts), c, groups=3)
    rows, centroids = load_index(spark, path)
    q = clustered(3, 6, 4, 7)
    found = pruned.full_pipeline(queries(spark, q), rows, centroids, 4, 2, groups=load_groups(spark, path))
    good = np.flatnonzero(np.isfinite(b).all(axis=1))
    expected = {i: [(int(good[j]), s) for j, s in h] for i, h in brute(q, b[good], 4).items()}
    same_hits(hits(found.hits), expected)
    none = pruned.full_pipeline(queries(spark, q).limit(0), rows, centroids, 4, groups=load_groups(spark, path))
    assert none.hits.count() == none.counts.count() == 0


def test_groups_need_the_exact_mode(spark, data, index):
    rows, centroids = load_index(spark, index)
    with pytest.raises(ValueError):
        pruned.full_pipeline(
            queries(spark, data[1]), rows, centroids, mode="compat", groups=load_groups(spark, index)
        )


@pytest.mark.parametrize("limit", ["1", "3000", "100000000"])
def test_task_state_is_handed_on(spark, limit):
    """Many shards against many queries: the best rows of a task stay within the bound."""
    b, q = vectors(600, dim=6, seed=31), vectors(40, dim=6, seed=32)
    parts = np.arange(600) % 50
    spark.conf.set("skewprobe.state.bytes", limit)
    try:
        found = search.local_topk(queries(spark, q), frame(spark, b, parts), 3).collect()
    finally:
        spark.conf.unset("skewprobe.state.bytes")
    mine = {}
    for r in found:
        mine.setdefault((r.q_id, r.part), []).append((r.rk, r.vec_id))
    s = np.round(q.astype(float) @ b.astype(float).T, 9)
    for i in range(40):
        for p in range(50):
            ids = np.flatnonzero(parts == p)
            want = ids[np.lexsort((ids, -s[i][ids]))[:3]].tolist()
            assert [v for _, v in sorted(mine[i, p])] == want
