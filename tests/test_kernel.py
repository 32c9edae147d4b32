"""The work of one scan task, without Spark, at sizes that span several tiles and batches."""

import numpy as np
import pyarrow as pa
import pytest

from skewprobe.functions.vectors import dim_blocks
from skewprobe.operators import scan


def batches(ids, v, parts, size):
    for lo in range(0, len(ids), size):
        rows = slice(lo, lo + size)
        d = v.shape[1]
        n = len(ids[rows])
        offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[rows]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[rows].ravel())),
                pa.array(parts[rows].astype(np.int32)),
            ],
            names=["vec_id", "embedding", "part"],
        )


def run(ids, v, parts, probes, k, prune=None, size=1700):
    out = pa.Table.from_batches(
        list(scan._scan_task(batches(ids, v, parts, size), probes, k, prune, True))
    ).to_pandas()
    rows = out[out.block.isna()].sort_values(
        ["q_id", "part", "score", "vec_id"], ascending=[True, True, False, True]
    )
    got = {
        key: list(zip(g.vec_id.astype(int), g.score))
        for key, g in rows.groupby(["q_id", "part"])
    }
    counts = out[out.block.notna()].groupby("block")[["load", "pruned"]].sum().astype(int)
    return got, [tuple(r) for r in counts.to_numpy()]


def make(n, m, dim, seed, kind=np.float32, scale=1.0, copies=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.linspace(2, 0.2, dim)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = rng.normal(size=(m, dim)) * np.linspace(2, 0.2, dim)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    if copies:  # a third of the rows and of the queries are one vector
        v[rng.permutation(n)[: n // 3]] = v[0]
        q[: m // 3] = v[0]
    ids = rng.permutation(n * 3)[:n].astype(np.int64)
    return ids, (v * scale).astype(kind), q


def best(scores, ids, k):
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


def compare(got, want):
    assert set(got) == {key for key, rows in want.items() if rows}
    for key, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in want[key]], key
        assert np.allclose([s for _, s in rows], [s for _, s in want[key]], rtol=1e-12, atol=2e-9)


@pytest.mark.parametrize(
    ("kind", "scale", "k", "dim"),
    [(np.float32, 1.0, 10, 64), (np.float64, 1.0, 3, 7), (np.float32, 1e3, 10, 16), (np.float64, 1e32, 5, 8)],
)
def test_full_scan(kind, scale, k, dim):
    copies = scale == 1.0
    ids, v, q = make(5000, 600, dim, 1, kind, scale, copies)
    parts = np.random.default_rng(2).integers(0, 2, len(ids))
    probes = scan.Probes(scan.QueryBlock(np.arange(600), q))
    got, counts = run(ids, v, parts, probes, k)
    s = np.round(q @ v.astype(float).T, 9)
    want = {(i, p): best(s[i][parts == p], ids[parts == p], k) for i in range(600) for p in (0, 1)}
    compare(got, want)
    assert counts == [(600 * 5000, 0)]


@pytest.mark.parametrize("bound", ["abs", "norm"])
@pytest.mark.parametrize(("dim", "n_blocks", "depth"), [(16, 4, 40), (5, 4, 400), (3, 5, 12), (64, 2, 2000)])
@pytest.mark.parametrize("upto", [None, 2])
def test_pruned_scan(bound, dim, n_blocks, depth, upto):
    ids, v, q = make(4000, 500, dim, 3)
    v64 = v.astype(float)
    blocks = dim_blocks(dim, n_blocks)
    last = n_blocks if upto is None else upto
    exact = np.round(q @ v64.T, 9)
    thr = np.sort(exact, axis=1)[:, -depth]
    limits = np.repeat(thr[:, None], n_blocks, axis=1)
    limits[::5] = -np.inf  # some probes come without a threshold
    limits[:, 0] = -np.inf if n_blocks == 4 else limits[:, 0]
    visits = {7: (np.arange(0, 500, 2), limits[::2])}
    probes = scan.Probes(scan.QueryBlock(np.arange(500), q), visits)
    parts = np.where(np.arange(4000) % 8 == 0, 3, 7)  # nobody visits 3
    prune = scan.Pruning(blocks, last, bound, 1e-9)
    got, counts = run(ids, v, parts, probes, 10, prune)

    mine = parts == 7
    a, b, want = q[::2], v64[mine], {}
    live, partial = np.ones((250, mine.sum()), bool), np.zeros((250, mine.sum()))
    expected = []
    for n, (s, e) in enumerate(blocks[:last]):
        if bound == "abs":
            rest = np.abs(a[:, s:]) @ np.abs(b[:, s:]).T
        else:
            rest = sum(
                np.outer(np.linalg.norm(a[:, x:y], axis=1), np.linalg.norm(b[:, x:y], axis=1))
                for x, y in blocks[n:]
            )
        keep = live & (np.round(partial + rest, 9) >= limits[::2, n, None] - 1e-9)
        expected.append((int(keep.sum()), int(live.sum() - keep.sum())))
        live = keep
        partial += a[:, s:e] @ b[:, s:e].T
    for i in range(250):
        row = live[i]
        want[2 * i, 7] = best(np.round(partial[i][row], 9), ids[mine][row], 10)
    compare(got, want)
    assert counts == expected


def test_rows_in_small_batches_and_one_by_one():
    ids, v, q = make(300, 20, 6, 5)
    probes = scan.Probes(scan.QueryBlock(np.arange(20), q))
    parts = np.zeros(300, dtype=int)
    whole = run(ids, v, parts, probes, 4)
    assert run(ids, v, parts, probes, 4, size=1) == whole
    assert run(ids, v, parts, probes, 4, size=64) == whole
