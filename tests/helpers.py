"""Brute-force counterparts on the driver, for small fixtures only."""

from __future__ import annotations

import numpy as np


def vectors(n, dim=16, seed=0, copies=0):
    """``n`` rows; the last ``copies`` of them repeat one earlier row."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.linspace(2.0, 0.2, dim)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if copies:
        v[n - copies :] = v[0]
    return v.astype(np.float32)


def frame(spark, v, parts=None, id="vec_id", vec="embedding", slices=3, kind="float", ids=None):
    ids = range(len(v)) if ids is None else ids
    rows = [
        (int(i), [float(x) for x in row], *([int(parts[j])] if parts is not None else []))
        for j, (i, row) in enumerate(zip(ids, v))
    ]
    schema = f"{id} long, {vec} array<{kind}>" + (", part int" if parts is not None else "")
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), schema)


def scores(q, b):
    return np.round(q.astype(float) @ b.astype(float).T, 9)


def top(s, ids, k):
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def brute(q, b, k, parts=None, visits=None):
    """Per query the best rows, over its visited partitions if given."""
    out = {}
    ids = np.arange(len(b))
    s = scores(q, b)
    for i in range(len(q)):
        keep = ids if visits is None else ids[np.isin(parts, visits[i])]
        out[i] = top(s[i][keep], keep, k)
    return out


def hits(df):
    out = {}
    for r in df.orderBy("q_id", "rk").collect():
        out.setdefault(r.q_id, []).append((r.vec_id, r.score))
    return out


def same_hits(found, expected):
    expected = {q: h for q, h in expected.items() if h}
    assert set(found) == set(expected)
    for q, rows in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in rows], q
        assert np.allclose([s for _, s in found[q]], [s for _, s in rows], atol=2e-9)


def compat_stage(q, b, ids, blocks, k, thr, rising=True, first=True):
    """One query against one partition with thresholds from partial scores."""
    q, b = q.astype(float), b.astype(float)
    loads, drops = [0] * len(blocks), [0] * len(blocks)
    live, partial = np.arange(len(b)), np.zeros(len(b))
    for n, (s, e) in enumerate(blocks):
        if len(live) == 0:
            break
        if n or first:
            bound = np.abs(b[live, s:]) @ np.abs(q[s:])
            keep = np.round(partial[live] + bound, 9) >= thr
            drops[n] = int((~keep).sum())
            live = live[keep]
            if len(live) == 0:
                break
        loads[n] = len(live)
        partial[live] += b[live, s:e] @ q[s:e]
        kth = np.sort(np.round(partial[live], 9))[::-1][:k][-1]
        thr = max(thr, kth) if rising else kth
    return top(np.round(partial[live], 9), ids[live], k), loads, drops, thr
