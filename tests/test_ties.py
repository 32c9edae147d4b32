"""Samples, splits and numbers where rows share an id or have none."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skewprobe.operators import order, sampling


def rows(spark, ids, labels=None):
    labels = labels or ["x"] * len(ids)
    table = [(i, lab, n) for n, (i, lab) in enumerate(zip(ids, labels, strict=True))]
    return spark.createDataFrame(spark.sparkContext.parallelize(table, 7), "vec_id long, label string, n long")


@pytest.fixture(params=[1 << 20, 0], ids=["sorted", "bins"])
def direct(request, monkeypatch):
    monkeypatch.setattr(order.order_statistics, "__defaults__", (None, None, order.BINS, request.param))
    return request.param


@pytest.mark.parametrize(
    "ids", [[7] * 1000, [None] * 150 + list(range(50)), [i // 30 for i in range(900)], [None] * 900]
)
def test_uniform_sample_has_its_size(spark, ids, direct):
    found = sampling.uniform_sample(rows(spark, ids), size=100).collect()
    assert len(found) == 100 and len({r.n for r in found}) == 100


def test_rows_before_the_last_key_are_all_taken(spark, direct):
    ids = [i // 30 for i in range(900)]
    seen = Counter(r.vec_id for r in sampling.uniform_sample(rows(spark, ids), size=100).collect())
    assert sorted(seen.values()) == [10, 30, 30, 30]


def test_groups_have_their_size(spark, direct):
    ids = [i % 3 for i in range(900)]
    labels = ["hot" if i < 600 else None if i < 895 else "few" for i in range(900)]
    found = sampling.sample_per_group(rows(spark, ids, labels), "label", size=40).collect()
    assert Counter(r.label for r in found) == {"hot": 40, None: 40, "few": 5}
    assert len({r.n for r in found}) == 85


def test_split_meets_its_quotas(spark, direct):
    ids = [None if i % 2 else 5 for i in range(1000)]
    labels = ["a" if i < 700 else "b" for i in range(1000)]
    found = sampling.split_roles(rows(spark, ids, labels)).collect()
    assert len(found) == 1000 and len({r.n for r in found}) == 1000
    assert Counter((r.label, r.role) for r in found) == {
        ("a", "query"): 70, ("a", "base"): 630, ("b", "query"): 30, ("b", "base"): 270,
    }


def test_skewed_sample_has_its_shares(spark, direct):
    ids = [i % 4 for i in range(400)]
    labels = ["DoS" if i % 2 else "calm" for i in range(400)]
    found = sampling.skewed_sample(rows(spark, ids, labels), size=50).collect()
    assert Counter(r.hot for r in found) == {True: 40, False: 10}


def test_statistics_say_what_is_below_and_tied(spark, direct):
    table = spark.createDataFrame([(x,) for x in [1, 2, 2, 2, 3, 3, 9]], "v int")
    targets = spark.createDataFrame([(0, r) for r in (1, 3, 6, 8)], "grp int, rank long")
    found = order.order_statistics(table, F.col("v"), targets).collect()
    assert {r["rank"]: (r.value, r.below, r.tied) for r in found} == {1: (1, 0, 1), 3: (2, 1, 3), 6: (3, 4, 2)}


def test_numbers_are_whole_in_each_group(spark):
    ids = [None if i % 3 == 0 else i % 2 for i in range(500)]
    found = order.numbered(rows(spark, ids), ["vec_id"]).collect()
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r.number)
    assert len(found) == 500
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())
