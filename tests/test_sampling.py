import hashlib
import math

import pytest

from skewprobe.functions.keys import is_hot
from skewprobe.operators import order
from skewprobe.operators.sampling import (
    sample_per_group,
    skewed_sample,
    stratified_split,
    uniform_sample,
)


def by_key(ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())


def table(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "vec_id long, label string").repartition(3)


def ids(df):
    return {r.vec_id for r in df.collect()}


def quotas(labels, fraction):
    total = len(labels)
    wanted = math.ceil(fraction * total)
    counts = {x: labels.count(x) for x in set(labels)}
    shares = {x: n * wanted // total for x, n in counts.items()}
    left = sorted(counts, key=lambda x: (-(counts[x] * wanted % total), x))
    for x in left[: wanted - sum(shares.values())]:
        shares[x] += 1
    return shares


@pytest.fixture(params=[0, 1000])
def direct(request, monkeypatch):
    """Both ways to a rank: by histogram, and directly for small groups."""
    narrow = order.order_statistics
    for module in ("order", "partition"):
        monkeypatch.setattr(
            f"skewprobe.operators.{module}.order_statistics",
            lambda *a, **k: narrow(*a, **k, bins=4, direct=request.param),
        )


@pytest.mark.parametrize("fraction", [0.1, 0.37])
def test_split_keeps_label_shares(spark, direct, fraction):
    labels = ["a"] * 70 + ["b"] * 33 + ["c"] * 4 + ["only"]
    base, query = stratified_split(table(spark, labels), fraction=fraction)
    expected = set()
    for label, n in quotas(labels, fraction).items():
        expected |= set(by_key([i for i, x in enumerate(labels) if x == label])[:n])
    assert ids(query) == expected
    assert ids(base) == set(range(len(labels))) - expected


def test_uniform_sample(spark, direct):
    df = table(spark, ["x"] * 90)
    assert ids(uniform_sample(df, size=25)) == set(by_key(range(90))[:25])
    assert ids(uniform_sample(df, size=900)) == set(range(90))
    assert ids(uniform_sample(df, size=0)) == set()


def test_sample_per_group(spark, direct):
    labels = ["a"] * 50 + ["b"] * 3
    got = ids(sample_per_group(table(spark, labels), "label", size=7))
    assert got == set(by_key(range(50))[:7]) | {50, 51, 52}


@pytest.mark.parametrize(
    ("hot", "cold", "size", "n_hot", "n_cold"),
    [
        (60, 60, 50, 40, 10),
        (10, 60, 50, 10, 40),  # cold rows fill up
        (60, 5, 50, 40, 5),  # hot rows do not
        (3, 4, 50, 3, 4),
        (9, 9, 1, 0, 1),
    ],
)
def test_skewed_sample(spark, direct, hot, cold, size, n_hot, n_cold):
    labels = ["DDoS attack"] * (hot // 2) + ["dos Hulk"] * (hot - hot // 2) + ["BENIGN"] * cold
    got = ids(skewed_sample(table(spark, labels), size=size))
    assert got == set(by_key(range(hot))[:n_hot]) | set(by_key(range(hot, hot + cold))[:n_cold])


def test_skewed_sample_needs_both_groups(spark):
    for labels in (["BENIGN"] * 5, ["DoS"] * 5):
        with pytest.raises(ValueError):
            skewed_sample(table(spark, labels))


def test_hot_labels(spark):
    rows = [("x DDOS y",), ("Dos",), ("benign",), (None,)]
    df = spark.createDataFrame(rows, "label string")
    assert [r.h for r in df.select(is_hot("label").alias("h")).collect()] == [True, True, False, False]


def test_rows_without_a_label_have_their_quota(spark):
    rows = [(i, None if i % 2 else "a") for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, label string")
    base, query = stratified_split(df)
    assert (base.count(), query.where("label is null").count(), query.count()) == (900, 50, 100)
    sample = sample_per_group(df, "label", size=70)
    assert (sample.where("label is null").count(), sample.count()) == (70, 140)
