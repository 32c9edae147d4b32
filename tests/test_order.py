import numpy as np
import pytest
from pyspark.sql import functions as F

from skewprobe.operators.metrics import latency_summary
from skewprobe.operators.order import order_statistics


@pytest.mark.parametrize(("bins", "direct"), [(8, 0), (1 << 16, 0), (16, 1000)])
def test_ranks_with_a_value_on_a_third_of_the_rows(spark, bins, direct):
    rng = np.random.default_rng(0)
    values = np.round(rng.exponential(size=300) ** 6, 6)
    values[:100] = values[150]
    rows = [(i % 2, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    wanted = [1, 2, 40, 75, 76, 149, 150, 151, 0]
    targets = spark.createDataFrame([(g, r) for g in (0, 1) for r in wanted], "grp int, rank long")
    found = order_statistics(df, F.col("v"), targets, F.col("g"), bins=bins, direct=direct).collect()
    got = {(r.grp, r.rank): r.value for r in found}
    expected = {}
    for g in (0, 1):
        ordered = sorted(v for k, v in rows if k == g)
        expected |= {(g, r): ordered[r - 1] for r in wanted if 1 <= r <= 150}
    assert got == expected


@pytest.mark.parametrize("bins", [8, 1 << 16])
def test_large_integers_and_nulls(spark, bins):
    values = [i * 7919 % 1000 + (1 << 59) for i in range(200)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v long")
    targets = spark.createDataFrame([(0, r) for r in (1, 100, 200)], "grp int, rank long")
    found = {r.rank: r.value for r in order_statistics(df, F.col("v"), targets, bins=bins, direct=0).collect()}
    ordered = sorted(v for v in values if v is not None)
    assert found == {r: ordered[r - 1] for r in (1, 100, 200)}


def test_constant_values_and_empty_table(spark):
    df = spark.createDataFrame([(1.5,)] * 50, "v double")
    targets = spark.createDataFrame([(0, 25)], "grp int, rank long")
    for direct in (0, 100):
        assert order_statistics(df, F.col("v"), targets, direct=direct).first().value == 1.5
        assert order_statistics(df.limit(0), F.col("v"), targets, direct=direct).count() == 0


def test_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.exponential(size=137), "b": np.array([3.0]), "c": np.array([2.0, 1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in latency_summary(df, "v", "g").collect()}
    for g, vs in groups.items():
        assert found[g].queries == len(vs)
        assert found[g]["mean"] == pytest.approx(vs.mean())
        assert found[g].p95 == pytest.approx(np.percentile(vs, 95))
        assert found[g].p99 == pytest.approx(np.percentile(vs, 99))
    whole = latency_summary(df, "v").first()
    assert whole.p95 == pytest.approx(np.percentile([v for _, v in rows], 95))


@pytest.mark.parametrize("direct", [0, 1000])
@pytest.mark.parametrize("bins", [8, 1 << 12])
def test_values_that_no_bin_width_fits(spark, bins, direct):
    inf, nan = float("inf"), float("nan")
    values = [inf, inf, -inf, nan, nan, 1e308, -1e308, 1.7e308, -1.7e308, 5e-324, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    targets = spark.range(1, 20).selectExpr("0 as grp", "id as rank")
    found = order_statistics(df, F.col("v"), targets, bins=bins, direct=direct).collect()
    got = [r.value for r in sorted(found, key=lambda r: r["rank"])]
    assert np.array_equal(got, np.sort(values), equal_nan=True)


@pytest.mark.parametrize("direct", [0, 1000])
def test_null_is_a_group(spark, direct):
    rows = [(None if i % 2 else "a", float(i)) for i in range(40)] + [("b", float("inf"))] * 3
    df = spark.createDataFrame(rows, "g string, v double")
    targets = spark.createDataFrame([(None, 5), ("a", 5), ("b", 2)], "grp string, rank long")
    found = order_statistics(df, F.col("v"), targets, F.col("g"), direct=direct).collect()
    assert {r.grp: r.value for r in found} == {None: 9.0, "a": 8.0, "b": float("inf")}
    summary = {r.g: r for r in latency_summary(df, "v", "g", direct=direct).collect()}
    assert summary[None].p95 == pytest.approx(np.percentile(np.arange(1, 40, 2), 95))
    assert summary["b"].p99 == float("inf")
