"""What a stage holds and how often it runs, apart from its rows."""

import pickle

import numpy as np
import pytest

from skewprobe.llm import simhash, toxicity
from skewprobe.llm.components import components
from skewprobe.session import ship


def test_links_run_once(spark):
    """However many rounds the components take, the links are found once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found = components(chain.mapInArrow(count, "u long, v long"))
    assert {r.root for r in found.collect()} == {0} and made.value == 40


def test_plan_counts_in_few_jobs(spark, monkeypatch):
    """The counts of the halves come in one job, not in one for each partition."""
    fps = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 300)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(3).localCheckpoint()
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = simhash.make_plan(nodes, 3, (2,))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 15
    for group, halves in zip(plan.groups, plan.counts, strict=True):
        for half, hist in zip(simhash._halves(group), halves, strict=True):
            assert (hist == np.bincount(simhash.pick(fps.view(np.uint64), half).astype(np.int64), minlength=len(hist))).all()


def _plain(unit: str, landmark: str) -> float:
    """The kernel by its definition."""

    def triples(text):
        out = {}
        for c in range(2, len(text)):
            for a in range(max(0, c - toxicity.SPAN + 1), c - 1):
                for b in range(a + 1, c):
                    key = text[a] + text[b] + text[c]
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (c - a + 1)
        return out

    x, y = triples(unit), triples(landmark)
    both = sum(x[k] * y.get(k, 0.0) for k in x)
    return (both / toxicity._scale(len(unit)) / toxicity._scale(len(landmark))) ** toxicity.POWER


@pytest.mark.parametrize("bound", [1, 50, 1 << 17])
def test_kernel_is_sparse(monkeypatch, bound):
    """Only the weights that are there are held; sums are the same however they are cut."""
    monkeypatch.setattr(toxicity, "TRIPLES", bound, raising=False)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in (3, 4, 5, 6, 9, 16, 24) for _ in range(8)]
    kernel = toxicity.Kernel(words[::2])
    got = kernel.values([*words, "ab", "zzzz"])
    want = [[_plain(u, v) for v in words[::2]] for u in words]
    np.testing.assert_allclose(got[: len(words)], want, rtol=1e-4, atol=1e-9)
    assert not got[len(words) :].any()
    wide = toxicity.Kernel(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 10)) for _ in range(192)])
    assert len(pickle.dumps(wide)) < 2_000_000


def test_batches_of_long_texts_are_small(spark):
    """Long texts go to a worker a few at a time; a setting of the session's own stays."""
    ship(spark)
    wide = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id % 10 as string), 100000) as text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    got = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 10_000_000
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000000")
        ship.__wrapped__(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before)
