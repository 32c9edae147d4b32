import math

import numpy as np
import pytest
from helpers import brute, frame, hits, same_hits, vectors
from pyspark.sql import functions as F

from skewprobe.operators import clean, features
from skewprobe.operators.metrics import imbalance, load_by, throughput
from skewprobe.plans import search
from skewprobe.plans.preprocess import preprocess
from skewprobe.plans.report import Run, measure, run_report
from skewprobe.sources import (
    export_labels,
    load_index,
    load_warmup,
    load_workload,
    merge_by_name,
    read_flows,
    trim_header,
    write_index,
)
from skewprobe.sources.flows import FILE, PIECE, scan_files


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text(
        " Flow ID, Dur ,Rate/s,Rate/s,Flag, Label\n"
        "f1,1,2.5,7,x, BENIGN \n"
        "f2,2,Infinity,8,y,DoS\n"
        "f3,3,NaN,9,z,DoS\n"
    )
    (tmp_path / "sub" / "b.csv").write_text(
        "Label,Dur,Rate/s,Rate/s.1,Extra\n,4,4.5,1,1d\nDDoS,5,-Infinity,2,2\nBENIGN,6,,3,3\nDoS,7,1,4,4\n"
    )
    (tmp_path / "notes.txt").write_text("not,a,flow\n1,2,3\n")
    return str(tmp_path)


def test_files_with_their_own_headers(spark, tree):
    flows = read_flows(spark, tree)
    types = dict(flows.dtypes)
    assert set(types) == {"Flow ID", "Dur", "Rate/s", "Rate/s.1", "Flag", "Label", "Extra"}
    assert {c for c, t in types.items() if t == "double"} == {"Dur", "Rate/s", "Rate/s.1"}
    rows = {r["Dur"]: r for r in flows.collect()}
    assert rows[1.0]["Rate/s"] == 2.5 and rows[1.0]["Rate/s.1"] == 7.0 and rows[1.0]["Label"] == " BENIGN "
    assert rows[2.0]["Rate/s"] == math.inf and rows[5.0]["Rate/s"] == -math.inf
    assert rows[3.0]["Rate/s"] is None and rows[6.0]["Rate/s"] is None
    assert rows[4.0]["Label"] is None and rows[4.0]["Flow ID"] is None and rows[4.0]["Extra"] == "1d"
    named = read_flows(spark, tree, numeric=["Dur"])
    assert dict(named.dtypes)["Rate/s"] == "string"


def test_quoted_breaks_short_rows_and_pattern_names(spark, tmp_path):
    (tmp_path / "x[1]{a}.csv").write_text('Dur,Note,Label\n1,"two\nlines, ""quoted""",A\n2,short\n3,,\n')
    flows = read_flows(spark, str(tmp_path))
    assert dict(flows.dtypes)["Dur"] == "double"
    rows = {r["Dur"]: (r["Note"], r["Label"]) for r in flows.collect()}
    assert rows == {1.0: ('two\nlines, "quoted"', "A"), 2.0: ("short", None), 3.0: (None, None)}
    assert flows.count() == 3


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("last", ["4", ""])
def test_a_row_with_too_many_cells_is_an_error(spark, tmp_path, multiline, last):
    (tmp_path / "x.csv").write_text(f'Dur,Note,Label\n1,a,A\n2,"b,""b""",,{last}\n')
    for numeric in (None, ["Dur"]):
        with pytest.raises(Exception, match="more cells than its header"):
            read_flows(spark, str(tmp_path), numeric, multiline).select("Dur").collect()
    with pytest.raises(Exception, match="more cells than its header"):
        read_flows(spark, str(tmp_path), ["Dur"], multiline).count()


def test_only_files_with_quoted_breaks_are_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a b").mkdir()
    lines = "".join(f'{i},"x ""{i}"", y",A\n' for i in range(4000))
    (tmp_path / "a b" / "plain%20é.csv").write_text("Dur,Note,Label\n" + lines)
    (tmp_path / "quoted.csv").write_text('Dur,Note,Label\n9001,"two\nlines",A\n')
    (tmp_path / "empty.csv").write_text("")
    found = {path.rsplit("/", 1)[1]: (line, breaks) for path, line, breaks in scan_files(spark, str(tmp_path))}
    assert found == {"plain%20é.csv": ("Dur,Note,Label", False), "quoted.csv": ("Dur,Note,Label", True)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        flows = read_flows(spark, str(tmp_path), numeric=["Dur"], places=True)
        pieces = flows.groupBy(FILE).agg(F.countDistinct(PIECE).alias("n")).collect()
        notes = {int(r.Dur): r.Note for r in flows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # The large file is split though nobody asked for it; the other is one piece.
    assert sorted(r.n > 4 for r in pieces) == [False, True]
    assert notes == {**{i: f'x "{i}", y' for i in range(4000)}, 9001: "two\nlines"}


def test_headers_take_one_job(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}.csv").write_text(f"Dur,Label\n{i},A\n" if i % 2 else f"Label,Dur\nA,{i}\n")
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    try:
        flows = read_flows(spark, str(tmp_path), numeric=["Dur"])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("headers")) <= 2
    assert sorted(r.Dur for r in flows.collect()) == list(range(40))


def test_rows_have_the_same_ids_however_files_are_split(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "day").mkdir(parents=True)
    for n, name in enumerate(("b.csv", "day/a.csv", "c.csv")):
        rows = [f"{n}.{i},{'' if i % 5 == 0 else i},{'DoS' if i % 3 else 'BENIGN'}" for i in range(3000)]
        (raw / name).write_text("x,y,Label\n" + "\n".join(rows) + "\n")
    seen = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k" if size == "8k" else "4m")
        try:
            out = str(tmp_path / size)
            preprocess(spark, str(raw), out, size=50).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        clean = spark.read.parquet(f"{out}/clean")
        ids = {r.flow_id: (r.x, r.y) for r in clean.collect()}
        loads = spark.read.parquet(f"{out}/workloads").select("workload", "q_id").collect()
        seen.append((ids, sorted(map(tuple, loads))))
    assert seen[0] == seen[1]
    ids = seen[0][0]
    assert sorted(ids) == list(range(7200))
    # In the order of the file and the place in it.
    by_id = [ids[i] for i in sorted(ids)]
    assert by_id[:4] == [(0.1, 1.0), (0.2, 2.0), (0.3, 3.0), (0.4, 4.0)] and by_id[-1] == (1.2999, 2999.0)


def test_no_csv_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_flows(spark, str(tmp_path))


def test_cleaning(spark, tree):
    table = clean.clean_flows(read_flows(spark, tree))
    assert table.columns == ["Dur", "Rate/s", "Rate/s.1", "Label"]
    rows = {r["Dur"]: r["Label"] for r in table.collect()}
    assert rows == {1.0: "BENIGN", 4.0: "nan", 7.0: "DoS"}
    with pytest.raises(KeyError):
        clean.clean_flows(table.drop("Label"))


def test_header_trim_and_merge(spark):
    a = trim_header(spark.createDataFrame([(1, 2)], [" a ", "b"]))
    b = spark.createDataFrame([(3, "t")], ["b", "c"])
    rows = {tuple(r) for r in merge_by_name([a, b]).select("a", "b", "c").collect()}
    assert rows == {(1, 2, None), (None, 3, "t")}


def test_standardise_and_constant_columns(spark):
    x = np.array([[1.0, 5.1], [2.0, 5.1], [6.0, 5.1]])
    df = spark.createDataFrame(x.tolist(), ["a", "odd name.1"])
    got = np.array([tuple(r) for r in features.standardise(df, df.columns).collect()])
    assert np.allclose(got[:, 0], (x[:, 0] - 3) / x[:, 0].std())
    assert np.allclose(got[:, 1], 0)


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    got = {r.id: r.v for r in features.l2_normalise(df, "v").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_vectors_match_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 2.0  # constant
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", "a", "b.1", "c d", "e", "f"])
    table, model = features.vectorise(df, df.columns[1:], dims=3)
    got = np.array([r.embedding for r in table.orderBy("id").collect()])
    assert table.columns == [*df.columns, "embedding"] and got.shape == (80, 3)
    dev = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(dev > 1e-12, dev, 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = (u * s)[:, :3]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)
    again, _ = features.vectorise(df, df.columns[1:], dims=3, model=model)
    assert np.allclose(got, [r.embedding for r in again.orderBy("id").collect()])


def test_from_csv_to_search(spark, tmp_path):
    rng = np.random.default_rng(7)
    raw = tmp_path / "raw"
    (raw / "day").mkdir(parents=True)
    for n, name in enumerate(("one.csv", "day/two.csv")):
        lines = [" Source IP, a, b,c , Label"]
        for i in range(150):
            cells = ",".join(f"{x:.4f}" for x in rng.normal(size=3))
            lines.append(f"10.0.0.{i},{cells},{'DoS Hulk' if i % 3 == 0 else 'BENIGN'}")
        (raw / name).write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    report = {r.metric: r.value for r in preprocess(spark, str(raw), out, size=20).collect()}
    assert report == {
        "files": 2, "clean_rows": 300, "dims": 3, "base_vectors": 270,
        "query_vectors": 30, "uniform_queries": 20, "skewed_queries": 20,
    }
    labels = spark.read.csv(f"{out}/query_labels", header=True)
    assert labels.columns == ["label"] and labels.count() == 30
    base, skewed = load_workload(spark, out, "skewed")
    # Ten of thirty held-out rows are hot; cold ones fill up to twenty.
    assert skewed.where("label = 'DoS Hulk'").count() == 10 and skewed.count() == 20
    with pytest.raises(ValueError):
        load_workload(spark, out, "bursty")
    _, uniform = load_workload(spark, out)
    assert uniform.count() == 20 and dict(base.dtypes)["embedding"] == "array<float>"
    found = hits(search.full_search(uniform, base, 3))
    assert len(found) == 20 and all(len(h) == 3 for h in found.values())


def test_index_round_trip(spark, tmp_path):
    rows = [(i, [float(i), 1.0], i % 3) for i in range(30)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    centroids = spark.createDataFrame([(0, [1.0, 0.0])], "part int, c array<double>")
    write_index(str(tmp_path), base, centroids, warmup_rows=4)
    parts, c = load_index(spark, str(tmp_path))
    assert {(r.vec_id, r.part) for r in parts.collect()} == {(i, i % 3) for i in range(30)}
    assert c.count() == 1
    warm = load_warmup(spark, str(tmp_path))
    assert [r["count"] for r in warm.groupBy("part").count().collect()] == [4, 4, 4]
    export_labels(base.selectExpr("vec_id", "part as label"), str(tmp_path / "l"), id="vec_id")
    assert spark.read.csv(str(tmp_path / "l"), header=True).count() == 30


def test_loads_and_rates(spark):
    loads = spark.createDataFrame([(0, 6), (1, 0), (2, 3)], "part int, load long")
    assert imbalance(loads).first().imbalance == pytest.approx(2.0)
    assert imbalance(loads.withColumn("load", loads.load * 0)).first().imbalance == 0.0
    assert imbalance(loads.limit(0)).first().imbalance == 0.0
    visits = spark.createDataFrame([(0,), (0,), (2,)], "part int")
    assert {tuple(r) for r in load_by(visits, "part", loads).collect()} == {(0, 2), (1, 0), (2, 1)}
    times = spark.createDataFrame([(0.5,), (1.5,)], "elapsed_s double")
    assert throughput(times, "elapsed_s").first().qps == 1.0
    assert throughput(times.limit(0), "elapsed_s").first().qps == 0.0
    assert throughput(times.selectExpr("elapsed_s * 0 as elapsed_s"), "elapsed_s").first().qps == 0.0


def test_run_report_with_times(spark):
    loads = spark.createDataFrame([(0, 6), (1, 2)], "part int, load long")
    times = spark.createDataFrame([(0.5,), (1.5,)], "elapsed_s double")
    run = Run("sharded", "uniform", times, {"shard": loads}, {"pruned": loads}, times)
    rows = {(r.metric, r.bucket): r.value for r in run_report([run]).collect()}
    assert rows["queries", -1] == 2 and rows["shard_imbalance", -1] == 1.5
    assert rows["shard_load", 0] == 6 and rows["pruned", 1] == 2
    assert rows["qps", -1] == 1.0 and rows["p95_latency", -1] == pytest.approx(1.45)


def test_a_measured_search_fills_the_report(spark):
    b, q = vectors(200, dim=8, seed=41), vectors(30, dim=8, seed=42)
    qs, base = frame(spark, q, id="q_id", vec="qv"), frame(spark, b)
    done = measure(qs, lambda some: search.full_search(some, base, 5), batches=3)
    same_hits(hits(done.hits), brute(q, b, 5))
    times = {r.q_id: (r.batch, r.elapsed_s) for r in done.durations.collect()}
    assert set(times) == set(range(30)) and all(t > 0 for _, t in times.values())
    assert len({t for t in times.values()}) == len({i for i, _ in times.values()}) > 1
    rows = {r.metric: r.value for r in run_report([Run("full", "uniform", qs, durations=done.durations)]).collect()}
    assert 0 < rows["mean_latency"] <= rows["p99_latency"] and rows["p95_latency"] <= rows["p99_latency"]
    assert rows["qps"] == pytest.approx(30 / sum(t for _, t in times.values()))
    none = measure(qs.limit(0), lambda some: search.full_search(some, base, 5))
    assert none.hits.count() == none.durations.count() == 0
