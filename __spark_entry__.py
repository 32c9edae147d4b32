
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from functools import cached_property, lru_cache
from pathlib import Path

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

import oracle  # noqa: E402
from skewprobe.functions.keys import is_hot  # noqa: E402
from skewprobe.functions.vectors import (  # noqa: E402
    block_bounds,
    block_scores,
    dim_blocks,
    dot_scores,
    search_cast,
    suffix_bounds,
)
from skewprobe.operators import clean, features, metrics, partition, sampling  # noqa: E402
from skewprobe.operators.groups import BLOCKS  # noqa: E402
from skewprobe.operators.scan import DECIMALS  # noqa: E402
from skewprobe.operators.topk import kth_threshold, topk  # noqa: E402
from skewprobe.plans import pruned, search  # noqa: E402
from skewprobe.plans.preprocess import vectors_of  # noqa: E402
from skewprobe.plans.report import Run, run_report  # noqa: E402
from skewprobe.session import shared_dir, ship, stage  # noqa: E402
from skewprobe.sources import (  # noqa: E402
    load_groups,
    load_index,
    load_workload,
    merge_by_name,
    read_flows,
    select_workload,
    workload_table,
    write_index,
    write_sets,
)

try:
    from skewprobe.llm import registry as llm
except ImportError as missing:
    # Without the subpackage, or something that it needs, the other queries are still there.
    print(f"corpus queries left out: {missing}", file=sys.stderr)
    llm = None

LINE_IDS = ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


class Fixture:
    """The given tables in their roles, with the small shared results written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").withColumn("label", F.col("label").cast("string"))

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        """Base and held-out vectors, written once as the searches would find them."""
        roles = stage(sampling.split_roles(self.vectors), "roles")
        return tuple(roles.where(F.col("role") == r).drop("role") for r in ("base", "query"))

    @property
    def base(self) -> DataFrame:
        return self.split[0]

    @property
    def held(self) -> DataFrame:
        return self.split[1]

    @cached_property
    def uniform(self) -> DataFrame:
        return stage(sampling.uniform_sample(self.held), "uniform")

    @cached_property
    def skewed(self) -> DataFrame:
        half = self.held.count() // 2
        return stage(
            sampling.skewed_sample(self.held, size=half, patterns=oracle.HOT_LABELS), "skewed"
        )

    @cached_property
    def workloads(self) -> DataFrame:
        return workload_table(self.uniform, self.skewed)

    def queries(self, workload: str = "uniform") -> DataFrame:
        return select_workload(self.workloads, workload).select("q_id", "qv")

    @cached_property
    def shards(self) -> DataFrame:
        return partition.random_shards(self.base)

    @cached_property
    def centroids(self) -> DataFrame:
        return stage(partition.mean_centroids(self.base, "label"), "centroids")

    @cached_property
    def parts(self) -> DataFrame:
        """The base with its partitions, written and read as an index."""
        path = f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
        write_index(path, partition.assign_nearest(self.base, self.centroids), self.centroids)
        return load_index(self.spark, path)[0]

    @cached_property
    def grouped(self) -> tuple[DataFrame, DataFrame]:
        """The same partitions as an index with groups, and the summaries of these."""
        path = f"{shared_dir(self.spark)}/grouped-{uuid.uuid4().hex}"
        write_index(path, self.parts, self.centroids, groups=oracle.GROUPS)
        return load_index(self.spark, path)[0], load_groups(self.spark, path)

    @cached_property
    def routes(self) -> DataFrame:
        return stage(search.route(self.queries(), self.centroids, oracle.NPROBE), "routes")

    @cached_property
    def routed_thr(self) -> DataFrame:
        found = pruned.prewarm_per_query(
            self.queries(), self.parts, n_v=oracle.SAMPLE_PER_PART, routes=self.routes
        )
        return stage(found, "thresholds")

    @cached_property
    def first_stage(self) -> pruned.Stage:
        first = self.routes.where("probe = 1")
        return pruned.vector_pipeline(self.queries(), self.parts, first, self.routed_thr)

    @cached_property
    def explained(self) -> DataFrame:
        """The hits of the full search joined back to both vectors."""
        hits = search.full_search(self.queries(), self.base)
        return search.attach_vectors(hits, self.queries(), self.base)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def raw_events(self) -> DataFrame:
        """Events as a flow table, with gaps and odd values put in by id."""
        n = F.col("event_id")
        padded = F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))
        value = (
            F.when(n % 89 == 0, F.lit(float("nan")))
            .when(n % 101 == 0, F.lit(float("inf")))
            .when(n % 103 == 0, F.lit(float("-inf")))
            .when(n % 107 == 0, F.lit(None).cast("double"))
            .otherwise(F.col("value"))
        )
        return self.events.select(
            "event_id", F.when(n % 97 != 0, padded).alias("label"), value.alias("value")
        )

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def sets_path(self) -> str:
        """Base, query set, workloads and labels, written as a search would find them."""
        path = f"{shared_dir(self.spark)}/sets-{uuid.uuid4().hex}"
        write_sets(path, self.base, self.held, self.uniform, self.skewed)
        return path

    @cached_property
    def csv_path(self) -> str:
        """The raw events as two CSV folders whose headers differ in order and spacing."""
        path = f"{shared_dir(self.spark)}/flows-{uuid.uuid4().hex}"
        early = F.col("event_id") <= self.events.agg(F.avg("event_id")).first()[0]
        one = self.raw_events.where(early).toDF(" event_id", " Label", "value ")
        two = self.raw_events.where(~early).select("value", "event_id", "label")
        one.write.csv(f"{path}/one", header=True, ignoreTrailingWhiteSpace=False)
        two.toDF("value", "event_id ", "Label").write.csv(f"{path}/day/two", header=True)
        return path

    @cached_property
    def flows(self) -> DataFrame:
        """Line items as a written clean flow table with one text id."""
        table = self.lineitem.withColumn(
            "flow_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        )
        flows = clean.clean_flows(table, "l_returnflag", LINE_IDS, ("flow_id",))
        return stage(flows, "flows", 1 << 16)


@lru_cache(maxsize=None)
def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    ship(spark)
    return Fixture(spark, str(sf_dir))


def _hits(df: DataFrame, part: bool = True) -> DataFrame:
    return df.select("q_id", *(["part"] if part else []), "vec_id", "score", "rk")


def _rounded(df: DataFrame, prefix: str, digits: int = DECIMALS) -> DataFrame:
    return df.select(
        "q_id", "vec_id", *[F.round(c, digits).alias(c) for c in df.columns if c.startswith(prefix)]
    )


def _elements(df: DataFrame, vector: str, *keys: str, digits: int | None = None) -> DataFrame:
    out = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return out.withColumn("x", x if digits is None else F.round(x, digits))


def _dim_exact(t: Fixture, workload: str = "uniform") -> pruned.Pruned:
    return pruned.dimension_search(t.queries(workload), t.base, n_v=oracle.SAMPLE_ROWS)


def _dim_compat(t: Fixture) -> pruned.Pruned:
    return pruned.dimension_search(t.queries(), t.base, mode="compat")


def _pipeline(t: Fixture, mode: str, workload: str = "uniform") -> pruned.Pruned:
    n_v = oracle.SAMPLE_PER_PART if mode == "exact" else oracle.SAMPLE_ROWS
    return pruned.full_pipeline(
        t.queries(workload), t.parts, t.centroids, mode=mode, n_v=n_v, n_q=oracle.WARM_QUERIES
    )


def _pipeline_groups(t: Fixture) -> pruned.Pruned:
    base, groups = t.grouped
    return pruned.full_pipeline(t.queries(), base, t.centroids, groups=groups)


def _dim_groups(t: Fixture) -> pruned.Pruned:
    base, groups = t.grouped
    return pruned.dimension_search(t.queries(), base, n_v=oracle.SAMPLE_ROWS, groups=groups)


def _group_pairs(t: Fixture) -> DataFrame:
    """Pairs of a query and a row that were scored or dropped, by partition: all routed ones."""
    found = _pipeline_groups(t).counts.where("block = 0")
    return found.select("part", (F.col("load") + F.col("pruned")).alias("load"))


def _group_cover(t: Fixture) -> DataFrame:
    """Rows of each partition, and those that are within the radii and lengths of their group."""
    base, groups = t.grouped
    away = F.transform(F.arrays_zip("embedding", "c"), lambda x: x["embedding"].cast("double") - x["c"])
    rows = base.select("vec_id", "part", "cell", "embedding").join(groups.drop("part", "n"), "cell")
    rows = rows.withColumn("away", away).withColumn("v", F.col("embedding").cast("array<double>"))

    def length(x: str, s: int, e: int) -> Column:
        return F.sqrt(F.aggregate(F.slice(x, s + 1, e - s), F.lit(0.0), lambda a, y: a + y * y))

    inside = length("away", 0, oracle.DIM) <= F.col("radius") + 1e-9
    for b, (s, e) in enumerate(dim_blocks(oracle.DIM, BLOCKS)):
        inside &= length("away", s, e) <= F.col("radii")[b] + 1e-9
        inside &= length("v", s, e).between(F.col("shortest")[b] - 1e-9, F.col("longest")[b] + 1e-9)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(inside).alias("covered"))


def _open_stage(t: Fixture) -> pruned.Stage:
    """Every routed pair in the compatible mode, without a threshold to start from."""
    probes = t.routes.select("q_id", "part", F.lit(float("-inf")).alias("thr"))
    return pruned.dimension_pipeline(t.queries(), t.parts, probes, mode="compat")


def _dot_scores(t: Fixture) -> DataFrame:
    pairs = t.base.join(t.centroids, F.col("label").cast("int") == F.col("part"))
    scored = dot_scores(pairs, "embedding", "c")
    return scored.select("vec_id", F.round("score", DECIMALS).alias("score"))


def _bound_filter(t: Fixture) -> DataFrame:
    hits = search.routed_topk(t.queries(), t.parts, t.routes)
    pairs = search.attach_vectors(hits, t.queries(), t.parts)
    ranges = dim_blocks(oracle.DIM, oracle.BLOCKS)
    pairs = suffix_bounds(block_bounds(block_scores(pairs, ranges), ranges), oracle.BLOCKS)
    thr = kth_threshold(hits.drop("rk"))
    return pruned.bound_filter(pairs, thr, 2).select("q_id", "vec_id")


def _standardise(t: Fixture) -> DataFrame:
    table = features.standardise(t.lineitem, oracle.FEATURES)
    return table.select(
        F.col("l_returnflag").alias("label"), *[F.round(c, 6).alias(c) for c in oracle.FEATURES]
    )


def _l2_normalise(t: Fixture) -> DataFrame:
    by_label = F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x * F.col("label").cast("int")
    )
    table = features.l2_normalise(t.vectors.withColumn("embedding", by_label), "embedding")
    return _elements(table, "embedding", "vec_id", digits=DECIMALS)


def _search_cast(t: Fixture) -> DataFrame:
    thirds = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 3)
    table = search_cast(t.vectors.withColumn("embedding", thirds), "embedding")
    return _elements(table, "embedding", "vec_id")


def _split_roles(t: Fixture) -> DataFrame:
    table = t.events.select("event_id", F.col("event_type").alias("label"))
    base, query = sampling.stratified_split(table, "event_id", "label")
    return base.withColumn("role", F.lit("base")).unionByName(
        query.withColumn("role", F.lit("query"))
    )


def _skewed_events(t: Fixture) -> DataFrame:
    table = t.events.select("event_id", F.col("event_type").alias("label"))
    return sampling.skewed_sample(
        table, "event_id", "label", patterns=oracle.HOT_EVENTS
    ).select("event_id", "hot")


def _vectorise_chain(t: Fixture) -> DataFrame:
    """Squared length of the mean vector per label: free of the signs a projection may choose."""
    table, _ = features.vectorise(t.flows, list(oracle.FEATURES))
    mean = vector_to_array(Summarizer.mean(array_to_vector("embedding")))
    square = F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x)
    return table.groupBy(F.col("l_returnflag").alias("label")).agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).alias("dims"),
        F.round(square, 6).alias("mean_square"),
    )


def _flow_search(t: Fixture) -> DataFrame:
    """The ten line items closest to the mean direction of each label.

    All components are kept, so scores do not depend on the projection.
    """
    table, _ = features.vectorise(t.flows, list(oracle.FEATURES))
    code = F.array_position(F.array(*[F.lit(x) for x in oracle.FLAGS]), F.col("l_returnflag"))
    base = table.select(F.xxhash64("flow_id").alias("vec_id"), "embedding", code.alias("flag"))
    means = partition.mean_centroids(base, "flag")
    q = means.select(F.col("part").cast("long").alias("q_id"), F.col("c").alias("qv"))
    return search.full_search(q, base).select("q_id", "rk", F.round("score", 5).alias("score"))


def _read_flows(t: Fixture) -> DataFrame:
    table = clean.clean_flows(read_flows(t.spark, t.csv_path), carry=("event_id",))
    return table.select(F.col("event_id").cast("long"), F.col("Label").alias("label"), "value")


def _read_quoted(t: Fixture) -> DataFrame:
    """Events as CSV whose labels hold line breaks and quotes, read back."""
    path = f"{shared_dir(t.spark)}/quoted-{uuid.uuid4().hex}"
    label = F.concat("event_type", F.lit(', "a"\nb '), F.col("event_id").cast("string"))
    written = t.events.select("event_id", label.alias("label"), "value")
    written.write.csv(f"{path}/day[1]", header=True, escape='"', ignoreTrailingWhiteSpace=False)
    table = read_flows(t.spark, path, numeric=("value",))
    return table.select(F.col("event_id").cast("long"), "label", "value")


def _dirty_search(t: Fixture) -> DataFrame:
    """Every 50th stored vector holds a component that is no number."""
    bad = F.transform(
        "embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x).cast("float")
    )
    rows = F.when(F.col("vec_id") % 50 == 0, bad).otherwise(F.col("embedding"))
    return _hits(search.full_search(t.queries(), t.base.withColumn("embedding", rows)), False)


def _split_null_label(t: Fixture) -> DataFrame:
    label = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    table = t.events.select("event_id", label.alias("label"))
    return sampling.split_roles(table, "event_id", "label").select("event_id", "label", "role")


def _latency_nonfinite(t: Fixture) -> DataFrame:
    """Order statistics by histograms at every size; infinite and missing durations, no type for some."""
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    value = F.when(F.col("value") < 5, float("-inf")).when(F.col("value") > 60, float("inf"))
    table = t.events.select(kind.alias("event_type"), value.otherwise(F.col("value")).alias("value"))
    found = metrics.latency_summary(table, "value", "event_type", (10, 50, 95), direct=0)
    return found.select("event_type", "queries", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p95")])


def _label_export(t: Fixture) -> DataFrame:
    roles = [
        t.spark.read.csv(f"{t.sets_path}/{role}_labels", header=True).withColumn("role", F.lit(role))
        for role in ("base", "query")
    ]
    labels = roles[0].unionByName(roles[1])
    return labels.groupBy("role", "label").agg(F.count("*").alias("load"))


def _load_workload(t: Fixture) -> DataFrame:
    base, q = load_workload(t.spark, t.sets_path, "skewed")
    return search.full_search(q, base).select("q_id", "vec_id", "score", "rk")


def _pca_vectors(t: Fixture) -> DataFrame:
    table, _ = features.vectorise(t.flows, list(oracle.FEATURES), dims=3)
    return table.select("flow_id", "embedding")


def _kmeans(t: Fixture) -> DataFrame:
    centroids = partition.fit_centroids(t.base)
    return partition.assign_nearest(t.base, centroids).groupBy("part").agg(
        F.count("*").alias("n")
    )


def _latency(t: Fixture) -> DataFrame:
    table = metrics.latency_summary(t.events, "value", "event_type")
    return table.select(
        "event_type", "queries", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "p99")]
    )


def _preprocess_report(t: Fixture) -> DataFrame:
    vectors, _ = vectors_of(t.flows, "flow_id", "l_returnflag")
    base, query = sampling.stratified_split(vectors)
    uniform = sampling.uniform_sample(query)
    skewed = sampling.skewed_sample(query, patterns=oracle.HOT_FLAGS)
    files = len(t.lineitem.inputFiles())
    return metrics.preprocess_report(t.flows, base, query, uniform, skewed, files)


def _run_report(t: Fixture) -> DataFrame:
    runs = []
    for workload in ("uniform", "skewed"):
        q = t.queries(workload)
        shards = search.sharded_search(q, t.shards)
        ivf = search.ivf_search(q, t.parts, t.centroids)
        routes = search.route(q, t.centroids)
        dims, full = _dim_exact(t, workload), _pipeline(t, "exact", workload)
        runs += [
            Run("random", workload, q, {"shard": shards.loads}),
            Run("cluster", workload, q, {"shard": ivf.loads}),
            Run(
                "dimension", workload, q,
                {"block": dims.blocks().select("block", "load")},
                {"pruned": dims.blocks().select("block", "pruned")},
            ),
            Run(
                "pipeline", workload, q,
                {
                    "routing": pruned.routing_load(routes, t.centroids),
                    "partition": full.partitions(t.centroids),
                    "block": full.blocks().select("block", "load"),
                },
                {"pruned": full.blocks().select("block", "pruned")},
            ),
        ]
    return run_report(runs).withColumn("value", F.round("value", 6))


def _blocks_of(t: Fixture) -> DataFrame:
    dim = t.vectors.agg(F.max(F.size("embedding"))).first()[0]
    rows = [(i, s, e) for i, (s, e) in enumerate(dim_blocks(dim, 7))]
    return t.spark.createDataFrame(rows, "block int, start int, stop int")


def _explained(t: Fixture) -> DataFrame:
    ranges = dim_blocks(oracle.DIM, oracle.BLOCKS)
    return block_bounds(block_scores(t.explained, ranges), ranges)


QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {
    # scoring, ranking and exact search
    "dot_scores": _dot_scores,
    "full_search": lambda t: _hits(search.full_search(t.queries(), t.base), False),
    "full_search_dirty": _dirty_search,
    "random_shards": lambda t: t.shards.select("vec_id", "part"),
    "shard_topk": lambda t: _hits(search.local_topk(t.queries(), t.shards)),
    "topk_merge": lambda t: _hits(topk(search.local_topk(t.queries(), t.shards).drop("rk"))),
    "random_shard_search": lambda t: _hits(search.sharded_search(t.queries(), t.shards).hits),
    "shard_scan_load": lambda t: search.sharded_search(
        t.queries(), t.shards, shards=partition.NUM_PARTS
    ).loads,
    "imbalance_ratio": lambda t: metrics.imbalance(
        search.ivf_search(t.queries(), t.parts, t.centroids).loads
    ).select(F.round("imbalance", 6).alias("imbalance")),
    # partitions and routing
    "mean_centroids": lambda t: _elements(t.centroids, "c", "part"),
    "nearest_centroid": lambda t: partition.assign_nearest(t.base, t.centroids).select(
        "vec_id", "part"
    ),
    "centroid_scores": lambda t: search.centroid_scores(t.queries(), t.centroids),
    "probe_routing": lambda t: search.route(t.queries(), t.centroids, oracle.NPROBE),
    "routed_candidates": lambda t: search.routed_candidates(t.routes, t.parts).select(
        "q_id", "part", "probe", "candidates"
    ),
    "routed_topk": lambda t: _hits(search.routed_topk(t.queries(), t.parts, t.routes)),
    "ivf_search": lambda t: _hits(search.ivf_search(t.queries(), t.parts, t.centroids).hits),
    "ivf_scan_load": lambda t: search.ivf_search(t.queries(), t.parts, t.centroids).loads,
    "routing_load": lambda t: pruned.routing_load(t.routes, t.centroids),
    "kmeans_partitions": _kmeans,
    # dimension blocks and pruning
    "dim_blocks": _blocks_of,
    "block_scores": lambda t: _rounded(_explained(t), "score_"),
    "block_bounds": lambda t: _rounded(_explained(t), "bound_"),
    "suffix_bounds": lambda t: _rounded(suffix_bounds(_explained(t), oracle.BLOCKS), "suffix_"),
    "kth_threshold": lambda t: kth_threshold(
        search.local_topk(t.queries(), t.shards).drop("rk")
    ),
    "bound_filter": _bound_filter,
    "dim_search_exact": lambda t: _hits(_dim_exact(t).hits, False),
    "dim_search_compat": lambda t: _hits(_dim_compat(t).hits, False),
    "block_load": lambda t: _dim_exact(t).blocks().select("block", "load"),
    "block_pruned": lambda t: _dim_exact(t).blocks().select("block", "pruned"),
    "block_counts_compat": lambda t: _dim_compat(t).blocks(),
    # the full pipeline
    "prewarm_pooled": lambda t: t.spark.createDataFrame(
        [
            (
                pruned.prewarm_pooled(
                    t.queries(), t.base, n_q=oracle.WARM_QUERIES, n_v=oracle.SAMPLE_ROWS
                ),
            )
        ],
        "thr double",
    ),
    "prewarm_per_query": lambda t: pruned.prewarm_per_query(
        t.queries(), t.base, n_v=oracle.SAMPLE_ROWS
    ),
    "prewarm_routed": lambda t: t.routed_thr,
    "dim_pipeline": lambda t: _hits(_open_stage(t).hits),
    "dim_pipeline_thresholds": lambda t: _open_stage(t).thresholds,
    "vector_pipeline": lambda t: _hits(t.first_stage.hits),
    "vector_pipeline_counts": lambda t: t.first_stage.counts,
    "probe_carry": lambda t: pruned.carry_thresholds(
        t.routed_thr, t.first_stage.hits.drop("rk"), t.first_stage.thresholds
    ),
    "full_pipeline_exact": lambda t: _hits(_pipeline(t, "exact").hits),
    "full_pipeline_compat": lambda t: _hits(_pipeline(t, "compat").hits),
    "full_pipeline_groups": lambda t: _hits(_pipeline_groups(t).hits),
    "dim_search_groups": lambda t: _hits(_dim_groups(t).hits, False),
    "group_pairs": _group_pairs,
    "group_cover": _group_cover,
    "pipeline_counts_exact": lambda t: _pipeline(t, "exact").counts,
    "pipeline_counts_compat": lambda t: _pipeline(t, "compat").counts,
    "partition_compute_load": lambda t: _pipeline(t, "exact").partitions(t.centroids),
    # cleaning, vectors and workloads
    "label_norm": lambda t: clean.normalise_label(t.raw_events, "label").select(
        "event_id", "label"
    ),
    "drop_ids": lambda t: clean.drop_identifiers(t.lineitem, LINE_IDS),
    "numeric_only": lambda t: clean.numeric_only(clean.drop_identifiers(t.lineitem, LINE_IDS)),
    "nonfinite_null": lambda t: clean.nonfinite_to_null(t.raw_events, ["value"]).select(
        "event_id", "value"
    ),
    "complete_rows": lambda t: clean.clean_flows(t.raw_events, "label", (), ("event_id",)),
    "clean_flows": lambda t: t.flows.drop("flow_id"),
    "standardise": _standardise,
    "l2_normalise": _l2_normalise,
    "search_cast": _search_cast,
    "merge_by_name": lambda t: merge_by_name(
        [t.events.select("event_id", "value"), t.events.select("event_id", "event_type")]
    ),
    "stratified_split": _split_roles,
    "split_null_label": _split_null_label,
    "uniform_sample": lambda t: sampling.uniform_sample(t.events, "event_id").select("event_id"),
    "hot_cold": lambda t: t.events.select(
        "event_id", is_hot("event_type", oracle.HOT_EVENTS).alias("hot")
    ),
    "skewed_sample": _skewed_events,
    "workload_filter": lambda t: select_workload(t.workloads, "skewed").select(
        "q_id", "label", "workload"
    ),
    "pca_vectors": _pca_vectors,
    "flow_search": _flow_search,
    # sources and sinks
    "read_flows": _read_flows,
    "read_flows_quoted": _read_quoted,
    "label_export": _label_export,
    "load_workload": _load_workload,
    "vectorise_chain": _vectorise_chain,
    # metrics
    "latency_summary": _latency,
    "latency_nonfinite": _latency_nonfinite,
    "throughput": lambda t: metrics.throughput(t.events, "value").select(
        F.round("qps", 9).alias("qps")
    ),
    "preprocess_report": _preprocess_report,
    "run_report": _run_report,
}


def entry(spark: SparkSession) -> DataFrame:
    """Exact top-10 of every held-out vector among the stored ones."""
    return queries()["full_search"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(fixture(spark, sf_dir))

    own = {name: bind(run) for name, run in QUERIES.items()}
    return own | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | (llm.oracle_sql() if llm else {})
