"""Writing and reading vector sets, workloads and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewprobe.functions.vectors import search_cast
from skewprobe.operators.groups import assign_groups, fit_groups, summarise
from skewprobe.operators.sampling import sample_per_group
from skewprobe.session import stage

# The names of the query workloads.
WORKLOADS = ("uniform", "skewed")


def write_clean(clean: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Finite features and label as parquet."""
    clean.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def export_labels(df: DataFrame, path: str, label: str = "label", id: str | None = None) -> None:
    """Labels as CSV with a header; rows have no position, so ``id`` can name them."""
    cols = [label] if id is None else [id, label]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def _workload(queries: DataFrame, name: str) -> DataFrame:
    return queries.select(
        F.col("vec_id").alias("q_id"),
        "vec_id",
        F.col("embedding").cast("array<float>").alias("qv"),
        "label",
        F.lit(name).alias("workload"),
    )


def workload_table(uniform: DataFrame, skewed: DataFrame) -> DataFrame:
    """Both workloads as ``q_id, vec_id, qv, label, workload``; ``q_id`` is the id of the query row."""
    return _workload(uniform, "uniform").unionByName(_workload(skewed, "skewed"))


def write_vectors(path: str, roles: DataFrame, rows_per_file: int = 0) -> None:
    """Base and query vectors in one pass, in a folder per ``role``, and their labels.

    ``rows_per_file`` cuts large output files without a shuffle: a search costs
    far more per byte than a scan, so its tasks may be smaller.
    """
    vectors = search_cast(roles.select("vec_id", "embedding", "label", "role"), "embedding")
    writer = vectors.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("role").parquet(f"{path}/vectors")
    base, query = load_vectors(roles.sparkSession, path)
    export_labels(base, f"{path}/base_labels")
    export_labels(query, f"{path}/query_labels")


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The base and the query vectors; each reads its own folder only."""
    vectors = spark.read.parquet(f"{path}/vectors")
    base, query = (vectors.where(F.col("role") == r).drop("role") for r in ("base", "query"))
    return base, query


def write_workloads(path: str, uniform: DataFrame, skewed: DataFrame) -> None:
    table = workload_table(uniform, skewed)
    table.write.mode("overwrite").partitionBy("workload").parquet(f"{path}/workloads")


def write_sets(
    path: str,
    base: DataFrame,
    query: DataFrame,
    uniform: DataFrame,
    skewed: DataFrame,
    rows_per_file: int = 0,
) -> None:
    """Base and query vectors, both workloads and the label exports below ``path``."""
    columns = ["vec_id", "embedding", "label"]
    roles = [
        table.select(*columns, F.lit(role).alias("role"))
        for table, role in ((base, "base"), (query, "query"))
    ]
    write_vectors(path, roles[0].unionByName(roles[1]), rows_per_file)
    write_workloads(path, uniform, skewed)


def select_workload(table: DataFrame, query_set: str) -> DataFrame:
    if query_set not in WORKLOADS:
        raise ValueError(f"query_set must be one of {', '.join(WORKLOADS)}")
    return table.where(F.col("workload") == query_set)


def load_workload(
    spark: SparkSession, path: str, query_set: str = "uniform"
) -> tuple[DataFrame, DataFrame]:
    """The base vectors and one workload; only that workload's files are read."""
    queries = select_workload(spark.read.parquet(f"{path}/workloads"), query_set)
    base, _ = load_vectors(spark, path)
    return search_cast(base, "embedding"), search_cast(queries, "qv")


def write_index(
    path: str, base: DataFrame, centroids: DataFrame, warmup_rows: int = 0, groups: int = 0
) -> None:
    """The base laid out by ``part``, its centroids, and what pruned searches start from.

    The rebalance hint lets the adaptive planner split a hot partition over
    several files and merge small ones, so files stay even under skew. A search
    that visits few partitions then reads only their folders. The warm-up rows,
    ``warmup_rows`` per partition, take one more pass here and save one in every
    pruned search. With ``groups``, up to so many groups of alike rows in each partition have
    folders and a summary of their own, see :mod:`skewprobe.operators.groups`.
    """
    folders = ["part"]
    if groups:
        pivots = stage(fit_groups(base, groups), "pivots")
        base = assign_groups(base, pivots, groups)
        folders.append("cell")
    base.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(
        f"{path}/parts"
    )
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    parts, _ = load_index(base.sparkSession, path)
    if groups:
        summarise(parts, pivots).write.mode("overwrite").parquet(f"{path}/groups")
    if warmup_rows:
        sample = sample_per_group(parts, "part", "vec_id", warmup_rows)
        sample.write.mode("overwrite").parquet(f"{path}/warmup")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/parts"), spark.read.parquet(f"{path}/centroids")


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """The group summaries of an index written with ``groups``."""
    return spark.read.parquet(f"{path}/groups")


def load_warmup(spark: SparkSession, path: str) -> DataFrame:
    """The ``sample`` of a pruned search over this index."""
    return spark.read.parquet(f"{path}/warmup")
