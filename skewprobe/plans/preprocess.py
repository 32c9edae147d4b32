"""From a tree of flow CSVs to written vector sets and workloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from skewprobe.functions.keys import HOT_PATTERNS, SEED
from skewprobe.functions.vectors import search_cast
from skewprobe.operators.clean import IDENTIFIERS, LABEL, clean_flows, numeric_columns
from skewprobe.operators.features import PCA_DIMS, vectorise
from skewprobe.operators.metrics import preprocess_report
from skewprobe.operators.sampling import (
    QUERY_FRACTION,
    SKEW_RATIO,
    WORKLOAD_SIZE,
    skewed_sample,
    split_roles,
    uniform_sample,
)
from skewprobe.sources.flows import FILE, PIECE, number_records, quoted, read_flows
from skewprobe.sources.sets import (
    load_vectors,
    select_workload,
    write_clean,
    write_vectors,
    write_workloads,
)


def vectors_of(
    clean: DataFrame, id: str, label: str = LABEL, dims: int = PCA_DIMS
) -> tuple[DataFrame, PipelineModel]:
    """``vec_id, embedding, label`` of a clean table; every numeric column is a feature.

    The model is fitted on all rows, before any split. ``clean`` should be a
    written table: it is read several times, and its ids must not change.
    """
    table, model = vectorise(clean, numeric_columns(clean, (id, label)), dims)
    vectors = table.select(quoted(id).alias("vec_id"), "embedding", quoted(label).alias("label"))
    return search_cast(vectors, "embedding"), model


def write_search_inputs(
    vectors: DataFrame,
    out: str,
    fraction: float = QUERY_FRACTION,
    size: int = WORKLOAD_SIZE,
    ratio: float = SKEW_RATIO,
    patterns: Sequence[str] = HOT_PATTERNS,
    seed: int = SEED,
    rows_per_file: int = 0,
) -> None:
    """Split, write, sample the written query set, write both workloads.

    The vectors are computed in one pass, which writes both roles.
    """
    write_vectors(out, split_roles(vectors, "vec_id", "label", fraction, seed), rows_per_file)
    _, query = load_vectors(vectors.sparkSession, out)
    uniform = uniform_sample(query, "vec_id", size, seed)
    skewed = skewed_sample(query, "vec_id", "label", size, ratio, patterns, seed)
    write_workloads(out, uniform, skewed)


def preprocess(
    spark: SparkSession,
    raw: str,
    out: str,
    label: str = LABEL,
    drop: Sequence[str] = IDENTIFIERS,
    dims: int = PCA_DIMS,
    **options,
) -> DataFrame:
    """Read, clean, vectorise, split, sample and write; returns the report.

    Row ids number the clean rows by file and place in it, so a rerun gives the same ids, splits and
    workloads, however files are split and tasks are made. ``options`` are those of :func:`write_search_inputs`.
    """
    flows = read_flows(spark, raw, places=True)
    clean = clean_flows(flows, label, drop, (FILE, PIECE))
    rows_per_file = options.get("rows_per_file", 0)
    write_clean(number_records(clean), f"{out}/clean", rows_per_file)
    clean = spark.read.parquet(f"{out}/clean")
    vectors, _ = vectors_of(clean, "flow_id", label, dims)
    write_search_inputs(vectors, out, **options)
    base, query = load_vectors(spark, out)
    workloads = spark.read.parquet(f"{out}/workloads")
    uniform, skewed = (select_workload(workloads, w) for w in ("uniform", "skewed"))
    return preprocess_report(clean, base, query, uniform, skewed, len(flows.inputFiles()))
