"""A pipeline from documents to sampled piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the documents of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewprobe.llm.lines import dedup_lines
from skewprobe.llm.mixing import mix
from skewprobe.llm.pieces import encode_texts
from skewprobe.llm.simhash import keep_one
from skewprobe.llm.toxicity import score_docs, train
from skewprobe.session import ship, stage

TOXIC = 0.5
MIN_DOCS = 10
# Shingles of the near-duplicate stage, in words, and the differing bits up to which fingerprints link.
WORDS = 3
DISTANCE = 3
WEIGHTS = (5.0, 2.0, 1.0)
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below :data:`TOXIC`; the machine is trained on the labelled ones."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_docs(docs, train(docs, labels), score="__toxic")
    return scored.where(F.col("__toxic") < TOXIC).drop("__toxic")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of many different texts; ``n_chars`` follows the text.

    Copies count as one document here: they are for the next stage, which needs what they share.
    """
    ship(spark)
    kept = dedup_lines(docs, MIN_DOCS, distinct=True).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: linked fingerprints."""
    ship(spark)
    return keep_one(docs, WORDS, DISTANCE).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times."""
    ship(spark)
    mixed = mix(docs, WEIGHTS)
    times = F.sequence(F.lit(1), F.col("copies"))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(times)).select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document."""
    ship(spark)
    return encode_texts(docs, MODEL).select(*docs.columns, "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("segmentation", segmentation),
]

# A trained machine and sampled segmentations cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
