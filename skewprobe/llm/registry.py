"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from skewprobe.llm import sql
from skewprobe.llm.audit import audit
from skewprobe.llm.chat import format_chats, read_chats, read_loss
from skewprobe.llm.collision_search import search
from skewprobe.llm.lines import dedup_lines
from skewprobe.llm.metric_join import vector_groups
from skewprobe.llm.mixing import mix
from skewprobe.llm.pages import main_text
from skewprobe.llm.phrases import collocations
from skewprobe.llm.pieces import decode_ids, encode_texts
from skewprobe.llm.simhash import simhash_ids
from skewprobe.llm.token_files import read_token_files, token_file_folder, write_token_files
from skewprobe.llm.toxicity import score_docs, train
from skewprobe.llm.urls import RULES, judge_urls
from skewprobe.session import ship, stage

URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
WEIGHTS = (5.0, 2.0, 1.0)
END_ID = 2
ODD_TURN = "</s>[INST] ok [/INST]"
CHATS = "conv_id long, turn long, role string, text string"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULES)
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_file_folder(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end=END_ID)
    read = read_token_files(spark.read.parquet(path), with_ids=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, labels.where(~held_out))
    scored = score_docs(docs, model, score="score")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_ids(docs, words=3)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = [(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(turns.unionByName(spark.createDataFrame(odd, CHATS)))
    read = chats.withColumn("turns", read_chats(F.col("formatted")))
    read = read.withColumn("learn", read_loss(F.col("formatted"), F.col("loss")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learn").cast("long").alias("loss_chars"),
        F.sha2("learn", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2("text", 256).alias("kept_sha256")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)


def op8_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    # Written in between, as a training set would be: ids and a digest of what they stand for.
    encoded = encode_texts(docs, model).select("doc_id", "ids", F.sha2("text", 256).alias("digest"))
    encoded = stage(encoded, "sampled-pieces")
    back = F.sha2(decode_ids(F.col("ids"), model), 256)
    decoded = encoded.withColumn("lossless", back.eqNullSafe(F.col("digest")))
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        "lossless",
    )


def op10_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # The stated query set: every row whose id is divisible by 100.
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_vector_groups": op8_vector_groups,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_collision_search": op10_collision_search,
    "op11_phrases": op11_phrases,
    "op12_filter_audit": op12_filter_audit,
    "op13_main_text": op13_main_text,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, str(sf_dir))

        return call

    return {name: shipped(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLE
