"""Dropping lines that many documents share.

Lines are exploded and normalised, each key is hashed to 128 bits, and the
documents of each hash are counted. Lines whose hash reaches the threshold are
dropped, and the others put together again by position.

The exploded table holds digests only. The hashes to drop come back to the
documents by the digest of the text, so copies of a text share one list, and
the texts cross the network once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.common import replaced
from skewprobe.session import stage

MIN_DOCS = 10
MIN_CHARS = 1
STRIP = b" \t\n\x0b\x0c\r"
KEYS = "doc string, a long, b long"
RESULT = "text string, n_lines long, n_dropped long"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(STRIP).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, distinct: bool = False
) -> DataFrame:
    """``docs`` with the common lines taken out of ``text``; adds ``n_lines`` and ``n_dropped``.

    A line ends at a line feed. Lines whose key has at least ``min_chars`` code
    points and is found in at least ``min_docs`` documents are dropped in every document, whichever
    way they were written. Kept lines are joined by line feeds, as they were.

    A null or empty text is one empty line. A text of which nothing is left
    becomes empty, and a null text too. Every row is a document: a repeated row
    counts again, also under the same id. With ``distinct`` equal texts count as one document, so that a text
    with many copies keeps its lines. No id is read, so null ids do no harm. Columns named like
    the result are replaced. An empty table gives an empty one.
    """
    doc = F.md5(F.coalesce("text", F.lit("")))
    least = min_chars

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            texts, names = batch.column("text"), batch.column("doc").to_pylist()
            for name, text in zip(names, texts.cast(pa.binary()).to_pylist(), strict=True):
                keys = {line_key(line) for line in (text or b"").split(b"\n")}
                digests = [xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, least)]
                owners += [name] * len(digests)
                found += digests
            pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.string()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=["doc", "a", "b"],
            )

    keys = stage(docs.select(doc.alias("doc"), "text").mapInArrow(explode, KEYS), "line-keys")
    met = keys.distinct() if distinct else keys
    counts = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    common = stage(counts.where(F.col("n") >= min_docs).select("a", "b"), "common-lines")
    # A set per text: what copies of a text repeat is combined before it is sent.
    drops = (
        keys.join(common, ["a", "b"])
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set(F.struct("a", "b")).alias("__drop"))
    )
    drops = stage(drops, "lines-to-drop")

    @pandas_udf(RESULT)
    def rebuild(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        rows = [_rebuild(t, d, least) for t, d in zip(texts, drop, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    rows = docs.withColumn("__key", doc)
    joined = rows.join(drops, F.col("__key") == F.col("__doc"), "left")
    lists = F.transform("__drop", lambda s: F.array(s["a"], s["b"]))
    joined = joined.withColumn("__out", rebuild(F.col("text"), F.flatten(lists)))
    out = replaced(
        joined, {c: F.col(f"__out.{c}") for c in ("text", "n_lines", "n_dropped")}
    )
    return out.drop("__out", "__key", "__doc", "__drop").select(
        *[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"
    )


def _rebuild(text: str | None, drop: np.ndarray | None, least: int) -> tuple[str, int, int]:
    lines = (text or "").encode().split(b"\n")
    if drop is None or not len(drop):
        return text or "", len(lines), 0
    gone = {bytes(d) for d in np.asarray(drop, "<i8").reshape(-1, 2).view("V16").ravel()}
    kept = []
    for line in lines:
        key = line_key(line)
        if not (_long_enough(key, least) and xxhash.xxh3_128_digest(key) in gone):
            kept.append(line)
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)
