"""Reading network-flow CSV trees whose files need not share a header."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewprobe.session import stage

# Where a record was read: its file, and the place in it at which the piece of the file begins
# that was read with it.
FILE, PIECE = "__file", "__piece"
# Cell texts that mean "missing" in a flow file.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def quoted(name: str) -> Column:
    """A column by its exact name; flow headers hold spaces, dots and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def unique_names(header: Iterable[str]) -> list[str]:
    """Trimmed names; a repeated name gets the suffix ``.1``, ``.2`` and so on."""
    seen: dict[str, int] = {}
    names = []
    for raw in header:
        name = raw.strip()
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def merge_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames, matching columns by name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_files(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """Each ``*.csv`` below ``path`` with its header line, and whether a quoted cell of it holds a line break.

    One distributed aggregate over the lines of all files, which are split like any text. A line
    break lies inside quotes only after a line with an odd number of them.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    try:
        lines = files.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no CSV files below {path}") from missing
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Within a task the ids follow the lines; a file begins in one task.
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"), "value", place.alias("place"), (quotes % 2).alias("odd")
    )
    found = rows.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.max("odd").alias("odd"))
    # The path comes as a URL.
    table = [(unquote(r["file"]), r["header"], r["odd"] == 1) for r in found.collect()]
    if not table:
        raise FileNotFoundError(f"no CSV files below {path}")
    return sorted(table)


def _header(path: str, line: str) -> tuple[str, ...]:
    cells = tuple(next(csv.reader([line.lstrip("\ufeff")]), ()))
    if not cells:
        raise ValueError(f"no header line in {path}")
    return cells


def _is_text(value: Column) -> Column:
    # Java also takes a trailing d or f as part of a number; a flow file does not.
    number = value.try_cast("double").isNotNull() & ~value.rlike(r"[0-9.][dDfF]\s*$")
    return value.isNotNull() & ~number


def _literal(path: str) -> str:
    """A path in which no character has a meaning for pattern matching."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _read_files(
    spark: SparkSession, files: list[str], header: tuple[str, ...], multiline: bool, places: bool
) -> DataFrame:
    """Files of one header as text columns; a row with more cells than the header is an error."""
    names = unique_names(header)
    broken = "__broken"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
    # A reader that takes only some of the columns does not see that there are too many.
    reader = spark.read.schema(schema).options(
        header=True, multiLine=multiline, columnNameOfCorruptRecord=broken, escape='"',
        columnPruning=False,
    )
    raw = reader.csv([_literal(f) for f in files])
    # The reader also marks short rows, which are filled with nulls. It must be asked for a
    # column of the file besides the mark, so a condition that always holds names one.
    cells = F.size(F.split(F.regexp_replace(broken, '"[^"]*"', ""), ","))
    asked = F.coalesce(F.length(quoted(names[0])), F.lit(0)) >= 0
    over = F.col(broken).isNotNull() & (cells > len(names)) & asked
    refusal = F.raise_error(F.concat(F.lit("row with more cells than its header: "), broken))
    where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(PIECE)]
    raw = raw.select("*", *(where if places else []))
    checked = raw.where(F.when(over, refusal.cast("boolean")).otherwise(True))
    cells = [F.when(~quoted(n).isin(*MISSING), quoted(n)).alias(n) for n in names]
    return checked.select(*cells, *([FILE, PIECE] if places else []))


def read_flows(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] | None = None,
    multiline: bool | None = None,
    places: bool = False,
) -> DataFrame:
    """All ``*.csv`` below ``path`` as one table, columns matched by trimmed name.

    A file is read with its own header: one reader over files whose headers
    differ would put values under the wrong names. Files are grouped by header,
    so the plan has one scan per distinct header, not per file. One pass over the lines finds all headers.

    A column becomes double when every value present in every file is a number,
    which takes one extra pass; name the ``numeric`` columns to save it.

    A row with more cells than its header is an error, one with fewer is filled
    with nulls. Quoted cells may hold line breaks: the same pass tells which files have such, and only those are
    read in one task each, all others are split. ``multiline`` decides for all of them instead. Files
    whose name starts with ``_`` or ``.`` are hidden, as everywhere in Spark, and so are empty ones.

    With ``places`` there are two more columns, from which :func:`number_records` makes ids.
    """
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file, line, breaks in scan_files(spark, path):
        whole = breaks if multiline is None else multiline
        groups.setdefault((_header(file, line), whole), []).append(file)

    frames = [_read_files(spark, files, header, whole, places) for (header, whole), files in groups.items()]
    merged = merge_by_name(frames)
    names = [n for n in merged.columns if n not in (FILE, PIECE)]

    if numeric is None:
        is_text = merged.agg(
            *[F.coalesce(F.bool_or(_is_text(quoted(n))), F.lit(False)).alias(n) for n in names]
        ).first()
        numeric = [n for n, text in zip(names, is_text) if not text]
    chosen = set(numeric)
    return merged.select(
        *[quoted(n).try_cast("double").alias(n) if n in chosen else quoted(n).alias(n) for n in names],
        *([FILE, PIECE] if places else []),
    )


def number_records(records: DataFrame, name: str = "flow_id") -> DataFrame:
    """``records``, written, with ``name``: their numbers from 0 in the order of file and place in it.

    ``records`` come from :func:`read_flows` with ``places`` and may have been filtered, not shuffled. The numbers
    do not depend on how files were split or dealt out to tasks. A piece of a file is read in a row by one
    task, so only one row for each piece is needed to place it.
    """
    rows = stage(records.withColumn("__row", F.monotonically_increasing_id()), "records")
    pieces = stage(
        rows.groupBy(FILE, PIECE).agg(F.count("*").alias("__n"), F.min("__row").alias("__from")), "pieces"
    )
    # Files first, then the pieces of each: a window holds one row for a file, or for a piece of one.
    files = pieces.groupBy(FILE).agg(F.sum("__n").alias("__n"))
    earlier = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(FILE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__files"))
    inner = Window.partitionBy(FILE).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(inner), F.lit(0)).alias("__pieces")
    starts = pieces.select(FILE, PIECE, "__from", before).join(files, FILE)
    starts = starts.select(FILE, PIECE, (F.col("__files") + F.col("__pieces") - F.col("__from")).alias("__shift"))
    numbered = rows.join(stage(starts, "starts"), [FILE, PIECE])
    return numbered.withColumn(name, F.col("__row") + F.col("__shift")).drop(FILE, PIECE, "__row", "__shift")
