"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ASCII white space that separates words.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` put in, over any column of the same name in any case."""
    names = {name.lower() for name in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])
