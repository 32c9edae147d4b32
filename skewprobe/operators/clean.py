"""Cleaning flow tables: one projection and one filter, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewprobe.sources.flows import quoted

# The label column and the identifier columns of a flow table.
LABEL = "Label"
IDENTIFIERS = (
    "Flow ID", "Src IP", "Dst IP", "Source IP", "Destination IP", "Timestamp",
)


def require_label(df: DataFrame, label: str = LABEL) -> None:
    if label not in df.columns:
        raise KeyError(f"expected a {label!r} column")


def normalise_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Trimmed text; a missing label becomes the text ``nan`` and its row stays."""
    text = F.trim(quoted(label).cast("string"))
    return df.withColumn(label, F.coalesce(text, F.lit("nan")))


def drop_identifiers(df: DataFrame, drop: Sequence[str] = IDENTIFIERS) -> DataFrame:
    return df.drop(*drop)


def numeric_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in keep
    ]


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of a numeric type, and those named in ``keep``."""
    features = set(numeric_columns(df, keep))
    return df.select(*[quoted(n) for n in df.columns if n in features or n in keep])


def nonfinite_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NaN and both infinities by null."""
    finite = {
        f.name: F.when(F.abs(quoted(f.name)) < F.lit(float("inf")), quoted(f.name))
        for f in df.schema.fields
        if f.name in set(cols) and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(*[finite.get(n, quoted(n)).alias(n) for n in df.columns])


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that have a value in every one of ``cols``."""
    return df.dropna(how="any", subset=["`" + c.replace("`", "``") + "`" for c in cols])


def clean_flows(
    df: DataFrame,
    label: str = LABEL,
    drop: Sequence[str] = IDENTIFIERS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Finite numeric features and a text label.

    ``carry`` names columns, such as a row id, that pass through without being
    features and without taking part in the completeness check.
    """
    require_label(df, label)
    keep = [label, *carry]
    table = drop_identifiers(normalise_label(df, label), [d for d in drop if d not in keep])
    table = numeric_only(table, keep)
    features = numeric_columns(table, keep)
    return complete_rows(nonfinite_to_null(table, features), features)
