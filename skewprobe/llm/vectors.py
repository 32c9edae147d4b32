"""Vectors as bytes, for the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewprobe.session import stage


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def rows_of(cells: pd.Series) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    if not len(cells):
        return np.zeros((0, 0))
    return np.stack(cells.to_list()).astype(np.float64)


def unit_rows(cells: pd.Series) -> np.ndarray:
    rows = rows_of(cells)
    if not rows.size:
        return rows
    # Scaled first, so that neither very large nor very small components are lost in the squares.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def same_length(df: DataFrame, vector: str) -> DataFrame:
    """``df`` if all its usable vectors have one length, else an error."""
    sizes = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of different lengths: {sizes['a']} and {sizes['b']}")
    return df


def staged_vectors(df: DataFrame, vec_id: str, vector: str, name: str) -> DataFrame:
    """Usable rows as ``id, v``, written once; float components stay floats, others are doubles."""
    kind = df.schema[vector].dataType.simpleString()
    kind = "array<float>" if kind == "array<float>" else "array<double>"
    rows = df.where(usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")
    )
    return same_length(stage(rows, name), "v")
