"""From numeric columns to unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewprobe.sources.flows import quoted

# Fixed value: most dimensions kept by the projection.
PCA_DIMS = 64


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit population variance per column; a constant column becomes 0.

    One aggregate gives two numbers per column, which enter the projection as
    literals: the table itself is never shuffled.
    """
    stats = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    scaled = {}
    for i, c in enumerate(cols):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        # The second test catches a constant whose mean is off by rounding only.
        if not dev or dev <= 1e-14 * abs(mean):
            dev = 1.0
            mean = mean if mean is not None else 0.0
        scaled[c] = (quoted(c).cast("double") - F.lit(mean)) / F.lit(dev)
    return df.select(*[scaled.get(n, quoted(n)).alias(n) for n in df.columns])


def l2_normalise(df: DataFrame, col: str) -> DataFrame:
    """Scale an array column to unit length; a zero vector stays as it is."""
    temp = "__vector", "__unit"
    table = df.withColumn(temp[0], array_to_vector(F.col(col).cast("array<double>")))
    table = Normalizer(p=2.0, inputCol=temp[0], outputCol=temp[1]).transform(table)
    return table.withColumn(col, vector_to_array(temp[1])).drop(*temp)


def vectorise(
    df: DataFrame,
    cols: Sequence[str],
    dims: int = PCA_DIMS,
    output: str = "embedding",
    model: PipelineModel | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """Standardise, project on ``min(dims, features)`` components, scale to unit length.

    Fitting takes one pass for the scaler and one for the covariance, both
    reduced in the executors; only a features x features matrix reaches the
    driver. Scaling by the sample deviation differs from the population form by
    one common factor, which the last step removes.
    """
    # Feature names may hold dots, which the assembler cannot address.
    inputs = [f"__f{i}" for i in range(len(cols))]
    table = df.withColumns(
        {alias: quoted(c).cast("double") for alias, c in zip(inputs, cols)}
    )
    if model is None:
        model = Pipeline(
            stages=[
                VectorAssembler(inputCols=inputs, outputCol="__raw"),
                StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__scaled"),
                PCA(k=min(dims, len(cols)), inputCol="__scaled", outputCol="__projected"),
                Normalizer(p=2.0, inputCol="__projected", outputCol="__unit"),
            ]
        ).fit(table)
    out = model.transform(table).withColumn(output, vector_to_array("__unit"))
    return out.drop("__raw", "__scaled", "__projected", "__unit", *inputs), model
