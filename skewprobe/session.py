"""Settings taken from the session: the shared folder and the broadcast bound."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Most bytes this library puts into one broadcast. Larger inputs are cut into
# blocks of at most this size; override with the session setting of that name.
BROADCAST_SETTING = "skewprobe.broadcast.bytes"
BROADCAST_BYTES = 64 * 1024 * 1024

# Most bytes of best rows a search task holds before it hands them on.
STATE_SETTING = "skewprobe.state.bytes"
STATE_BYTES = 256 * 1024 * 1024

# Most bytes of rows that Spark hands to a Python worker at once, unless the session sets it. Spark's own
# bound is 64 MB, which the executor and its worker hold several times over in every task.
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 * 1024 * 1024


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))


def state_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(STATE_SETTING, str(STATE_BYTES)))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made only for a local session without that setting:
    on a cluster the executors could not see each other's local files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    path = tempfile.mkdtemp(prefix="skewprobe-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage so that a lost executor costs at most the running job, and
    gives Catalyst the true size, so that small tables are broadcast on evidence.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skewprobe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=None)
def ship(spark: SparkSession) -> None:
    """Send the package to the executors and bound what their workers get at once; once per session."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="skewprobe-zip-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
