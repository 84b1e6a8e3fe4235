"""Intermediate tables in the folder that the driver and all executors share, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A table of keys is broadcast up to so many rows (some tens of MB); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, kept when executors are lost, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_popspark_core_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "popspark_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.glob("popspark/**/*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._popspark_core_shipped = True
