"""What the operators of this folder share: tables, joins on skewed keys, written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: a blank and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: A word, as a pattern for Java and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

#: At most so many groups count as hot, so a broadcast of one row for each is bounded.
HOT_GROUPS = 10_000
#: A group of fewer rows is never hot.
HOT_ROWS = 100
#: A table of keys is broadcast up to so many rows (some tens of MB); beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Copies of a row that one task makes.
COPIES = 65_536
#: Rows that a Python task gets at once; texts may be long.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and keep batches of texts to Python tasks small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # unless it was set
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_popspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp()) / "popspark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.glob("popspark/**/*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._popspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from spark.checkpoint.dir. Only a local session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc = spark.sparkContext
    if not hasattr(sc, "_popspark_shared"):
        sc._popspark_shared = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    return sc._popspark_shared


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, kept when executors are lost, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe(*cols: Column) -> list[Column]:
    """Columns that group as the given ones do but hold no null: a string with a mark in front."""
    return [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string"))) for c in cols]


def join_groups(left: DataFrame, groups: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows to one row for each group, where one group may hold a third of all rows.

    groups is unique by key; n names its count of rows of left, and total is the sum of these counts. Hot groups,
    total / HOT_GROUPS rows or more, are at most HOT_GROUPS and go out as a broadcast; the others are shuffled,
    and none of them is large.
    """
    floor = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col(n) >= floor))
    cold = left.join(F.broadcast(groups.filter(F.col(n) >= floor).select(*key)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(groups.filter(F.col(n) < floor), key))


def without(rows: DataFrame, dropped: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows whose key isn't in dropped; dropped goes out as a broadcast up to limit rows, beyond it is shuffled."""
    few = dropped.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those of least hash of key; only about as many rows as are asked for are ordered."""
    total = rows.count()
    mark = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    share = min(1.0, (1.1 * most + 100) / max(total, 1))
    return rows.filter(mark <= int(share * (1 << 30))).orderBy(mark, key).limit(most)


def copied(rows: DataFrame, n: str, most: int, name: str = "copy") -> DataFrame:
    """Each row n times, numbered from 0 in the column name. most is the greatest n; a row of many copies is dealt out to tasks."""
    first, step = F.lit(0).cast("long"), F.lit(COPIES).cast("long")
    if most > COPIES:
        rows = rows.withColumn("first_copy", F.explode(F.sequence(first, F.col(n) - 1, step))).repartition(partitions(rows.sparkSession))
        first = F.col("first_copy")
    return rows.withColumn(name, F.explode(F.sequence(first, F.least(first + step, F.col(n)) - 1)))
