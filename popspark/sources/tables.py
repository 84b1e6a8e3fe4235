"""Genotype tables in long sparse form, derived from the star-schema tables by a fixed rule.

A supplier is a haplotype, two neighbours are an individual, a part is a site, and a line item whose quantity is small
for its part makes the supplier carry the derived allele there. Only carriers are rows: allele 1 is implied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hap_id and ind_id of every haplotype, also of those that carry nothing."""
    key = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select((key + 1).alias("hap_id"), F.floor((key + 2) / 2).cast("long").alias("ind_id"))


def carriers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """hap_id, position and further line-item columns, as they are, of every carrier."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") <= 1 + F.col("l_partkey") % 50)
    return rows.select((F.col("l_suppkey").cast("long") + 1).alias("hap_id"), (F.col("l_partkey").cast("long") + 1).alias("position"), *more).distinct()


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals (id, s, e), several for each id, some of them overlapping."""
    start = F.col("l_partkey").cast("long") * 10 + 1
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    return rows.select(F.col("l_suppkey").cast("long").alias("id"), start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e")).distinct()
