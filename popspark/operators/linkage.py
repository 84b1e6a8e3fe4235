"""Linkage disequilibrium; correlations of all sites are in bitmaps, relatedness in tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moments(genotypes: DataFrame, n_ind: DataFrame) -> DataFrame:
    """position, mean and sd (over all individuals, absent rows are 0) of sites whose dosage varies. n_ind is a table of one row."""
    sums = genotypes.groupBy("position").agg(F.sum("g").alias("s1"), F.sum(F.col("g") * F.col("g")).alias("s2")).crossJoin(F.broadcast(n_ind))
    n = F.col("n_ind")
    out = sums.withColumn("mean", F.col("s1") / n).withColumn("sd", F.sqrt(F.greatest(F.col("s2") / n - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return out.filter("sd > 1e-12").select("position", "mean", "sd", "n_ind")


def pairs(genotypes: DataFrame, n_ind: DataFrame, first: int = 100, ahead: int = 20, reach: int = 10_000) -> DataFrame:
    """r2 of dosages for each of the first sites and the next ones within reach; sites without variance are skipped.

    Products are summed by pair of sites over carriers only, as absent rows add nothing.
    """
    sites = genotypes.select("position").distinct().orderBy("position").limit(first + ahead)
    sites = sites.withColumn("i", F.row_number().over(Window.orderBy("position"))).join(moments(genotypes, n_ind), "position", "left").filter("sd is not null")
    sites = F.broadcast(sites)  # first + ahead rows
    near = genotypes.join(sites, "position")
    a = near.select("ind_id", *[F.col(c).alias(f"{c}_a") for c in ("position", "i", "g", "mean", "sd")], "n_ind").filter(F.col("i_a") <= first)
    b = near.select("ind_id", *[F.col(c).alias(f"{c}_b") for c in ("position", "i", "g", "mean", "sd")])
    met = a.join(b, "ind_id").filter((F.col("i_b") > F.col("i_a")) & (F.col("i_b") <= F.col("i_a") + ahead))
    sums = met.groupBy(F.col("i_a"), F.col("i_b")).agg(F.sum(F.col("g_a") * F.col("g_b")).alias("s"))
    ends = lambda x: sites.select(*[F.col(c).alias(f"{c}_{x}") for c in ("position", "i", "mean", "sd")], *(["n_ind"] if x == "a" else []))
    grid = ends("a").filter(F.col("i_a") <= first).join(ends("b"), (F.col("i_b") > F.col("i_a")) & (F.col("i_b") <= F.col("i_a") + ahead) & (F.col("position_b") - F.col("position_a") <= reach))
    both = grid.join(sums, ["i_a", "i_b"], "left")
    r = (F.coalesce("s", F.lit(0)) / F.col("n_ind") - F.col("mean_a") * F.col("mean_b")) / (F.col("sd_a") * F.col("sd_b"))
    return both.select(F.col("position_a").alias("pos_i"), F.col("position_b").alias("pos_j"), (r * r).alias("r2"))
