"""Population statistics on allele counts. What groups the rows (a scenario, a replicate) can be given as by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.operators.numbering import numbered


def harmonic(n: Column, power: int = 1) -> Column:
    """1 + 1/2^power + ... + 1/n^power; 0 for n < 1."""
    terms = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, i: a + 1 / F.pow(i.cast("double"), F.lit(float(power))))


def frequencies(counts: DataFrame, n_hap: DataFrame) -> DataFrame:
    """counts with p, the derived frequency; n_hap is a table of one row."""
    return counts.crossJoin(F.broadcast(n_hap)).withColumn("p", F.col("ac") / F.col("n_hap"))


def population(freqs: DataFrame, by: list[str] | None = None, length: int | None = None) -> DataFrame:
    """Sites, common variants, mean frequency, diversity, density and Watterson's theta for each group.

    Diversity, density and theta are over the span from the first to the last site, or over length if it is given.
    """
    by = by or []
    p = F.col("p")
    span = F.lit(float(length)) if length else (F.max("position") - F.min("position") + 1).cast("double")
    sums = freqs.groupBy(*by).agg(
        F.count("*").alias("n_sites"), F.count_if(F.least(p, 1 - p) > 0.05).alias("n_common"), F.avg("p").alias("mean_af"),
        F.sum(2 * p * (1 - p)).alias("pi_sum"), span.alias("span"), F.first("n_hap").alias("n_hap"),
    )
    n = F.col("n_sites").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        *by, "n_sites", "n_common", zero(F.col("mean_af")).alias("mean_af"), zero(F.try_divide("pi_sum", "span")).alias("pi"),
        zero(F.try_divide(n, F.col("span"))).alias("density"), F.col("n_sites").alias("segregating"), zero(F.try_divide(n / harmonic(F.col("n_hap") - 1), F.col("span"))).alias("theta_w"),
    )


def spectrum(counts: DataFrame, n_hap: DataFrame) -> DataFrame:
    """derived and n_sites for every derived count from 0 to the number of haplotypes."""
    bins = n_hap.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_hap"))).alias("derived"))
    found = counts.groupBy(F.col("ac").alias("derived")).agg(F.count("*").alias("n"))
    return bins.join(found, "derived", "left").select("derived", F.coalesce("n", F.lit(0)).cast("long").alias("n_sites"))


def tajimas_d(freqs: DataFrame) -> DataFrame:
    """Tajima's D in two forms. tajimas_d compares diversity a site to 1/a1; tajimas_d_standard is that of 1989.

    Both are 0 without sites and where the variance isn't positive.
    """
    p, s, n = F.col("p"), F.col("s"), F.col("n_hap").cast("double")
    one = freqs.agg(F.count("*").cast("double").alias("s"), F.sum(2 * p * (1 - p)).alias("pi"), F.first("n_hap").alias("n_hap"))
    one = one.withColumns({"a1": harmonic(F.col("n_hap") - 1), "a2": harmonic(F.col("n_hap") - 1, 2)})
    a1, a2 = F.col("a1"), F.col("a2")
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    one = one.withColumn("var", c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1))
    fits = (s > 0) & (F.col("var") > 0)
    per_site = F.when(fits, (F.col("pi") / s - 1 / a1) / F.sqrt("var")).otherwise(0.0)
    textbook = F.when(fits, (F.col("pi") * n / (n - 1) - s / a1) / F.sqrt("var")).otherwise(0.0)
    return one.select(per_site.alias("tajimas_d"), textbook.alias("tajimas_d_standard"))


def classes(counts: DataFrame) -> DataFrame:
    """Sites by derived count: singletons, doubletons, rare (1-20), low (21-100), common (over 100), and their ratio."""
    ac, count = F.col("ac"), F.count_if
    sums = counts.agg(count(ac == 1).alias("singletons"), count(ac == 2).alias("doubletons"), count(ac.between(1, 20)).alias("rare"), count(ac.between(21, 100)).alias("low"), count(ac > 100).alias("common"))
    return sums.withColumn("ratio", F.try_divide("singletons", "doubletons"))


def windows(freqs: DataFrame, target: int, sizes: list[int]) -> DataFrame:
    """Diversity of the sites within each size of target: count, mean, least and greatest. One pass over the sites."""
    width = F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: F.abs(F.col("position") - target) <= s)).alias("window")
    d = 2 * F.col("p") * (1 - F.col("p"))
    return freqs.select(width, d.alias("d")).groupBy("window").agg(F.count("*").alias("n_sites"), F.avg("d").alias("mean_d"), F.min("d").alias("min_d"), F.max("d").alias("max_d"))


def signature(freqs: DataFrame, target: int, reach: int = 5_000) -> DataFrame:
    """position and diversity of every site within reach of target."""
    return freqs.filter(F.abs(F.col("position") - target) <= reach).select("position", (2 * F.col("p") * (1 - F.col("p"))).alias("diversity"))


def nearest(freqs: DataFrame, target: int, gate: int = 5_000) -> DataFrame:
    """The site next to target, the first of two, with its frequency and whether it is within the gate."""
    away = F.abs(F.col("position") - target)
    best = freqs.agg(F.min(F.struct(away.alias("distance"), F.col("position"), F.col("p"))).alias("b")).filter("b is not null").select("b.*")
    return best.select("position", "distance", "p", (F.col("distance") <= gate).alias("near"))


def compare(stats: DataFrame, by: str, base: str) -> DataFrame:
    """Each group's statistics against those of the base group: differences and change in percent of diversity and theta."""
    ref = stats.filter(F.col(by) == base).select(*[F.col(c).alias(f"base_{c}") for c in ("n_sites", "pi", "theta_w")])
    both = stats.filter(F.col(by) != base).crossJoin(F.broadcast(ref))
    change = lambda c: (100 * F.try_divide(F.col(c) - F.col(f"base_{c}"), F.col(f"base_{c}"))).alias(f"{c}_change")
    return both.select(by, (F.col("n_sites") - F.col("base_n_sites")).alias("n_sites_diff"), (F.col("pi") - F.col("base_pi")).alias("pi_diff"), change("pi"), change("theta_w"))


def sweep(metrics: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and standard error of value over the replicates of each by."""
    return metrics.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"))


def sweep_of(metrics: DataFrame, by: str, values: dict[str, str], sites: str) -> DataFrame:
    """For each by: n, the replicates, the mean of their sites, and mean and standard error (0 for one) of several values."""
    error = lambda c: F.coalesce(F.stddev_samp(c) / F.sqrt(F.count("*")), F.lit(0.0))
    each = [x for name, c in values.items() for x in (F.avg(c).alias(name), error(c).alias(f"{name}_se"))]
    return metrics.groupBy(by).agg(F.count("*").alias("n"), F.avg(sites).alias("mean_sites"), *each)


def rank_correlation(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Pearson's correlation of ranks, ties broken by tie; 0 if it isn't defined. Columns may be of any type that has an order."""
    ranked = numbered(numbered(rows.select(x, y, tie), [x, tie], "rx"), [y, tie], "ry")
    return ranked.agg(F.coalesce(F.nanvl(F.corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def rounded_report(stats: DataFrame) -> DataFrame:
    """Statistics rounded as a report shows them, density by 1000 positions."""
    return stats.select("n_sites", "n_common", F.round("mean_af", 4).alias("mean_af"), F.round("pi", 6).alias("pi"), F.round("theta_w", 6).alias("theta_w"), F.round(F.col("density") * 1000, 2).alias("density_per_kb"))


def rare_and_common(freqs: DataFrame, cut: float = 0.05) -> DataFrame:
    """Variants with a minor allele frequency over cut and the others, and the share of the common ones; 0 without sites."""
    common = F.count_if(F.least(F.col("p"), 1 - F.col("p")) > cut)
    return freqs.agg(common.alias("n_common"), (F.count("*") - common).alias("n_rare"), F.coalesce(F.try_divide(common, F.count("*")), F.lit(0.0)).alias("common_fraction"))
