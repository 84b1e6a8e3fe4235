"""Scalar models as column expressions and small tables: demography, recombination maps, selection, coalescent times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone, so reruns and other partitionings agree."""
    text = F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def epochs(spark: SparkSession, rows: Sequence[tuple[float, float | None, float]]) -> DataFrame:
    """A demography: (t_start, t_end, ne), from the present backwards without gaps; the last one has no end."""
    at = 0.0
    for k, (start, end, ne) in enumerate(rows):
        if start != at or ne <= 0 or (end is None) != (k == len(rows) - 1) or end is not None and end <= start:
            raise ValueError("epochs must begin at 0, follow one another and end open")
        at = end
    return spark.createDataFrame([(k, s, e, n) for k, (s, e, n) in enumerate(rows)], "idx int, t_start double, t_end double, ne double")


def constant(spark: SparkSession, ne: float) -> DataFrame:
    """A demography of one size throughout."""
    return epochs(spark, [(0.0, None, ne)])


def bottleneck(spark: SparkSession, present: float, reduced: float, start: float, end: float, ancestral: float | None = None) -> DataFrame:
    return epochs(spark, [(0.0, start, present), (start, end, reduced), (end, None, ancestral or present)])


def size_at(times: DataFrame, demography: DataFrame) -> DataFrame:
    """times (column t) with ne and t_end of their epoch; the epochs of a demography are few and go out as a broadcast."""
    e = F.broadcast(demography.select("t_start", "t_end", "ne"))
    return times.join(e, (F.col("t") >= F.col("t_start")) & (F.col("t_end").isNull() | (F.col("t") < F.col("t_end")))).drop("t_start")


def map_cumulative(segments: DataFrame) -> DataFrame:
    """Segments (idx, s, e, rate) of one map with cum, the rate summed up to their end."""
    return segments.withColumn("cum", F.sum((F.col("e") - F.col("s")) * F.col("rate")).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))


def hotspot_map(spark: SparkSession, length: int, rate: float, period: int = 100_000, fraction: float = 0.05, hot: float = 20.0, cold: float = 0.02) -> DataFrame:
    """Each period begins with a hotspot; both rates are scaled to a mean of rate over whole periods."""
    mean, wide = fraction * hot + (1 - fraction) * cold, max(1, round(fraction * period))
    base = spark.range(0, -(-length // period)).select((F.col("id") * period + 1).alias("start"))
    seg = lambda s, e, r: F.struct(s.alias("s"), F.least(e, F.lit(length + 1)).alias("e"), F.lit(r).alias("rate"))
    start = F.col("start")
    rows = base.select(F.inline(F.array(seg(start, start + wide, rate * hot / mean), seg(start + wide, start + period, rate * cold / mean)))).filter("s < e")
    return rows.withColumn("idx", F.row_number().over(Window.orderBy("s")))


def recombination_map(spark: SparkSession, positions: Sequence[int], rates: Sequence[float]) -> DataFrame:
    """A map of segments between positions, one rate for each, with its cumulative rate."""
    if len(positions) != len(rates) + 1 or any(b <= a for a, b in zip(positions, positions[1:])) or any(r < 0 for r in rates):
        raise ValueError("positions must rise, be one more than the rates, and rates must not be negative")
    rows = [(i + 1, s, e, float(r)) for i, (s, e, r) in enumerate(zip(positions, positions[1:], rates))]
    return map_cumulative(spark.createDataFrame(rows, "idx int, s long, e long, rate double"))


def uniform_map(spark: SparkSession, length: int, rate: float) -> DataFrame:
    """A map of one rate over positions 1 to length."""
    return recombination_map(spark, [1, length + 1], [rate])


def breakpoints(draws: DataFrame, cumulative: DataFrame, length: int) -> DataFrame:
    """draws (column u) with position: where the map's cumulative rate reaches u of its total.

    Without any rate all positions before the map's end are as likely, and an empty map gives 1. The map is broadcast,
    as it is one sequence's.
    """
    total = cumulative.agg(F.max("cum").alias("total"), F.max("e").alias("end"))
    m = cumulative.filter("rate > 0").select("s", "rate", "cum", (F.col("cum") - (F.col("e") - F.col("s")) * F.col("rate")).alias("before"))
    aim = F.col("u") * F.col("total")
    found = draws.crossJoin(F.broadcast(total)).join(F.broadcast(m), (aim > F.col("before")) & (aim <= F.col("cum")) | (F.col("u") == 0) & (F.col("before") == 0), "left")
    place = F.floor(F.col("s") + (aim - F.col("before")) / F.col("rate"))
    place = F.when(F.col("total").isNull(), F.lit(1)).when(F.col("total") == 0, F.floor(1 + F.col("u") * (F.col("end") - 1))).otherwise(F.least(F.greatest(place, F.lit(1)), F.lit(length)))
    return found.withColumn("position", place.cast("long")).select(*draws.columns, "position")


def parameters(ne: int, mutation_rate: float, recombination_rate: float, sequence_length: int, sample_size: int) -> dict:
    """Parameters of a population, checked: sizes and length above 0, rates not below."""
    if ne <= 0 or sequence_length <= 0 or sample_size <= 0 or mutation_rate < 0 or recombination_rate < 0:
        raise ValueError("ne, sequence_length and sample_size must be positive and rates not negative")
    return {"ne": ne, "mutation_rate": mutation_rate, "recombination_rate": recombination_rate, "sequence_length": sequence_length, "sample_size": sample_size}


def directional(s: float, h: float, position: int, start: float, p0: float | None = None) -> dict:
    p0 = START if p0 is None else p0
    if s <= 0 or not 0 <= h <= 1 or position <= 0 or start < 0 or not 0 < p0 < 1:
        raise ValueError("a sweep has s > 0, h in [0, 1], a position above 0, a start not below 0 and a frequency in (0, 1)")
    return {"kind": "directional", "s": s, "h": h, "position": position, "start": start, "p0": p0}


def balancing(s: Sequence[float], position: int, frequencies: Sequence[float]) -> dict:
    if len(s) != len(frequencies) or any(x < 0 for x in s) or abs(sum(frequencies) - 1) >= 1e-10 or not all(0 < f < 1 for f in frequencies):
        raise ValueError("each allele has a coefficient not below 0 and a frequency in (0, 1), and these sum to 1")
    return {"kind": "balancing", "s": list(s), "position": position, "frequencies": list(frequencies)}


def background(rate: float, s: float, h: float = 0.0) -> dict:
    if rate < 0 or s >= 0 or not 0 <= h <= 1:
        raise ValueError("background selection has a rate not below 0, s < 0 and h in [0, 1]")
    return {"kind": "background", "rate": rate, "s": s, "h": h}


def coefficient_at(model: dict | None, position: Column) -> Column:
    """The selection coefficient at a position: 0 without a model, everywhere that of background selection, else at its site."""
    if model is None:
        return F.lit(0.0)
    if model["kind"] == "background":
        return F.lit(float(model["s"]))
    s = model["s"][0] if model["kind"] == "balancing" else model["s"]
    return F.when(position == model["position"], F.lit(float(s))).otherwise(F.lit(0.0))


#: Frequency at which a selected allele starts: one copy among 10,000 individuals.
START = 1 / 20_000


def trajectory(t: Column, s: float, h: float, start: float, p0: float = START) -> Column:
    """Frequency of a selected allele: p0 until start, logistic growth after it."""
    grow = s * (h + (1 - 2 * h) * p0)
    e = F.exp(F.lit(grow) * (t - start))
    p = F.lit(p0) * e / (F.lit(1 - p0) + F.lit(p0) * e)
    p = F.when(t < start, F.lit(p0)).otherwise(p) if abs(grow) >= 1e-10 else F.lit(p0)
    return F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))


def ne_directional(position: Column, ne: float, s: float, at: int) -> Column:
    return F.lit(ne) / (1 + F.lit(s) * F.exp(-F.abs(position - at) / 1000.0))


def ne_background(ne: float, rate: float, s: float, h: float) -> Column:
    u, s = rate * 1000, abs(s)
    return F.lit(ne) * F.exp(F.lit(-u * (h + (1 - h) * s) / s))


def ne_sweep(p: Column, ne: float, s: float) -> Column:
    """Population size that lineages feel while an allele of frequency p is swept."""
    reduced = F.greatest(F.lit(ne) / (1 + 4 * p * (1 - p) * s), F.lit(0.01 * ne))
    return F.when((p > 1e-6) & (p < 1 - 1e-6), reduced).otherwise(F.lit(float(ne)))


def coalescent_times(params: DataFrame) -> DataFrame:
    """params (rep, n, ne): for each rep the times at which k lineages become k-1, at constant size."""
    each = params.select("rep", "ne", F.explode(F.sequence(F.col("n").cast("int"), F.lit(2), F.lit(-1))).alias("k"))
    k = F.col("k").cast("double")
    wait = -F.log(1 - uniform("rep", F.lit("wait"), "k")) * 4 * F.col("ne") / (k * (k - 1))
    order = Window.partitionBy("rep").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("wait", wait).select("rep", "k", F.sum("wait").over(order).alias("time"))


def expected_sites(ne: Column, mu: Column, length: Column, n: Column) -> Column:
    """Expected segregating sites of n individuals."""
    h = F.aggregate(F.sequence(F.lit(1), (2 * n - 1).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i.cast("double"))
    return 4 * ne * mu * length * h


def size_class(n: Column, length: Column, mb: Column) -> Column:
    return F.when((n > 100) | (length > 1_000_000) | (mb > 1024), "large").when(mb > 512, "medium").otherwise("small")


def memory_estimate(ne: Column, mu: Column, length: Column, n: Column, node_bytes: int = 64) -> dict[str, Column]:
    """Expected megabytes of the dense genotypes and of the tree of n individuals, and both."""
    sites, nodes, mb = expected_sites(ne, mu, length, n), 2 * n - 1, 1024.0 * 1024.0
    genotype, tree = 2 * n * sites / mb, (nodes * node_bytes + sites * 8) / mb
    return {"genotype_mb": genotype, "tree_mb": tree, "total_mb": genotype + tree}


#: Settings by class of size: memory pool, sites of a dense table at most, sparsity from which a table is sparse.
SETTINGS = {"large": (True, 5_000, 0.6), "medium": (True, 10_000, 0.7), "small": (False, 20_000, 0.8)}


def memory_settings(kind: Column) -> dict[str, Column]:
    pick = lambda i: F.when(kind == "large", SETTINGS["large"][i]).when(kind == "medium", SETTINGS["medium"][i]).otherwise(SETTINGS["small"][i])
    return {"compact_nodes": kind == "large", "memory_pool": pick(0), "max_dense_sites": pick(1), "sparsity_threshold": pick(2)}
