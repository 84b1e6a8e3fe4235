"""Reshaping and physical forms of genotypes: diploid pairing, filters, dense and sparse layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.operators.numbering import numbered
from popspark.sources.shared import BROADCAST_ROWS, ship, written

#: Individuals and positions of a rectangle of the dense table, and rows of it that are put out at once.
PEOPLE, PLACES, BATCH = 512, 4096, 65_536


def to_diploid(haplotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """ind_id, position, g: how many of the individual's haplotypes carry the allele; zeros have no row.

    samples goes out as a broadcast if it is marked so or Spark finds it small; both sides are otherwise shuffled by haplotype.
    """
    return haplotypes.join(samples, "hap_id").groupBy("ind_id", "position").agg(F.count("*").alias("g"))


def allele_counts(genotypes: DataFrame) -> DataFrame:
    """ac, the derived count, for each position; partial sums are made before the shuffle."""
    return genotypes.groupBy("position").agg(F.sum("g").alias("ac"))


def carrier_counts(haplotypes: DataFrame) -> DataFrame:
    """ac for each position straight from distinct haplotype rows: no pairing into individuals."""
    return haplotypes.groupBy("position").agg(F.count("*").alias("ac"))


def last_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows (ind_id, position, g) that share a cell the last one by order, and a 0 for each cell without a row.

    Only cells with a row are dealt out: rectangles of PEOPLE x PLACES cells are filled in the tasks, so the dense table
    passes no shuffle. A rectangle is one row of its ids, its positions and its cells.
    """
    spark = rows.sparkSession
    ship(spark)
    held = written(rows.groupBy("ind_id", "position").agg(F.max_by("g", F.struct(*order)).alias("g")), "cells")
    sides = {}
    for key, size in (("ind_id", PEOPLE), ("position", PLACES)):
        placed = numbered(held.select(key).distinct(), key, "at").select(key, F.floor((F.col("at") - 1) / size).cast("int").alias(f"{key}_of"), ((F.col("at") - 1) % size).cast("int").alias(f"{key}_at"))
        sides[key] = written(placed, "placed"), size
    cells = held.filter("g <> 0")
    for key, (placed, _) in sides.items():
        cells = cells.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, key)
    lots = ["ind_id_of", "position_of"]
    cells = cells.groupBy(*lots).agg(F.collect_list(F.col("ind_id_at") * PLACES + F.col("position_at")).alias("at"), F.collect_list("g").alias("g"))
    parts = [placed.groupBy(f"{key}_of").agg(F.sort_array(F.collect_list(F.struct(f"{key}_at", key))).alias("x")).select(f"{key}_of", F.col("x")[key].alias(f"{key}s")) for key, (placed, _) in sides.items()]
    grid = parts[1].crossJoin(F.broadcast(parts[0]))  # some hundredths of a row for each individual
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    whole = grid.repartition(number, *lots).join(cells.repartition(number, *lots), lots, "left").select("ind_ids", "positions", "at", "g")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("ind_id", "position", "g")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, positions, at, g = (batch.column(c)[k].values for c in range(4))
                n, filled = len(positions), np.zeros(len(ids) * PLACES, np.int64)
                if at is not None:
                    filled[at.to_numpy()] = g.to_numpy()
                filled = filled.reshape(len(ids), PLACES)[:, :n].reshape(-1)
                step = max(1, BATCH // n)
                for i in range(0, len(ids), step):
                    some = np.arange(i, min(i + step, len(ids)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(some, n))), positions.take(pa.array(np.tile(np.arange(n), len(some)))), pa.array(filled[i * n : (i + len(some)) * n]).cast(batch.schema.field("g").type.value_type)], list(kinds))

    return whole.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def lookup(cells: DataFrame, genotypes: DataFrame, individuals: DataFrame, positions: DataFrame) -> DataFrame:
    """cells (i, j: row and column from 1) with g: the genotype there, 0 where there is none, null out of bounds."""
    rows = numbered(individuals.select("ind_id").distinct(), "ind_id", "i")
    cols = numbered(positions.select("position").distinct(), "position", "j")
    inside = cells.join(rows, "i", "left").join(cols, "j", "left").join(genotypes.select("ind_id", "position", "g"), ["ind_id", "position"], "left")
    return inside.select("i", "j", F.when(F.col("ind_id").isNotNull() & F.col("position").isNotNull(), F.coalesce("g", F.lit(0))).alias("g"))


def polymorphic(counts: DataFrame, n_hap: DataFrame) -> DataFrame:
    """Positions that some haplotypes carry, but not all. n_hap is a table of one row."""
    return counts.crossJoin(F.broadcast(n_hap)).filter((F.col("ac") > 0) & (F.col("ac") < F.col("n_hap"))).select("position", "ac")


def joined_rows(entries: DataFrame, keys: DataFrame | None, key: str, n: DataFrame, cell, sep: str, head: Column | None = None) -> DataFrame:
    """For each key one string of n cells, after head and each after a sep, or without head between seps: those of entries (key, at, g) at their places from 1, and zeros between.

    Only entries are gathered; the zeros between two of them are one repeated string. n is a table of one row. Without
    keys those of the entries are taken. Lines may be long, so the string is put together once and not cut again.
    """
    _small_pages(entries.sparkSession)
    zero = F.concat(F.lit(sep), cell(F.lit(0)))
    held = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "g"))).alias("e"))
    rows = (keys.select(key).distinct().join(held, key, "left") if keys is not None else held).crossJoin(F.broadcast(n.toDF("n")))
    e = F.coalesce("e", F.array().cast(held.schema["e"].dataType))
    gap = lambda upto, after: F.repeat(zero, (upto - after - 1).cast("int"))
    before = lambda k: F.when(k > 0, F.try_element_at(e, k)["at"]).otherwise(0)
    first = lambda x, k: x if head is not None else F.when(k, F.ltrim(x, F.lit(sep))).otherwise(x)
    parts = F.transform(e, lambda x, k: first(F.concat(gap(x["at"], before(k)), F.lit(sep), cell(x["g"])), k == 0))
    last = F.coalesce(F.try_element_at(e, F.lit(-1))["at"], F.lit(0))
    tail = first(gap(F.col("n") + 1, last), F.size(e) == 0)
    return rows.select(key, F.array_join(F.concat(F.array(F.lit("") if head is None else head), parts, F.array(tail)), "").alias("line"))


def _small_pages(spark: SparkSession) -> None:
    """Let Parquet look after each row whether a page is full: of lines of megabytes it else holds a hundred. Kept if it was set."""
    if spark.conf.get("parquet.page.size.row.check.min", None) is None:
        spark.conf.set("parquet.page.size.row.check.min", "1")


def dense(genotypes: DataFrame, individuals: DataFrame, positions: DataFrame) -> DataFrame:
    """One row for each individual: its genotypes at all positions in order, as an array."""
    places = numbered(positions.select("position").distinct(), "position", "at")
    n = positions.agg(F.countDistinct("position").alias("n"))
    rows = joined_rows(genotypes.join(places, "position").select("ind_id", "at", "g"), individuals, "ind_id", n, lambda g: g.cast("string"), ",")
    return rows.select("ind_id", F.split("line", ",").cast("array<long>").alias("row"))


def column_pointers(genotypes: DataFrame, positions: DataFrame) -> DataFrame:
    """Compressed sparse columns: for each position its column and the place of its first entry, from 1."""
    counts = positions.select("position").distinct().join(genotypes.filter("g <> 0").groupBy("position").agg(F.count("*").alias("nnz")), "position", "left")
    placed = numbered(counts.withColumn("nnz", F.coalesce("nnz", F.lit(0)).cast("long")), "position", "column", "nnz", "before")
    return placed.select("position", "column", (F.col("before") + 1).alias("pointer"), "nnz")


def shape(genotypes: DataFrame, individuals: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, nnz, sparsity, bytes of the compressed form, and the layout that suits the table."""
    rows = individuals.agg(F.countDistinct("ind_id").alias("n_rows"))
    cols = positions.agg(F.countDistinct("position").alias("n_cols"))
    cells = genotypes.filter("g <> 0").agg(F.count("*").alias("nnz"), F.coalesce(F.max("g"), F.lit(0)).alias("top"))
    one = rows.crossJoin(cols).crossJoin(cells).withColumn("cells", F.col("n_rows") * F.col("n_cols"))
    sparsity = F.when(F.col("cells") > 0, (F.col("cells") - F.col("nnz")) / F.col("cells")).otherwise(F.lit(0.0))
    layout = F.when(F.col("cells") == 0, "dense").when((F.col("top") <= 1) & (F.col("sparsity") > 0.9), "bitpacked").when(F.col("sparsity") > 0.7, "sparse").otherwise("dense")
    size = 4 * F.col("nnz") + 4 * (F.col("n_cols") + 1) + F.col("nnz") + 4 * F.col("n_cols") + 8
    return one.withColumn("sparsity", sparsity).select("n_rows", "n_cols", "nnz", F.round("sparsity", 6).alias("sparsity"), size.alias("bytes"), layout.alias("layout"))


def bit_positions(genotypes: DataFrame, individuals: DataFrame, positions: DataFrame) -> DataFrame:
    """ind_id, position and the place of the cell's bit in column-major order, from 0, of every cell that isn't 0."""
    rows = numbered(individuals.select("ind_id").distinct(), "ind_id", "r")
    cols = numbered(positions.select("position").distinct(), "position", "c")
    n = rows.agg(F.count("*").alias("n"))
    placed = genotypes.filter("g <> 0").join(rows, "ind_id").join(cols, "position").crossJoin(F.broadcast(n))
    return placed.select("ind_id", "position", ((F.col("c") - 1) * F.col("n") + F.col("r") - 1).cast("long").alias("bit"))
