"""Leading eigenvalues of the relatedness matrix by block Lanczos; the matrix is never formed for more than WHOLE individuals.

A vector is a column over individuals, a block of vectors a table of rows. A product with the matrix is two joins with
the genotypes and two sums, first by site, then by individual. The basis stays a table; only products of its columns
with each other, small square matrices, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators import tiles
from popspark.sources.shared import ship, written

#: Vectors in a block, and the most vectors of a basis.
BLOCK, MOST = 16, 800
#: Individuals up to which the summary takes all eigenvalues of the matrix itself (134 MB of doubles on the driver).
WHOLE = 4096
#: Directions that are shorter than this share of the longest one are left out of a new block.
FLAT = 1e-7


def _products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """The matrix of products of two array columns, summed over rows: by batch in the tasks, then by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cols = None, 0
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf[left].to_list()), np.stack(pdf[right].to_list())
                total, cols = a.T @ b + (0 if total is None else total), b.shape[1]
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(total.size), "cols": cols, "x": total.reshape(-1)})

    cells = rows.select(*dict.fromkeys((left, right))).mapInPandas(run, "cell long, cols long, x double").groupBy("cell", "cols").agg(F.sum("x").alias("x")).orderBy("cell").toPandas()
    return cells["x"].to_numpy().reshape(-1, int(cells["cols"].iloc[0]))


def _mapped(rows: DataFrame, f, names: list[str], kinds: str) -> DataFrame:
    """Array columns that f makes of a batch's array columns, as matrices, beside r."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                made = f(*(np.stack(pdf[c].to_list()) for c in names))
                yield pd.DataFrame({"r": pdf["r"], **{c: list(x) for c, x in made.items()}})

    return rows.select("r", *names).mapInPandas(run, kinds)


def multiply(vectors: DataFrame, entries: DataFrame, sites: DataFrame, p: int, width: int) -> DataFrame:
    """r, v, y: vectors (r, v) with y, their product with the relatedness matrix.

    entries: position, r and x = g / sd of each carrier. sites: position and m = mean / sd. What absent genotypes add
    is the same for all of a site or of all individuals, so it goes in as sums.
    """
    cols = range(width)
    flat = vectors.select("r", *[F.col("v")[k].alias(f"v{k}") for k in cols])
    sums = flat.agg(*[F.sum(f"v{k}").alias(f"u{k}") for k in cols])  # one row
    by_site = entries.join(flat, "r").groupBy("position").agg(*[F.sum(F.col("x") * F.col(f"v{k}")).alias(f"s{k}") for k in cols])
    by_site = by_site.join(sites, "position").join(F.broadcast(sums))
    by_site = written(by_site.select("position", "m", *[(F.col(f"s{k}") - F.col("m") * F.col(f"u{k}")).alias(f"s{k}") for k in cols]), "by_site")
    away = by_site.agg(*[F.sum(F.col("m") * F.col(f"s{k}")).alias(f"c{k}") for k in cols])  # one row
    back = entries.join(by_site, "position").groupBy("r").agg(*[F.sum(F.col("x") * F.col(f"s{k}")).alias(f"y{k}") for k in cols])
    y = F.array(*[(F.coalesce(F.col(f"y{k}"), F.lit(0.0)) - F.col(f"c{k}")) / p for k in cols])
    return vectors.join(back, "r", "left").join(F.broadcast(away)).select("r", "v", y.alias("y"))


def leading(genotypes: DataFrame, individuals: DataFrame, top: int = 10, block: int = BLOCK, most: int = MOST, tolerance: float = 1e-9) -> tuple[np.ndarray, int, int, int]:
    """Eigenvalues in falling order, of which the top ones are exact, the numbers of individuals and of sites that vary, and the size of the basis.

    Steps end when neither the first eigenvalue nor the sum of the top ones grows by more than tolerance (a share of
    it), when the basis holds all directions that the matrix has, or at most vectors. The basis isn't quite orthogonal,
    so its own products enter the small problem, which is solved in a basis of them.
    """
    spark = genotypes.sparkSession
    ship(spark)
    people, n = tiles.people_of(individuals)
    rows = written(tiles.site_rows(genotypes, people, n), "sites")
    p = rows.count()
    if not p or n < 2:
        return np.zeros(0), n, p, 0
    sites = written(rows.select("position", (F.col("mean") / F.col("sd")).alias("m")), "means")
    each = rows.select("position", "sd", F.explode(F.arrays_zip("rs", "gs")).alias("c"))
    entries = written(each.select("position", F.col("c.rs").alias("r"), (F.col("c.gs") / F.col("sd")).alias("x")), "entries")
    width = min(block, n)
    start = F.array(*[F.pmod(F.xxhash64("r", F.lit(k)), F.lit(1 << 20)) / (1 << 19) - 1.0 for k in range(width)])
    made = written(people.select("r", F.array().cast("array<double>").alias("q"), start.alias("w")), "start")
    held, projected, overlap, last = 0, np.zeros((0, 0)), np.zeros((0, 0)), None
    while True:
        # made: the basis so far (q) and new directions (w), which are freed of it and of each other.
        cross = _products(made, "q", "w") if held else np.zeros((0, width))
        fix = np.linalg.solve(overlap, cross) if held else cross
        clean = _mapped(made, lambda q, w, fix=fix: {"q": q, "w": w - q @ fix if fix.size else w}, ["q", "w"], "r int, q array<double>, w array<double>") if held else made
        values, turn = np.linalg.eigh(_products(clean, "w", "w"))
        good = values > FLAT**2 * max(values.max(), 1e-300)
        if (held and values.max() < 1e-20 * n) or held >= min(n, most) or not good.any():
            break
        turn = turn[:, good] / np.sqrt(values[good])
        width = turn.shape[1]
        ready = written(_mapped(clean, lambda q, w, turn=turn: {"q": np.hstack([q, w @ turn]), "v": w @ turn}, ["q", "w"], "r int, q array<double>, v array<double>"), "basis")
        times = written(multiply(ready.select("r", "v"), entries, sites, p, width), "products")
        both = ready.select("r", "q").join(times, "r")
        made = written(_mapped(both, lambda q, v, y: {"q": q, "w": y, "vy": np.hstack([v, y])}, ["q", "v", "y"], "r int, q array<double>, w array<double>, vy array<double>"), "made")
        cross = _products(made, "q", "vy")
        new = cross[:, :width], cross[:, width:]
        held += width
        grown = []
        for old, column in zip((overlap, projected), new):
            whole = np.zeros((held, held))
            whole[: held - width, : held - width] = old
            whole[:, held - width :] = column
            whole[held - width :, :] = column.T
            grown.append(whole)
        overlap, projected = grown
        size, turn = np.linalg.eigh(overlap)
        keep = size > 1e-8 * size.max()
        inner = turn[:, keep] / np.sqrt(size[keep])
        found = np.linalg.eigvalsh(inner.T @ ((projected + projected.T) / 2) @ inner)[::-1]
        now = np.array([found[0], found[:top].sum()])
        if len(found) >= top and last is not None and np.all(np.abs(now - last) <= tolerance * np.abs(now)):
            break
        last = now
        made = made.drop("vy")
    return np.clip(found, 0, None), n, p, held


def summary(genotypes: DataFrame, individuals: DataFrame, whole: int = WHOLE, **options) -> DataFrame:
    """One row: p, top1 and top10 (shares of the trace), mp_ratio, tw_like, entropy, eig_variance and participation.

    Up to whole individuals all follow from all eigenvalues. Beyond, the last two come from the moments, the others from
    the leading eigenvalues, and entropy, which takes all of them, is null unless those found make up the trace, as they
    do for matrices of low rank. No row for under two individuals or two sites that vary.
    """
    spark = genotypes.sparkSession
    matrix, n, p = tiles.whole_matrix(genotypes, individuals, whole)
    if n > whole:
        values, n, p, _ = leading(genotypes, individuals, **options)
    elif matrix is not None:
        values = np.clip(np.linalg.eigvalsh(matrix)[::-1], 0, None)
    root = np.sqrt(max(n - 1, 0)) + np.sqrt(p)
    rows = []
    if n > 1 and p > 1:
        edge, middle = (1 + np.sqrt(n / p)) ** 2, root**2 / p
        width = root / p * (1 / np.sqrt(n - 1) + 1 / np.sqrt(p)) ** (1 / 3)
        share = values[values > 0] / n  # the trace is n
        entropy = float(-(share * np.log(share)).sum()) if abs(share.sum() - 1) < 1e-9 else None
        rows = [(p, *map(float, (values[0] / n, values[:10].sum() / n, values[0] / edge, (values[0] - middle) / width)), entropy)]
    names = "p long, top1 double, top10 double, mp_ratio double, tw_like double, entropy double"
    if n > whole:
        return spark.createDataFrame(rows, names).join(tiles.moments(genotypes, individuals).select("p", "eig_variance", "participation"), "p")
    rows = [(*r, float(((values**2).sum() - n) / (n - 1)), float(n * n / (values**2).sum())) for r in rows]
    return spark.createDataFrame(rows, f"{names}, eig_variance double, participation double")
