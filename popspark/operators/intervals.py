"""Algebra of half-open integer intervals (id, s, e)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators import ranges as R
from popspark.operators.numbering import numbered
from popspark.sources.shared import ship, written


def merge(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The union of each id's intervals; those that touch become one. by: other columns than id that tell groups apart.

    Each range of (id, s) is merged by itself. The greatest end of the ranges before tells which of its islands go on
    from one begun there, and the last start of such an island is carried on too. So an id may span many tasks.
    """
    by = by or ["id"]
    placed = R.ranged(rows.select(*by, "s", "e"), by, ["s", "e"])
    local = placed.withColumn("fresh", F.when(F.col("s") <= R.before(by, F.col("e"), F.max), 0).otherwise(1))
    local = local.withColumn("island", R.upto(by, F.col("fresh"), F.sum))
    islands = local.groupBy(R.RANGE, *by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    open_ = R.carried(written(islands, "islands"), by, "reach", F.max("e"), F.max)
    begins = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s"))
    whole = R.carried(written(open_.withColumn("begins", begins), "begun"), by, "start", F.max("begins"), F.max)
    return whole.groupBy(*by, F.coalesce("begins", "start").alias("s")).agg(F.max("e").alias("e"))


def split(rows: DataFrame, at: int) -> DataFrame:
    """Each interval's parts left and right of a position, with their side."""
    part = lambda side, s, e: F.struct(F.lit(side).alias("side"), s.alias("s"), e.alias("e"))
    s, e, p = F.col("s"), F.col("e"), F.lit(at).cast("long")
    parts = F.when(e <= p, F.array(part("left", s, e))).when(s >= p, F.array(part("right", s, e))).otherwise(F.array(part("left", s, p), part("right", p, e)))
    return rows.select("id", F.explode(parts).alias("x")).select("id", "x.*")


def bins(rows: DataFrame, width: int) -> DataFrame:
    """A row for each bin of this width that an interval touches."""
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))


def intersect(left: DataFrame, right: DataFrame, width: int = 1_000) -> DataFrame:
    """Overlaps of intervals of the same id. Both sides meet in bins, and an overlap counts in the bin where it begins."""
    a = bins(left.select("id", "s", "e"), width)
    b = bins(right.select("id", F.col("s").alias("s2"), F.col("e").alias("e2")).withColumnsRenamed({"s2": "s", "e2": "e"}), width).withColumnsRenamed({"s": "s2", "e": "e2"})
    lo, hi = F.greatest("s", "s2"), F.least("e", "e2")
    return a.join(b, ["id", "bin"]).filter((lo < hi) & (F.floor(lo / width) == F.col("bin"))).select("id", lo.alias("s"), hi.alias("e"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Intervals by range of their starts, each also in every further range that begins before it ends: to, id, s, e, open.

    open marks those carried over a border. An interval has a row for each range it reaches, however long it is.
    """
    spark = rows.sparkSession
    ship(spark)
    placed = R.ranged(rows.select("id", "s", "e").filter("s < e"), [], ["s"])
    found = placed.groupBy(R.RANGE).agg(F.min("s").alias("s")).orderBy("s").collect()  # a row for each range
    names, cuts = np.array([r[R.RANGE] for r in found], np.int64), np.array([r["s"] for r in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = np.searchsorted(names, pdf[R.RANGE].to_numpy())
            reach = np.maximum(np.searchsorted(cuts, pdf["e"].to_numpy(), side="left") - first, 1)  # borders below the end
            at = np.repeat(np.arange(len(pdf)), reach)
            step = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
            out = pdf.iloc[at][["id", "s", "e"]]
            yield out.assign(to=first[at] + step, open=step > 0)[["to", "id", "s", "e", "open"]]

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "s", "e")}
    return placed.mapInPandas(run, f"to long, id {kinds['id']}, s {kinds['s']}, e {kinds['e']}, open boolean")


def _sweep(rows: DataFrame, met, schema: str) -> DataFrame:
    """What met makes of each interval and those open where it begins: met(id, ids) gives rows; one range after another, starts ascending.

    A task holds the intervals that are open at one place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, ends = None, [], np.zeros(0)
        for pdf in batches:
            out = []
            for to, i, s, e, carried in zip(pdf["to"], pdf["id"], pdf["s"], pdf["e"], pdf["open"]):
                if to != now:
                    now, ids, ends = to, np.zeros(0, pdf["id"].dtype), np.zeros(0)
                live = ends > s
                if not live.all():
                    ids, ends = ids[live], ends[live]
                if not carried and len(ids):
                    out += met(i, ids)
                ids, ends = np.append(ids, i), np.append(ends, e)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(rows).repartition(parts, "to").sortWithinPartitions("to", F.col("open").desc(), "s", "id")
    return dealt.mapInPandas(run, schema)


def overlapping(rows: DataFrame) -> DataFrame:
    """Pairs a < b of ids any of whose intervals overlap, with the number of overlaps, by a sweep along the starts.

    Each overlap counts where the later of the two begins. Empty intervals overlap nothing.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def met(i, ids: np.ndarray) -> list[tuple]:
        others, counts = np.unique(ids[ids != i], return_counts=True)
        return [(min(i, o), max(i, o), n) for o, n in zip(others.tolist(), counts.tolist())]

    return _sweep(rows, met, f"a {kind}, b {kind}, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def containing(points: DataFrame, rows: DataFrame, width: int = 1_000) -> DataFrame:
    """The points (id, position) that lie in an interval of their id."""
    cells = bins(rows, width).select("id", "bin", "s", "e")
    keyed = points.withColumn("bin", F.floor(F.col("position") / width))
    return keyed.join(cells, (keyed["id"] == cells["id"]) & (keyed["bin"] == cells["bin"]) & (keyed["position"] >= cells["s"]) & (keyed["position"] < cells["e"]), "left_semi").drop("bin")


def between(breaks: DataFrame, length: int) -> DataFrame:
    """Intervals between the distinct breakpoints (column position), with both ends of the sequence. For one sequence's breakpoints."""
    ends = breaks.sparkSession.createDataFrame([(1,), (length + 1,)], "position long")
    points = breaks.select(F.col("position").cast("long")).filter(F.col("position").between(1, length + 1)).unionByName(ends).distinct()
    placed = numbered(points, "position", "k")
    after = placed.select((F.col("k") - 1).alias("k"), F.col("position").alias("e"))
    return placed.join(after, "k").select(F.col("position").alias("s"), "e")


def as_of(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Each point (id, position, and what else it has) with target, that of the last mark (id, at, target) at or before it, or null.

    Points and marks lie in one order. Each range of it looks back in itself, and the last mark of the ranges before is
    carried in, so an id may span many tasks. Of marks at one place the greatest target counts.
    """
    kind, more = dict(marks.dtypes)["target"], [c for c in points.columns if c not in ("id", "position")]
    left = points.select("id", "position", F.lit(1).alias("is_point"), F.lit(None).cast(kind).alias("target"), F.struct(F.lit(0).alias("x_"), *more).alias("more"))
    right = marks.select("id", F.col("at").cast(dict(points.dtypes)["position"]).alias("position"), F.lit(0).alias("is_point"), "target", F.lit(None).cast(left.schema["more"].dataType).alias("more"))
    both = R.ranged(left.unionByName(right), ["id"], ["position", "is_point", "target"])
    last = lambda c: F.last(c, ignorenulls=True)
    out = R.carried(both, ["id"], "carried", F.max_by("target", F.when(F.col("target").isNotNull(), F.col(R.PLACE))), last)
    own = R.upto(["id"], F.col("target"), last)
    return out.withColumn("target", F.coalesce(own, F.col("carried"))).filter("is_point = 1").select("id", "position", *[F.col("more")[c].alias(c) for c in more], "target")


def clamped_bins(rows: DataFrame, width: int, n_bins: int) -> DataFrame:
    """A row for each of the bins 1..n_bins that an interval touches; what lies beyond counts in the last or first one."""
    at = lambda p: F.least(F.greatest(F.ceil(p / width), F.lit(1)), F.lit(n_bins)).cast("long")
    return rows.withColumn("bin", F.explode(F.sequence(at(F.col("s")), at(F.greatest(F.col("s"), F.col("e") - 1)))))


def bounds(rows: DataFrame) -> DataFrame:
    """Each id's least start and greatest end."""
    return rows.groupBy("id").agg(F.min("s").alias("min_start"), F.max("e").alias("max_end"))


def first_overlap(rows: DataFrame) -> DataFrame:
    """The first two ids, in order, any of whose intervals overlap; no row if there are none.

    The sweep keeps one pair for each interval: of those open where it begins the least id, and the interval's own.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def met(i, ids: np.ndarray) -> list[tuple]:
        others = ids[ids != i]
        return [(min(i, o), max(i, o)) for o in [others.min().item()]] if len(others) else []

    found = _sweep(rows, met, f"a {kind}, b {kind}")
    return found.agg(F.min(F.struct("a", "b")).alias("x")).filter("x is not null").select("x.a", "x.b")


def clipped(rows: DataFrame, length: int) -> DataFrame:
    """Intervals within [1, length]; what lies outside goes."""
    return rows.select("id", F.greatest("s", F.lit(1)).alias("s"), F.least("e", F.lit(length + 1)).alias("e")).filter("s < e")


def total_length(rows: DataFrame, length: int) -> DataFrame:
    """Positions within [1, length] that each id's intervals hold."""
    return clipped(rows, length).groupBy("id").agg(F.sum(F.col("e") - F.col("s")).alias("total"))


def sample_position(rows: DataFrame, draws: DataFrame, length: int) -> DataFrame:
    """draws (id, u in [0, 1)) with position: a uniform one of those that the id's intervals hold within [1, length].

    A draw aims at a place in the joined intervals, and the last interval that begins there or before is looked up.
    """
    own = R.running_sum(clipped(rows, length).withColumn("size", F.col("e") - F.col("s")), ["id"], ["s"], "size", "before")
    aimed = draws.join(total_length(rows, length), "id").withColumn("position", F.floor(F.col("u") * F.col("total")).cast("long"))
    found = as_of(aimed.select("id", "position", "total"), own.select("id", F.col("before").alias("at"), (F.col("s") - F.col("before")).alias("target")))
    return found.select("id", "total", (F.col("position") + F.col("target")).cast("long").alias("position"))
