"""Genealogies as tables: trees by replicate, mutations on branches, and what leaves carry.

A replicate is one row of parameters; its sequence of joins is drawn by a small helper in one task, replicates side by
side. All that grows with sites and samples (branches, mutations, carriers, genotypes) is joins and groups.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.functions.models import START
from popspark.operators.intervals import merge
from popspark.operators.ranges import running_sum
from popspark.sources.shared import BROADCAST_ROWS, shared_dir, written

NODES = "rep long, node_id long, parent_id long, time double"


def draw_tree(rng: np.random.Generator, n: int, size_at) -> list[tuple]:
    """(node_id, parent_id, time) of a tree over n leaves 1..n; size_at(t) is the population size and the time until it changes."""
    live, times, parent, t = list(range(1, n + 1)), {i: 0.0 for i in range(1, n + 1)}, {}, 0.0
    while len(live) > 1:
        need, k = rng.exponential(), len(live)
        while True:  # the hazard is used up epoch by epoch
            ne, left = size_at(t)
            rate = k * (k - 1) / (4 * ne)
            if need <= rate * left:
                t += need / rate
                break
            need, t = need - rate * left, t + left
        i, j = sorted(rng.choice(k, 2, replace=False), reverse=True)
        new = len(times) + 1
        parent[live.pop(i)], parent[live.pop(j)], times[new] = new, new, t
        live.append(new)
    return [(i, parent.get(i), times[i]) for i in times]


def trees(params: DataFrame, demography: list[tuple[float, float, float]] | None = None, sweep: tuple[float, float, float] | None = None) -> DataFrame:
    """One tree for each row of params (rep, n, ne, seed), n haplotypes.

    demography: (t_start, t_end, ne) with an infinite end last. sweep: (s, h, start) of a directional sweep, whose
    frequency changes the size in steps of a hundredth of ne.
    """

    def size(ne: float):
        if demography:
            return lambda t: next((n, e - t) for s, e, n in demography if s <= t < e)
        if sweep:
            s, h, start = sweep
            p0, step = START, ne / 100

            def at(t: float) -> tuple[float, float]:
                x = math.exp(min(s * (h + (1 - 2 * h) * p0) * (t - start), 700.0))
                p = p0 if t < start else p0 * x / (1 - p0 + p0 * x)
                return (max(ne / (1 + 4 * p * (1 - p) * s), 0.01 * ne) if 1e-6 < p < 1 - 1e-6 else ne), step

            return at
        return lambda t: (ne, math.inf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = draw_tree(np.random.Generator(np.random.Philox(key=[r.seed, r.rep])), r.n, size(r.ne))
                yield pd.DataFrame(found, columns=["node_id", "parent_id", "time"]).astype({"parent_id": "Int64"}).assign(rep=r.rep)[["rep", "node_id", "parent_id", "time"]]

    spread = params.select("rep", "n", "ne", "seed").repartition(params.sparkSession.sparkContext.defaultParallelism, "rep")
    return spread.mapInPandas(run, NODES)


def branches(nodes: DataFrame) -> DataFrame:
    """rep, node_id and span of the branch above each node that has a parent."""
    up = nodes.select("rep", F.col("node_id").alias("parent_id"), F.col("time").alias("above"))
    return nodes.join(up, ["rep", "parent_id"]).select("rep", "node_id", (F.col("above") - F.col("time")).alias("span"))


def mutations(nodes: DataFrame, mu: float, length: int, seed: int = 1) -> DataFrame:
    """rep, node_id, position of Poisson mutations: distinct positions on each branch, though two branches may share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep, node, span in zip(pdf["rep"], pdf["node_id"], pdf["span"]):
                rng = np.random.Generator(np.random.Philox(key=[seed, (rep << 32) + node]))
                k = min(int(rng.poisson(mu * length * span)), length)
                rows += [(rep, node, int(p) + 1) for p in rng.choice(length, k, replace=False)]
            yield pd.DataFrame(rows, columns=["rep", "node_id", "position"]).astype("int64")

    return branches(nodes).mapInPandas(run, "rep long, node_id long, position long")


#: Rounds of doubling, enough for paths of 2^ROUNDS nodes; a longer one is a circle.
ROUNDS = 48


def _doubled(state: DataFrame, step) -> DataFrame:
    """state (rep, node_id, up, ...) after rounds in which step(state, ahead) joins what the node at up holds and up jumps as far again.

    ahead is state with its columns named to_*, joined on by rep and up. Each round's table is written, so its plan
    doesn't grow; there are as many rounds as the longest path has binary digits.
    """
    for _ in range(ROUNDS):
        state = written(state, "doubled")
        if state.filter("up IS NOT NULL").isEmpty():
            return state
        ahead = state.select(F.col("rep"), F.col("node_id").alias("up"), *[F.col(c).alias(f"to_{c}") for c in state.columns if c not in ("rep", "node_id")])
        state = step(state, ahead)
    raise ValueError("the parents form a circle")


def leaf_ranges(nodes: DataFrame) -> DataFrame:
    """rep, node_id, lo, hi, leaf: leaves (time 0) are numbered so that those at or below a node are lo to hi - 1.

    Counts of leaves come from pointer doubling: what lies within twice the distance is what lies within it, and within
    it of each node just that far below. A node's lo is the sum, along its path to the root, of the leaves of earlier
    siblings, by doubling as well. Siblings go by node_id, and a node may have any number of children.
    """
    start = nodes.select("rep", "node_id", F.col("parent_id").alias("up"), F.when(F.col("time") == 0, 1).otherwise(0).cast("long").alias("n"))

    def count(state: DataFrame, ahead: DataFrame) -> DataFrame:
        gain = state.filter("up IS NOT NULL").groupBy("rep", F.col("up").alias("node_id")).agg(F.sum("n").alias("gain"))
        far = state.join(ahead.select("rep", "up", "to_up"), ["rep", "up"], "left").join(gain, ["rep", "node_id"], "left")
        return far.select("rep", "node_id", F.col("to_up").alias("up"), (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n"))

    sizes = _doubled(start, count).select("rep", "node_id", "n")
    placed = nodes.select("rep", "node_id", F.col("parent_id").alias("up"), (F.col("time") == 0).alias("leaf")).join(sizes, ["rep", "node_id"])
    placed = running_sum(placed, ["rep", "up"], ["node_id"], "n", "lo")

    def path(state: DataFrame, ahead: DataFrame) -> DataFrame:
        far = state.join(ahead.select("rep", "up", "to_up", "to_lo"), ["rep", "up"], "left")
        return far.select("rep", "node_id", F.col("to_up").alias("up"), "n", (F.col("lo") + F.coalesce("to_lo", F.lit(0))).alias("lo"), "leaf")

    found = _doubled(placed.select("rep", "node_id", "up", "n", "lo", "leaf"), path)
    return found.select("rep", "node_id", "lo", (F.col("lo") + F.col("n")).alias("hi"), "leaf")


def _spread(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """ranges (rep, lo, hi, ...) with hap_id, a row for each leaf in them; found is leaf_ranges()."""
    leaves = found.filter("leaf").select("rep", F.col("lo").alias("at"), F.col("node_id").alias("hap_id"))
    each = ranges.filter("lo < hi").withColumn("at", F.explode(F.sequence("lo", F.col("hi") - 1)))
    return each.join(leaves, ["rep", "at"]).drop("at", "lo", "hi")


def leaves_below(nodes: DataFrame) -> DataFrame:
    """rep, node_id, hap_id of every leaf at or below every node."""
    found = leaf_ranges(nodes)
    return _spread(found.select("rep", "node_id", "lo", "hi"), found)


def carriers(mutated: DataFrame, found: DataFrame) -> DataFrame:
    """rep, hap_id, position: the haplotypes under a mutation (rep, node_id, position); found is leaf_ranges().

    Ranges of several mutations of a position are united first, so no carrier comes twice.
    """
    held = mutated.join(found, ["rep", "node_id"]).filter("lo < hi").select("rep", "position", F.col("lo").alias("s"), F.col("hi").alias("e"))
    united = merge(held, ["rep", "position"]).select("rep", "position", F.col("s").alias("lo"), F.col("e").alias("hi"))
    return _spread(united, found).select("rep", "hap_id", "position")


def simulate(params: DataFrame, mu: float, length: int, seed: int = 1, demography=None, sweep=None) -> DataFrame:
    """Diploid genotypes (rep, ind_id, position, g) of every replicate."""
    tree = trees(params, demography, sweep).cache()  # replicates' nodes; draws depend on seed and rep alone, so a lost part is drawn again alike
    held = carriers(mutations(tree, mu, length, seed), leaf_ranges(tree))
    return held.groupBy("rep", F.ceil(F.col("hap_id") / 2).alias("ind_id"), "position").agg(F.count("*").alias("g"))


def _levels(start: DataFrame, moves: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The rows of start and all that step(rows, moves) makes of them again and again; moves has a column from_, the node that a move leaves.

    Each level is written, so plans don't grow and no number of rows or levels is too many; rows alike in a level are
    one. A path leaves each node once at most, so more levels mean a circle.
    """
    spark = start.sparkSession
    base, paths, most = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", [], math.inf
    moves = written(moves, "moves")
    near = F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves
    level = start
    while True:
        paths.append(f"{base}/{len(paths)}")
        level.distinct().write.option("compression", "zstd").parquet(paths[-1])
        level = spark.read.schema(start.schema).parquet(paths[-1])
        if level.isEmpty():
            return spark.read.schema(start.schema).parquet(*paths)
        if len(paths) == 16:
            most = moves.select("from_").distinct().count() + 1
        if len(paths) > most:
            raise ValueError("the graph holds a circle")
        level = step(level, near)


def marginal_carriers(edges: DataFrame, points: DataFrame) -> DataFrame:
    """For points (node_id, position) the leaves (hap_id) below that hold the position.

    edges: parent_id, child_id, s, e; a child inherits from its parent on [s, e) only. A leaf is its own parent.
    """
    moves = edges.select(F.col("parent_id").alias("from_"), "child_id", "s", "e")

    def step(rows: DataFrame, moves: DataFrame) -> DataFrame:
        met = (F.col("from_") == F.col("node_id")) & (F.col("position") >= F.col("s")) & (F.col("position") < F.col("e"))
        return rows.join(moves, met).select("top", "position", F.col("child_id").alias("node_id"))

    down = _levels(points.select(F.col("node_id").alias("top"), "position", "node_id"), moves, step)
    leaves = down.join(edges.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")
    return leaves.select(F.col("top").alias("node_id"), "position", F.col("node_id").alias("hap_id")).distinct()


def shape(nodes: DataFrame) -> DataFrame:
    """Height (the time of the oldest node), nodes and leaves of each tree."""
    return nodes.groupBy("rep").agg(F.max("time").alias("height"), F.count("*").alias("n_nodes"), F.count_if(F.col("time") == 0).alias("n_leaves"))


def extract_genotypes(nodes: DataFrame, mutated: DataFrame) -> DataFrame:
    """Diploid genotypes (rep, ind_id, position, g) of supplied trees and their mutations (rep, node_id, position)."""
    held = carriers(mutated, leaf_ranges(nodes))
    return held.groupBy("rep", F.ceil(F.col("hap_id") / 2).alias("ind_id"), "position").agg(F.count("*").alias("g"))


def inherited(nodes: DataFrame, mutated: DataFrame, intervals: DataFrame, samples: DataFrame, n_hap: int) -> DataFrame:
    """(hap_id, position) of a graph's leaves: a node hands its mutations on to children whose intervals hold the position.

    nodes: node_id, parent_id. mutated: node_id, position. intervals: node_id, s, e; a node without any takes all.
    samples: node_id, hap_id, the haplotypes that a fragment leaf stands for; leaves up to n_hap stand for themselves.
    Positions that none or all of the n_hap haplotypes carry are left out.
    """
    up = nodes.filter("parent_id is not null").select("node_id", "parent_id")
    takes = up.join(intervals, "node_id", "left").select(F.col("parent_id").alias("from_"), F.col("node_id").alias("child_id"), F.coalesce("s", F.lit(-(2**62))).alias("s"), F.coalesce("e", F.lit(2**62)).alias("e"))

    def step(rows: DataFrame, moves: DataFrame) -> DataFrame:
        met = (F.col("from_") == F.col("node_id")) & (F.col("position") >= F.col("s")) & (F.col("position") < F.col("e"))
        return rows.join(moves, met).select(F.col("child_id").alias("node_id"), "position")

    below = _levels(mutated.select("node_id", "position"), takes, step)
    leaves = below.join(up.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")
    own = leaves.filter(F.col("node_id") <= n_hap).select(F.col("node_id").alias("hap_id"), "position")
    routed = leaves.filter(F.col("node_id") > n_hap).join(samples, "node_id").filter(F.col("hap_id").between(1, n_hap)).select("hap_id", "position")
    held = own.unionByName(routed).distinct()
    varying = held.groupBy("position").agg(F.count("*").alias("ac")).filter(F.col("ac") < n_hap).select("position")
    return held.join(varying, "position", "left_semi").select("hap_id", "position")


def branch_carriers(nodes: DataFrame, intervals: DataFrame, redirects: DataFrame, points: DataFrame) -> DataFrame:
    """(node_id, position, hap_id): the branches that each haplotype's walk to the root passes at a position.

    redirects: node_id, at, target. From a node the walk goes to the target of the last redirect at or before the
    position, and that branch doesn't count; else on to the parent, if the node's intervals hold the position or there
    are none, and else it ends. points: hap_id, position. The root has no branch.
    """
    far = F.lit(2**62)
    order = Window.partitionBy("node_id").orderBy("at")
    sent = redirects.select("node_id", F.col("at").alias("s"), F.coalesce(F.lead("at").over(order), far).alias("e"), F.col("target").alias("to"), F.lit(False).alias("counts"))
    first = redirects.groupBy("node_id").agg(F.min("at").alias("first"))
    own = nodes.filter("parent_id is not null").join(intervals, "node_id", "left").join(first, "node_id", "left")
    own = own.select("node_id", F.coalesce("s", -far).alias("s"), F.least(F.coalesce("e", far), F.coalesce("first", far)).alias("e"), F.col("parent_id").alias("to"), F.lit(True).alias("counts"))
    rooted = nodes.filter("parent_id is null").select("node_id")
    moves = own.unionByName(sent.join(rooted, "node_id", "left_anti")).filter("s < e").withColumnRenamed("node_id", "from_")

    def step(rows: DataFrame, moves: DataFrame) -> DataFrame:
        met = (F.col("from_") == F.col("node_id")) & (F.col("position") >= F.col("s")) & (F.col("position") < F.col("e"))
        return rows.join(moves, met).select("hap_id", "position", F.col("to").alias("node_id"), F.when(F.col("counts"), F.col("from_")).alias("passed"))

    start = points.select("hap_id", "position", F.col("hap_id").alias("node_id"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("passed"))
    return _levels(start, moves, step).filter("passed IS NOT NULL").select(F.col("passed").alias("node_id"), "position", "hap_id").distinct()


def beneficial(nodes: DataFrame, start: DataFrame, position: int) -> DataFrame:
    """start (rep, start) with the leaf that gets the selected mutation: that of first children, in trees no older than start."""
    first = nodes.filter("parent_id is not null").groupBy("rep", "parent_id").agg(F.min("node_id").alias("child"))
    spark = nodes.sparkSession
    first.createOrReplaceTempView("genealogy_first")
    nodes.filter("parent_id is null").createOrReplaceTempView("genealogy_roots")
    leaf = spark.sql("""
        WITH RECURSIVE down(rep, node_id) AS (
          SELECT rep, node_id FROM genealogy_roots
          UNION ALL
          SELECT d.rep, f.child FROM down d JOIN genealogy_first f ON f.rep = d.rep AND f.parent_id = d.node_id)
        SELECT rep, node_id FROM down""").join(nodes.filter("time = 0").select("rep", "node_id"), ["rep", "node_id"])
    old = nodes.groupBy("rep").agg(F.max("time").alias("height"))
    return start.join(old, "rep").filter(F.col("height") <= F.col("start")).join(leaf, "rep").select("rep", "start", "node_id", F.lit(position).cast("long").alias("position"))
