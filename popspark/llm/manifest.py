"""A Merkle manifest of a table: a digest for each row, a tree over each group of rows, and a tree over the groups.

Rows are ranked within their group by ranges, so a group of any size spans many tasks. A tree is built in rounds: each
round cuts the nodes of a group into aligned blocks of fanout^levels and folds each block to one node in one task, as
contiguous numpy matrices of digests in hex. After the last round the way back hands every node its siblings: those in
its block by index arithmetic, and those of the block's own node, which all nodes of the block share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.llm.common import BROADCAST_ROWS, null_safe, partitions, ship, written

FANOUT = 8
#: Levels of the tree that one task folds: blocks hold FANOUT^LEVELS nodes at most.
LEVELS = 4
#: Bytes of a digest in hex.
HEX = 64


def digest(*fields: Column) -> Column:
    """SHA-256 of fields in order, in lower-case hex; each is `-` if null, else its length in bytes, `:` and its value."""
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def matrix(digests: list[str]) -> np.ndarray:
    """Digests as the rows of a matrix of bytes."""
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, HEX)


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The level above: whole runs are rows of a reshaped matrix; the last run may be shorter."""
    whole = len(nodes) // fanout
    runs = [*nodes[: whole * fanout].reshape(whole, fanout * HEX)]
    if whole * fanout < len(nodes):
        runs.append(nodes[whole * fanout :].reshape(-1))
    return matrix([hashlib.sha256(r.data).hexdigest() for r in runs])


def levels_above(nodes: np.ndarray, steps: int | None, fanout: int) -> list[np.ndarray]:
    """Every level of a block from the given nodes up to one node; exactly steps levels up if steps is given."""
    out = [nodes]
    while len(out[-1]) > 1 if steps is None else len(out) <= steps:
        out.append(_parents(out[-1], fanout))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, list[list[str]]]:
    """For each node of the lowest level its place in its run (from 0) and the others of the run, joined, at each level below the top."""
    n = len(levels[0])
    slots, joined = np.zeros((n, len(levels) - 1), np.int32), []
    for height, level in enumerate(levels[:-1]):
        at = np.arange(n) // fanout**height
        slots[:, height] = at % fanout
        others = np.arange(fanout - 1) + (np.arange(fanout - 1) >= slots[:, height, None]) + (at - at % fanout)[:, None]
        size = (others < len(level)).sum(axis=1) * HEX  # only the last run is short, and what it lacks is its end
        rows = level[np.minimum(others, len(level) - 1)].reshape(n, -1).tobytes().decode("ascii")
        width = (fanout - 1) * HEX
        joined.append([rows[i * width : i * width + s] for i, s in enumerate(size.tolist())])
    return slots, [list(x) for x in zip(*joined)] if joined else [[] for _ in range(n)]


def fold(leaf: str, slots: list[int], proof: list[str]) -> str:
    """The root that a leaf and its siblings give: at each level the digest is put at its place in the run and hashed."""
    for slot, others in zip(slots, proof):
        leaf = hashlib.sha256((others[: HEX * slot] + leaf + others[HEX * slot :]).encode("ascii")).hexdigest()
    return leaf


def folded(leaf: Column, slots: Column, proof: Column) -> Column:
    """fold() on columns."""

    @F.pandas_udf("string")
    def run(leaf: pd.Series, slots: pd.Series, proof: pd.Series) -> pd.Series:
        return pd.Series([fold(*x) for x in zip(leaf, slots, proof)], dtype=object)

    return run(leaf, slots, proof)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with rank (from 0) in their group by order, nulls first, and n, its size; and a row (group, n) for each group.

    Rows are dealt out by ranges of group and order and numbered in each; the sizes of the ranges before are added. Rows
    that are equal in both are told apart by where they were read, so they too spread over ranges.
    """
    spark = rows.sparkSession
    turn = rows.withColumn("turn", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "turn")]
    sorted_ = turn.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = sorted_.withColumn("at", F.monotonically_increasing_id()).drop("turn")
    placed = written(placed.withColumns({"part": F.shiftrightunsigned("at", 33), "key": F.concat_ws("\n", F.lit("g"), *null_safe(*map(F.col, group)))}), "ranked")
    starts = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"), *[F.first(c).alias(c) for c in group])
    starts = written(starts, "starts")  # ranges and groups in number
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = starts.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(own).alias("n"))
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = placed.join(F.broadcast(offsets) if few else offsets, ["key", "part"])
    groups = starts.groupBy("key").agg(F.sum("held").alias("n"), *[F.first(c).alias(c) for c in group]).drop("key")
    return out.withColumn("rank", F.col("at") + F.col("shift")).drop("key", "part", "at", "shift"), groups


def _tops(fanout: int, levels: int):
    block = fanout**levels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = int(pdf["n"].iloc[0])
        top = levels_above(matrix(pdf["digest"].tolist()), levels if n > block else None, fanout)[-1]
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "rank": pdf["rank"].iloc[:1] // block, "n": [-(-n // block)], "digest": [top.tobytes().decode("ascii")]})

    return run


def _paths(fanout: int, levels: int, keep: list[str]):
    block = fanout**levels

    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=[*keep, "slots", "proof", "subroot", "root"])
        nodes, top = nodes.sort_values("rank"), above.iloc[0]
        n = int(nodes["n"].iloc[0])
        slots, joined = siblings(levels_above(matrix(nodes["digest"].tolist()), levels if n > block else None, fanout), fanout)
        rest, more = list(top["slots"]), list(top["proof"])
        return nodes[keep].assign(slots=[[*s, *rest] for s in slots.tolist()], proof=[[*p, *more] for p in joined], subroot=top["subroot"], root=top["root"])

    return run


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of a forest: first nodes (g, rank, n, digest, ...), then their blocks' nodes and so on, until each g has one."""
    rounds, block = [nodes], F.lit(fanout**levels)
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        keyed = rounds[-1].select("g", "rank", "n", "digest", F.floor(F.col("rank") / block).alias("block"))
        tops = keyed.groupBy("g", "block").applyInPandas(_tops(fanout, levels), "g long, rank long, n long, digest string")
        rounds.append(written(tops, "tops"))
        most = -(-most // fanout**levels)
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, keep: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The nodes of the first round (columns keep) with slots and proof up to the root, subroot and root.

    above has g, slots, proof, subroot and root of each g's last node.
    """
    known = above.withColumn("rank", F.lit(0).cast("long"))
    for at in range(len(rounds) - 2, -1, -1):
        nodes = rounds[at].withColumn("block", F.floor(F.col("rank") / F.lit(fanout**levels)))
        held = keep if at == 0 else ["g", "rank"]
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in held), "slots array<int>, proof array<string>, subroot string, root string"])
        blocks = known.select("g", F.col("rank").alias("block"), "slots", "proof", "subroot", "root")
        # One row of blocks meets at most a block of nodes, so no group grows with the table.
        known = nodes.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInPandas(_paths(fanout, levels, held), schema)
        known = written(known, "paths") if at else known
    return known if len(rounds) > 1 else rounds[0].join(above, "g").select(*keep, "slots", "proof", "subroot", "root")


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", keep: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each row of docs: order, further columns keep, leaf, subroot, root, and its proof.

    leaf is the digest of fields in order. In each group leaves ascend by order (null first; ties by digest); while
    there are several nodes, each fanout consecutive ones become their digest, the last run with what is left, even
    one. What remains is the group's subroot; subroots, ordered by group (null first, by bytes), give the root alike.
    proof has a string for each level from the leaf up to the root, the joined others of the node's run, and slots its
    place in it; fold(leaf, slots, proof) is root.

    Repeated rows are leaves of their own, next to each other. An empty table gives an empty result, and a table of one
    row its leaf as root. Texts of any length are hashed whole, within Spark. Columns of docs that aren't named aren't
    read; clashing names of those that are (leaf, root and so on) are no matter, as all get names of their own first.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or []
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], digest(*map(F.col, fields)).alias("digest"))
    leaves, groups = ranked(written(rows, "leaves"), ["grp"], ["ord", "digest"])
    numbered, _ = ranked(groups.withColumnRenamed("n", "size"), [], ["grp"])
    numbered = written(numbered.select(F.col("rank").alias("g"), "grp"), "groups")
    few = numbered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col("x.grp").eqNullSafe(F.col("y.grp"))
    joined = leaves.alias("x").join((F.broadcast(numbered) if few else numbered).alias("y"), same).select("x.*", "y.g")
    rounds = climb(written(joined.drop("grp"), "nodes"), fanout, levels)
    tops = written(rounds[-1].select("g", "digest"), "subroots")
    # The groups' own tree: its one group is 0, and g is the rank of a subroot in it.
    n = tops.count()
    upper = climb(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(n).cast("long").alias("n"), "digest"), fanout, levels)
    root = upper[-1].select("g", F.array().cast("array<int>").alias("slots"), F.array().cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = descend(upper, root, ["rank", "digest"], fanout, levels).select(F.col("rank").alias("g"), "slots", "proof", F.col("digest").alias("subroot"), "root")
    found = descend(rounds, written(above, "above"), ["ord", *[f"keep_{i}" for i in range(len(keep))], "digest"], fanout, levels)
    return found.select(F.col("ord").alias(order), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("digest").alias("leaf"), "subroot", "root", "slots", "proof")
