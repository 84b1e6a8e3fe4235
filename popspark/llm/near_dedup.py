"""Near-deduplication by MinHash signatures in an LSH forest.

Documents of the same shingle set are one node. A node's signature is cut into labels of DEPTH hashes, one label for
each tree, and each tree holds the nodes sorted by label. Nodes whose labels share a prefix of LEAST hashes or more are
candidates. In a first pass over a few trees a node is compared with the first node of its longest run and with its
neighbour in sorted order, so a run of n near copies costs n comparisons, not n^2; the sorted nodes are dealt out by
ranges, which cut runs of any size. Links are confirmed on full shingle sets and joined to components. In a second pass
over all trees runs that hold several components are compared in full: those up to REGION nodes in one task, larger
ones dealt into chunks, and each chunk with nodes outside the run's largest component is compared with all others. The
agreement of whole labels tells which of these may be linked, and full sets are compared for them only.

A pair at similarity 0.8 shares no run of LEAST hashes with chance (1 - 0.8^4)^32, about 5e-8, in runs of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import join_groups, null_safe, partitions, ship, written

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
TREES, DEPTH, LEAST = 32, 8, 4
#: Trees of the first pass.
EARLY = 4
#: Runs over so many nodes are compared in chunks.
REGION = 64
#: Regions with up to so many likely pairs for each node are compared as pairs, others as blocks, so many shared shingles at once.
PAIRS, COLUMNS = 2, 4_000
#: Points of 100 by which two labels may agree less often than sets must be similar.
MARGIN = 15
#: Nodes in a chunk of a large run, and shingles of its nodes, on average at most.
CHUNK, WEIGHT = 1024, 1_000_000
#: Words that a task remembers, and letters of a remembered word at most.
REMEMBERED, LETTERS = 100_000, 32
#: Tables up to so many rows are broadcast.
FEW = 200_000
#: Shingles that are sent on at once.
SENT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of texts in lower case whose white space is blanks."""

    def __init__(self, words: int = SHINGLE):
        rng = np.random.default_rng(20240501)
        self.words = words
        self.odd = rng.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        known, of = self.known, xxhash.xxh3_64_intdigest
        if len(known) > REMEMBERED:
            known.clear()
        long: dict[str, int] = {}
        for w in set(words).difference(known):
            (known if len(w) <= LETTERS else long)[w] = of(w.encode("utf-8", "surrogatepass"))
        get = known.__getitem__ if not long else (known | long).__getitem__
        return np.fromiter(map(get, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        words = [w for w in text.split(" ") if w] if text else []
        if not words:
            return np.empty(0, np.uint64)
        return np.unique(self.runs(words))

    def runs(self, words: list[str]) -> np.ndarray:
        """The hash of the shingle that begins at each word, as far as there are whole ones."""
        h, k = self.hashes(words), min(self.words, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out += h[i : len(h) - k + 1 + i] * self.odd[i]
            out ^= out >> np.uint64(30)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(27)
            out *= np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(31)
        return out


class Signer:
    """MinHash labels: for each tree DEPTH hashes of 16 bits, packed into two signed 64-bit numbers."""

    def __init__(self, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = trees * DEPTH
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(x), 1024):
                h = np.multiply.outer(self.a, x[at : at + 1024])
                h += self.b[:, None]
                np.minimum(low, h.min(axis=1), out=low)
            low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
        parts = (low >> np.uint32(16)).astype(np.uint64).reshape(-1, 4)
        return ((parts[:, 0] << np.uint64(48)) | (parts[:, 1] << np.uint64(32)) | (parts[:, 2] << np.uint64(16)) | parts[:, 3]).view(np.int64)


def _node(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def plain(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _sign(words: int, trees: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, signer = Shingles(words), Signer(trees)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles.of(text)
                rows.append((len(s), _node(s), signer.of(s)) if len(s) else (0, None, None))
            found = pd.DataFrame(rows, columns=["n_shingles", "node", "labels"], index=pdf.index)
            yield pd.concat([pdf.drop(columns="text").astype({"doc_id": "Int64"}), found], axis=1)

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for pdf in batches:
            found: list[np.ndarray] = []
            for text in [*pdf["text"], None]:
                if found and (text is None or sum(map(len, found)) > SENT):
                    yield pd.DataFrame({"node": [_node(s) for s in found], "shingles": [s.view(np.int64) for s in found]})
                    found = []
                if text:
                    found += [s for s in [shingles.of(text)] if len(s)]

    return run


def _similar(na, nb, percent: int):
    """Sizes that allow two sets to be similar enough."""
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _by_run(keys: list[str], out):
    """mapInArrow over rows sorted by keys, all rows of a key in one partition: out(rows) for whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            fresh = _starts(pdf, keys)
            at = int(np.flatnonzero(fresh)[-1])  # the last key may go on in the next batch
            if at:
                yield out(pdf.iloc[:at].reset_index(drop=True))
            rest = pdf.iloc[at:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield out(rest)

    return run


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    fresh = np.ones(len(pdf), bool)
    fresh[1:] = False
    for k in keys:
        x = pdf[k].to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return fresh


PAIR = "a binary, b binary, region long, root long"


def _batch(pdf: pd.DataFrame, pairs: list[tuple[np.ndarray, np.ndarray]], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs of rows; and the members of blocks, each with a name that blocks of the same nodes share, and no b."""
    import xxhash

    size, node = len(pdf), pdf["node"].to_numpy()
    code = np.unique(np.concatenate([np.zeros(0, np.int64)] + [np.minimum(i, j) * size + np.maximum(i, j) for i, j in pairs]))
    names = [xxhash.xxh3_64_intdigest(b"".join(sorted(node[x]))) for x in blocks]
    member = np.concatenate([np.zeros(0, np.int64), *blocks])
    name = np.repeat(np.array(names, np.uint64), list(map(len, blocks))).view(np.int64)
    both, at = pa.array(node, pa.binary()), np.concatenate([code // size, member])
    b = pa.concat_arrays([both.take(pa.array(code % size)), pa.nulls(len(member), pa.binary())])
    region = pa.concat_arrays([pa.nulls(len(code), pa.int64()), pa.array(name)])
    return pa.RecordBatch.from_arrays([both.take(pa.array(at)), b, region, pa.array(pdf["root"].to_numpy()[at])], ["a", "b", "region", "root"])


def _nearest_pairs(percent: int):
    """Of rows sorted by tree, hi and lo each with the first of the longest prefix it shares and with the one before it.

    All that the next rows need of those before are the first row at each depth and the last row, so a task holds one
    batch of a run at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            old = 0 if carried is None else len(carried)
            pdf = pdf if carried is None else pd.concat([carried, pdf], ignore_index=True)
            root, n, idx = pdf["root"].to_numpy(), pdf["n"].to_numpy(), np.arange(len(pdf))
            fresh, lo, deepest, firsts = _starts(pdf, ["tree", "hi"]), pdf["lo"].to_numpy().view(np.uint64), idx.copy(), {len(pdf) - 1}
            for k in range(LEAST, DEPTH + 1):
                start = fresh.copy()
                if k > LEAST:
                    cut = lo >> np.uint64(16 * (DEPTH - k))
                    start[1:] |= cut[1:] != cut[:-1]
                first = np.maximum.accumulate(np.where(start, idx, 0))
                deepest = np.where(first != idx, first, deepest)
                firsts.add(int(first[-1]))
            new = idx >= old
            yield _batch(pdf, [(idx[may], lead[may]) for lead in (deepest, np.where(fresh, idx, idx - 1)) for may in [new & (root != root[lead]) & _similar(n, n[lead], percent)]], [])
            carried = pdf.iloc[sorted(firsts)].reset_index(drop=True)

    return run


def _plausible(percent: int):
    """Of whole regions what may be linked by the agreement of labels: as pairs, or as a block if most may be with most."""

    def out(pdf: pd.DataFrame) -> pa.RecordBatch:
        edge = np.append(np.flatnonzero(_starts(pdf, ["region"])), len(pdf)).tolist()
        root, n = pdf["root"].to_numpy(), pdf["n"].to_numpy()
        hashes = np.stack(pdf["labels"].to_list()).view(np.uint16)
        least, pairs, blocks = (percent - MARGIN) * hashes.shape[1] / 100, [], []
        for f, e in zip(edge[:-1], edge[1:]):
            own, met = hashes[f:e], []
            for at in range(0, e - f, 16):
                agree = (own[at : at + 16, None, :] == own[None, :, :]).sum(axis=2)
                i, j = np.nonzero(agree >= least)
                met.append(np.c_[i + at, j])
            i, j = np.concatenate(met).T + f
            may = (i < j) & (root[i] != root[j]) & _similar(n[i], n[j], percent)
            i, j = i[may], j[may]
            members = np.union1d(i, j)
            if len(i) > PAIRS * len(members):
                blocks.append(members)
            else:
                pairs.append((i, j))
        return _batch(pdf, pairs, blocks)

    return _by_run(["region"], out)


def _forest(linked: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of a region, a symmetric matrix, those that join its groups as all of them do: one for each group joined."""
    seen, kept = np.zeros(group.max(initial=-1) + 1, bool), []
    for start in range(len(group)):
        if seen[group[start]]:
            continue
        seen[group[start]] = True
        ahead = np.flatnonzero(group == group[start]).tolist()
        while ahead:
            i = ahead.pop()
            j = np.flatnonzero(linked[i] & ~seen[group])
            new, first = np.unique(group[j], return_index=True)
            if len(new):
                kept += [(i, int(x)) for x in j[first]]
                seen[new] = True
                ahead += np.flatnonzero(np.isin(group, new)).tolist()
    return kept


def _block_links(percent: int):
    """Links that join the roots in each region: the shared shingles of all its nodes at once, as products of incidence.

    All pairs are compared; of their links a spanning forest of the roots goes out, as components need no more, so rows
    out grow as the nodes and not as their pairs.
    """

    def out(pdf: pd.DataFrame) -> pa.RecordBatch:
        edge = np.append(np.flatnonzero(_starts(pdf, ["region"])), len(pdf)).tolist()
        root, node, links = pdf["root"].to_numpy(), pdf["node"].to_numpy(), []
        for f, e in zip(edge[:-1], edge[1:]):
            sets = [np.asarray(x) for x in pdf["shingles"].iloc[f:e]]
            n = np.array([len(x) for x in sets])
            _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            often = np.cumsum(times > 1) - 1
            code, who = code.ravel(), np.repeat(np.arange(e - f), n)
            keep = times[code] > 1
            code, who = often[code[keep]], who[keep]
            shared = np.zeros((e - f, e - f), np.float32)
            for at in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
                part = (code >= at) & (code < at + COLUMNS)
                held = np.zeros((e - f, COLUMNS), np.float32)
                held[who[part], code[part] - at] = 1
                shared += held @ held.T
            linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
            links += [(node[f + i], node[f + j]) for i, j in _forest(linked, np.unique(root[f:e], return_inverse=True)[1])]
        return pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.binary()), pa.array([min(x) for x in links], pa.binary())], ["a", "b"])

    return _by_run(["region"], out)


def _joined(left: DataFrame, groups: DataFrame, key: list[str], n: str, limit: int = FEW) -> DataFrame:
    """Inner join of rows to a written table of groups, with n rows of left each: by broadcast up to limit groups."""
    if groups.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(groups), key)
    return join_groups(left, groups, key, n, groups.agg(F.sum(n)).first()[0])


def _labelled(nodes: DataFrame, trees: int) -> DataFrame:
    """A row for each node and tree: tree, hi and lo (its label), node, n, root."""
    rows = nodes.select("node", "n", "root", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return rows.select("tree", F.expr("labels[2 * tree]").alias("hi"), F.expr("labels[2 * tree + 1]").alias("lo"), "node", "n", "root")


def _distinct_pairs(found: DataFrame) -> DataFrame:
    b = F.when(F.col("region").isNull(), F.least("a", "b"))
    return written(found.select(F.greatest("a", "b").alias("a"), b.alias("b"), "region", F.when(F.col("region").isNotNull(), F.col("root")).alias("root")).distinct(), "pairs")


def nearest_candidates(nodes: DataFrame, trees: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of neighbours in the sorted orders of the first trees. nodes: node, n, root, labels.

    The rows are dealt out by ranges of label and node, so no run, however large, lies in one task; where a range cuts a
    run, its parts are compared apart in this order.
    """
    order = ["tree", "hi", "lo", "node"]
    rows = _labelled(nodes, trees).repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return _distinct_pairs(rows.mapInArrow(_nearest_pairs(percent), PAIR))


def candidates(nodes: DataFrame, trees: int, region: int = REGION, limit: int = FEW) -> DataFrame:
    """Regions of nodes that share a run of LEAST hashes in one of the trees. nodes: node, n, root, labels.

    Rows are members of regions: region, node, n, root; any two nodes of different roots that share a run are in a
    region together. Runs of one root are left out by sums that are made before the shuffle, and runs over region nodes
    are dealt into chunks, so no task holds a run of any size.
    """
    key = ["tree", "hi"]
    rows = _labelled(nodes, trees).drop("lo")
    runs = rows.groupBy(*key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).filter("r0 <> r1")
    runs = written(runs.select(*key, "size"), "runs")
    held = written(_joined(rows, runs, key, "size", limit), "members")
    found = held.filter(F.col("size") <= region).select(F.xxhash64(*key).alias("region"), "node", "n", "root")
    wide = held.filter(F.col("size") > region).drop("size")
    if wide.isEmpty():
        return found
    # What isn't of the largest component, in chunks, against all chunks.
    by_root = written(wide.groupBy(*key, "root").agg(F.count("*").alias("c"), F.sum("n").alias("w")), "wide")
    tops = written(by_root.groupBy(*key).agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("size"), F.sum("w").alias("weight")), "wide")
    placed = _joined(wide, tops, key, "size", limit).withColumn("main", F.col("root") == F.col("top.root"))
    chunks = lambda c, w: F.ceil(F.greatest(c / CHUNK, w / WEIGHT))
    strays, mains = chunks(F.col("size") - F.col("top.c"), F.col("weight") - F.col("top.w")), chunks(F.col("top.c"), F.col("top.w"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), mains).otherwise(strays))
    to = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    block = lambda kind, x, y: F.xxhash64(*key, F.lit(kind), x, y)
    stray_blocks = F.concat(to(strays, lambda j: block("s", F.least(own, j), F.greatest(own, j))), to(mains, lambda j: block("m", own, j)))
    regions = F.when(F.col("main"), to(strays, lambda j: block("m", j, own))).otherwise(stray_blocks)
    return found.unionByName(placed.select(F.explode(regions).alias("region"), "node", "n", "root"))


def plausible(regions: DataFrame, nodes: DataFrame, percent: int = PERCENT, limit: int = FEW) -> DataFrame:
    """Of regions the pairs (a, b) whose labels agree often enough, or members a of a smaller region without b.

    Labels of 256 hashes take a sixteenth of the room of full sets. A pair at the threshold agrees on MARGIN points
    less with chance 1e-9, so next to none is lost here.
    """
    wanted = written(regions.select("node").distinct(), "wanted")
    few = wanted.limit(limit + 1).count() <= limit
    labels = nodes.select("node", "labels").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    rows = regions.join(labels, "node").repartition(partitions(nodes.sparkSession), "region").sortWithinPartitions("region")
    return _distinct_pairs(rows.mapInArrow(_plausible(percent), PAIR))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, limit: int = FEW) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. b may be in many pairs: its set is dealt out to salted keys.

    Up to limit pairs are broadcast to the sets, which are larger.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(4 * partitions(pairs.sparkSession)))
    pairs = pairs.withColumn("salt", salt)
    sent = F.broadcast if pairs.limit(limit + 1).count() <= limit else lambda df: df
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(sent(pairs), "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(sent(pairs.select("b", "salt").distinct()), "b")
    both = left.join(right, ["b", "salt"]).withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def components(links: DataFrame, limit: int = FEW) -> DataFrame:
    """Connected components by alternating large and small stars: rows (node, root) for every node that isn't its root.

    links has columns a and b. Each step is a sum by node and a join to it; edges are written after each step.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    total = edges.count()

    def to_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        return rows.join(F.broadcast(least), "u") if n <= limit else join_groups(rows, written(least, "least"), ["u"], "size", n)

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v0"), F.count("*").alias("size")).select("u", F.least("u", "v0").alias("m"), "size")
        large = to_least(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = to_least(large, least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        left = after.count()
        if left == total and after.exceptAll(edges).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, total = after, left


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, region: int = REGION, limit: int = FEW, row: str | None = None) -> DataFrame:
    """Components of documents whose sets of word shingles are similar: doc_id, n_shingles, component_id, kept.

    A-Z count as a-z. A text of fewer words than a shingle is one shingle; null texts and texts without words have
    none and are linked with nothing. component_id is the smallest doc_id that links reach; kept says that it is the
    document's own. Repeated rows share their component, and each row whose doc_id is the smallest is kept; a null
    doc_id is the smallest only of a component that has no other. An empty table gives an empty result. Whatever else
    docs holds is left alone, and its names don't matter. Tables of nodes are broadcast up to limit rows.

    row names a binary column that tells rows apart and goes into the result; kept then says that the row has the
    smallest (doc_id, row) of its component, so that one row of each stays, and every row that is linked with nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    more = [] if row is None else ["row"]
    own = [F.col(doc_id).cast("long").alias("doc_id")] + [F.col(row).alias("row") for _ in more]
    texts = docs.select(*own, plain(F.col(text)).alias("text"))
    kinds = "doc_id long, " + "row binary, " * len(more)
    signed = written(texts.mapInPandas(_sign(words, trees), kinds + "n_shingles long, node binary, labels array<long>"), "signed")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", *more)
    held = signed.filter("node is not null")
    sums = [F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min(place).alias("place"), F.first("labels").alias("labels")]
    nodes = written(held.groupBy("node").agg(*sums), "nodes")

    def links(found: DataFrame) -> DataFrame:
        """The candidates that are similar. Full sets are made of their texts only, which are read again."""
        pairs, members = found.filter("region is null").select("a", "b"), found.filter("region is not null")
        wanted = found.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = written(wanted.join(nodes, "node").select(null_safe(F.col("least"))[0].alias("key")).distinct(), "wanted")
        few = wanted.limit(limit + 1).count() <= limit
        again = texts.withColumn("key", null_safe(F.col("doc_id"))[0]).join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
        sets = again.select("text").mapInPandas(_sets(words), "node binary, shingles array<long>").dropDuplicates(["node"])
        sets = written(sets, "sets")
        blocks = members.select("region", F.col("a").alias("node"), "root").join(sets, "node").repartition(partitions(spark), "region").sortWithinPartitions("region")
        return written(confirm(pairs, sets, percent, limit).unionByName(blocks.mapInArrow(_block_links(percent), "a binary, b binary")).distinct(), "links")

    # First each node's nearest candidates in a few trees, which join most groups; then all trees, but no pairs of one component.
    bare = nodes.select("node", "n", "labels")
    found = links(nearest_candidates(bare.withColumn("root", F.xxhash64("node")), min(EARLY, trees), percent))
    roots = components(found, limit)
    few = roots.limit(limit + 1).count() <= limit
    rooted = bare.join(F.broadcast(roots) if few else roots, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node")))
    extra = links(plausible(candidates(rooted, trees, region, limit), nodes, percent, limit))
    if not extra.isEmpty():
        roots = components(found.unionByName(extra), limit)
    # Nodes that are linked, or are the sets of several rows; each other row is a component of its own.
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    few = grouped.limit(limit + 1).count() <= limit
    known = nodes.drop("labels").join(F.broadcast(grouped) if few else grouped, "node", "left").filter("size > 1 or root is not null")
    known = written(known.withColumn("root", F.coalesce("root", "node")), "known")
    tops = written(known.groupBy("root").agg(F.min("least").alias("component_id"), F.min("place").alias("top"), F.count("*").alias("nodes")), "tops")
    named = written(_joined(known.drop("place"), tops, ["root"], "nodes", limit).select("node", "component_id", "top", "size"), "named")
    few = named.limit(limit + 1).count() <= limit
    rest = signed.drop("labels").join(F.broadcast(named.select("node")) if few else named.select("node"), "node", "left_anti")
    joined = _joined(held.drop("labels"), named, ["node"], "size", limit)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) if row is None else place.eqNullSafe(F.col("top"))
    out = ["doc_id", *more, "n_shingles"]
    return joined.select(*out, "component_id", kept.alias("kept")).unionByName(rest.select(*out, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
