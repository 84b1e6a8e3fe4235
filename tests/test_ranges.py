"""Scans and sweeps over ranges, trees by doubling, bitmaps, ranks and the VCF source against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import bitmaps, ranges
from popspark.operators import intervals as I
from popspark.operators import stats as S
from popspark.operators import tiles
from popspark.plans import genealogy as P
from popspark.sources import vcf

IV = "id long, s long, e long"


def _intervals(seed: int, n: int) -> list[tuple]:
    """One id holds a third of the rows; some intervals cover nearly everything, some are empty, some are the same."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        s = rng.randrange(1000)
        rows.append((0 if rng.random() < 1 / 3 else rng.randrange(12), s, s + rng.choice([0, 1, 3, 10, 10, 40, 5000 if rng.random() < 0.05 else 2])))
    return [*rows, *rows[:5], (3, 0, 10_000), (0, 0, 9_000)]


def _merged(rows: list[tuple]) -> dict[int, list[list[int]]]:
    out: dict[int, list[list[int]]] = {}
    for i, s, e in sorted(rows):
        own = out.setdefault(i, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return out


@pytest.mark.parametrize("n", [0, 1, 40, 600])
def test_intervals_equal_loops(spark, n):
    rows = _intervals(n, n) if n > 1 else [(1, 2, 3)] * n
    table, rng = spark.createDataFrame(rows, IV), random.Random(5)
    want = _merged(rows)
    assert sorted(map(tuple, I.merge(table).collect())) == sorted((i, s, e) for i, own in want.items() for s, e in own)
    kept = [r for r in rows if r[1] < r[2]]
    pairs: dict[tuple, int] = {}
    for k, (i, s, e) in enumerate(kept):
        for j, s2, e2 in kept[k + 1 :]:
            if i != j and s < e2 and s2 < e:
                pairs[min(i, j), max(i, j)] = pairs.get((min(i, j), max(i, j)), 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in I.overlapping(table).collect()} == pairs
    assert list(map(tuple, I.first_overlap(table).collect())) == ([min(pairs)] if pairs else [])
    points = [(rng.randrange(13), rng.randrange(1100), k) for k in range(200)]
    marks = sorted({(i, s, e) for i, s, e in rows})
    got = I.as_of(spark.createDataFrame(points, "id long, position long, k int"), spark.createDataFrame(marks, "id long, at long, target long"))
    last = lambda i, p: max(((at, t) for j, at, t in marks if j == i and at <= p), default=(0, None))[1]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, p, k, last(i, p))) for i, p, k in points)
    draws = [(i, rng.random()) for i in want for _ in range(20)]
    clipped = {i: [x for s, e in own for x in range(max(s, 1), min(e, 801))] for i, own in want.items()}
    aimed = [(i, len(clipped[i]), clipped[i][int(u * len(clipped[i]))]) for i, u in draws if clipped[i]]
    got = I.sample_position(I.merge(table), spark.createDataFrame(draws, "id long, u double"), 800)
    assert sorted(map(tuple, got.collect())) == sorted(aimed)


def test_a_long_interval_has_a_row_for_each_range_at_most(spark):
    rows = [(i, 10 * i, 10 * i + 5) for i in range(4000)] + [(9999, 0, 10**9)]
    table = spark.createDataFrame(rows, IV)
    dealt = I._dealt(table)
    assert dealt.count() < 4001 + 3 * 8 and dealt.filter("id = 9999").count() <= 8
    assert I.overlapping(table).count() == 4000 and tuple(I.first_overlap(table).first()) == (0, 9999)


def test_a_hot_id_spans_ranges(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).cast("long").alias("id"), (F.col("id") * 2).alias("s"), (F.col("id") * 2 + 1).alias("e"))
    sizes = [r["count"] for r in ranges.ranged(rows, ["id"], ["s", "e"]).groupBy(ranges.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 8000
    assert I.merge(rows).count() == 30_000 and I.merge(rows.withColumn("e", F.col("e") + 3)).filter("id = 7").count() == 1


def test_running_sums_of_null_groups(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1), (None, 3, 1)], "g string, o int, v int")
    got = {(r["g"], r["o"]): r["t"] for r in ranges.running_sum(rows, ["g"], ["o"], "v", "t").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", 1): 0, (None, 3): 12}


def test_leaves_of_a_deep_comb(spark):
    depth = 10_000  # leaf k hangs from inner node k; inner nodes form a path
    inner = spark.range(depth).select(F.lit(0).cast("long").alias("rep"), (F.col("id") + depth).alias("node_id"), F.when(F.col("id") > 0, F.col("id") + depth - 1).alias("parent_id"), (depth - F.col("id")).cast("double").alias("time"))
    leaves = spark.range(depth).select(F.lit(0).cast("long").alias("rep"), F.col("id").alias("node_id"), (F.col("id") + depth).alias("parent_id"), F.lit(0.0).alias("time"))
    found = P.leaf_ranges(inner.unionByName(leaves))
    sizes = {r["node_id"]: r["n"] for r in found.select("node_id", (F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert all(sizes[k] == 1 and sizes[k + depth] == depth - k for k in range(depth))
    mutated = spark.createDataFrame([(0, 2 * depth - 3, 5), (0, 4, 5), (0, 2 * depth - 2, 5), (0, 7, 6)], "rep long, node_id long, position long")
    assert sorted((r["hap_id"], r["position"]) for r in P.carriers(mutated, found).collect()) == [(4, 5), (7, 6), (depth - 3, 5), (depth - 2, 5), (depth - 1, 5)]


def test_leaves_of_random_trees(spark):
    rng, rows, below = random.Random(6), [], {}
    for rep in range(3):
        parent = {k: rng.randrange(max(0, k - 6), k) for k in range(2, 60)}  # two roots, 0 and 1, and any number of children
        inner = set(parent.values())
        for k in range(60):
            leaf = k not in inner
            rows.append((rep, k, parent.get(k), 0.0 if leaf else 1.0))
            at = k if leaf else None
            while at is not None:
                below.setdefault((rep, at), set()).add(k)
                at = parent.get(at)
    nodes = spark.createDataFrame(rows, P.NODES).repartition(4)
    got: dict = {}
    for r in P.leaves_below(nodes).collect():
        got.setdefault((r["rep"], r["node_id"]), set()).add(r["hap_id"])
    assert got == below and P.leaf_ranges(nodes.filter("false")).collect() == []


def test_a_circle_of_parents_is_refused(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 4)
    with pytest.raises(ValueError):
        P.leaf_ranges(spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 1, 1.0)], P.NODES))


@pytest.mark.parametrize("n", [5, 70])
def test_bitmaps_keep_dosages(spark, n):
    rng = np.random.default_rng(n)
    m = rng.integers(0, 3, (n, 30)) * (rng.random((n, 30)) < 0.5)
    m[:, 3], m[:, 4] = 0, 2
    rows = [(int(i) * 3, int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    genotypes = spark.createDataFrame(rows, "ind_id long, position long, g long")
    people, _ = tiles.people_of(spark.range(n).select((F.col("id") * 3).alias("ind_id")))
    built = bitmaps.build(genotypes, people)
    assert sorted(map(tuple, bitmaps.unpack(built, people).collect())) == sorted(rows)
    cells = spark.range(n * 30).select((F.col("id") % n).cast("int").alias("r"), F.floor(F.col("id") / n).alias("position"))
    assert all(x["g"] == m[x["r"], x["position"]] for x in bitmaps.lookup(cells, built).collect())
    varying = [j for j in range(30) if m[:, j].std() > 0]
    want = {(i, j): pytest.approx(np.corrcoef(m[:, i], m[:, j])[0, 1], abs=1e-12) for i in varying for j in varying if i < j}
    for block in (256, 7):
        assert {(x["pos_i"], x["pos_j"]): x["r"] for x in bitmaps.correlations(built, n, block).collect()} == want
    assert bitmaps.correlations(built.filter("false"), n).collect() == []


def test_bitmaps_of_several_buckets(spark):
    n = bitmaps.BUCKET + 100  # sites 1 and 2 share carriers in the second bucket, 3 has some in the first alone
    held = [(bitmaps.BUCKET + k, p, 1 + (k + p) % 2) for p in (1, 2) for k in range(0, 100, p + 1)] + [(k, 3, 1) for k in range(50)] + [(5, 1, 2)]
    people = spark.range(n).select(F.col("id").alias("ind_id"), F.col("id").cast("int").alias("r"))
    built = bitmaps.build(spark.createDataFrame(held, "ind_id long, position long, g long"), people)
    m = np.zeros((n, 4))
    for i, p, g in held:
        m[i, p] = g
    got = {(x["pos_i"], x["pos_j"]): x["r"] for x in bitmaps.correlations(built, n).collect()}
    assert got == {(i, j): pytest.approx(np.corrcoef(m[:, i], m[:, j])[0, 1], abs=1e-12) for i, j in ((1, 2), (1, 3), (2, 3))}
    assert sorted(map(tuple, bitmaps.unpack(built, people).collect())) == sorted(held)


def test_ranks_of_any_type(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abcdef"), rng.random(), k) for k in range(300)]
    place = lambda c: {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[c], r[2])))}
    a, b = place(0), place(1)
    table = spark.createDataFrame(rows, "x string, y double, k int")
    assert S.rank_correlation(table, "x", "y", "k").first()["rho"] == pytest.approx(np.corrcoef([a[k] for k in range(300)], [b[k] for k in range(300)])[0, 1])
    assert S.rank_correlation(table.limit(1), "x", "y", "k").first()["rho"] == 0 and S.rank_correlation(table.filter("false"), "x", "y", "k").first()["rho"] == 0


@pytest.fixture(scope="module")
def dosages(spark):
    rng = random.Random(8)
    rows = [(i, p, rng.choice([1, 2])) for p in range(10, 4000, 10) for i in (2, 5, 9) if rng.random() < 0.6]
    return rows, spark.createDataFrame(rows, "ind_id long, position long, g long"), spark.createDataFrame([(2,), (5,), (9,)], "ind_id long")


def test_vcf_source_round_trip(spark, dosages, tmp_path):
    rows, genotypes, people = dosages
    path, ids = str(tmp_path / "v"), {1: 2, 2: 5, 3: 9}
    vcf.save(genotypes, people, path)
    names = sorted(p.name for p in (tmp_path / "v").iterdir())
    assert names[0] == "part-00000-header.vcf" and len(names) > 2
    whole = "".join((tmp_path / "v" / n).read_text() for n in names).splitlines()
    assert sum(x.startswith("#") for x in whole) == 4 and whole[3].endswith("FORMAT\tIND2\tIND5\tIND9")
    positions = [int(x.split("\t")[1]) for x in whole[4:]]
    assert positions == sorted({p for _, p, _ in rows}) and positions == sorted(set(positions))
    for split in (1 << 26, 997, 60):
        got = vcf.load(spark, path, split=split).collect()
        assert sorted((ids[r["ind_id"]], r["position"], r["g"]) for r in got if r["g"]) == sorted(rows) and len(got) == 3 * len(positions)
    assert sorted((r["position"], r["g"]) for r in vcf.load(spark, path, ["IND5"]).filter("g > 0").collect()) == sorted((p, g) for i, p, g in rows if i == 5)


def test_vcf_columns_that_are_not_asked_for_are_not_parsed(spark, tmp_path):
    vcf.register(spark)
    (tmp_path / "x.vcf").write_text("##x\n" + "\t".join([*vcf.COLUMNS, "A", "B", "C"]) + "\n1\t7\trs1\tG\tC\t.\tPASS\t.\tGT:DP\t0|1:3\tbroken\t./.\r\n1\t9\t.\tG\tC\t.\tPASS\t.\tGT\t1/1\t\xff\t0/2")
    wide = spark.read.format("popspark_vcf").option("layout", "wide")
    got = wide.schema("position bigint, A int, C int, ref string").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(7, 1, None, "G"), (9, 2, 1, "G")]
    wide = spark.read.format("popspark_vcf").option("layout", "wide")
    assert wide.option("samples", "C").load(str(tmp_path)).columns == ["chrom", "position", "id", "ref", "alt", "C"]


def test_vcf_writer_refuses_what_it_cannot_order(spark, dosages, tmp_path):
    _, genotypes, people = dosages
    path = str(tmp_path / "w")
    vcf.save(genotypes, people, path)
    for rows, mode in ((genotypes, "append"), (genotypes.orderBy(F.col("position").desc()).coalesce(1), "overwrite"), (genotypes.repartitionByRange(3, "ind_id").sortWithinPartitions("position"), "overwrite")):
        with pytest.raises(Exception, match="."):
            rows.write.format("popspark_vcf").option("individuals", "2,5,9").mode(mode).save(path)
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_part")]
    vcf.save(genotypes.filter("position < 100"), people, path, "overwrite")
    assert vcf.load(spark, path).agg(F.max("position")).first()[0] < 100


def _comb(depth: int) -> list[tuple]:
    """parent_id, child_id, s, e of a comb: node k has the leaf k + 1000 and the node k + 1; odd nodes inherit on [0, 50) only."""
    return [x for k in range(depth) for x in ((k, k + 1000, 0, 100), (k, k + 1, 0, 50 if k % 2 else 100))]


@pytest.fixture
def few_recursive_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)  # what a recursive query stops at with an error, a million if not set
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_marginal_carriers_have_no_limit(spark, few_recursive_rows):
    edges = spark.createDataFrame(_comb(12), "parent_id long, child_id long, s long, e long")
    points = spark.createDataFrame([(0, 10), (0, 70), (10, 70), (12, 5)], "node_id long, position long")
    want = {(0, 10, k + 1000) for k in range(12)} | {(0, 10, 12), (0, 70, 1000), (0, 70, 1001), (10, 70, 1010), (10, 70, 1011), (12, 5, 12)}
    assert sorted(map(tuple, P.marginal_carriers(edges, points).collect())) == sorted(want)
    with pytest.raises(ValueError):  # a circle
        P.marginal_carriers(spark.createDataFrame([(1, 2, 0, 9), (2, 1, 0, 9)], "parent_id long, child_id long, s long, e long"), spark.createDataFrame([(1, 3)], "node_id long, position long")).collect()


def test_inherited_mutations_have_no_limit(spark, few_recursive_rows):
    nodes = spark.createDataFrame([(0, None), *((c, p) for p, c, _, _ in _comb(12))], "node_id long, parent_id long")
    intervals = spark.createDataFrame([(c, s, e) for _, c, s, e in _comb(12) if e == 50], IV.replace("id", "node_id"))
    mutated = spark.createDataFrame([(0, 10), (0, 70), (5, 20)], "node_id long, position long")
    samples = spark.createDataFrame([(k + 1000, k + 20) for k in range(12)], "node_id long, hap_id long")
    got = P.inherited(nodes, mutated, intervals, samples, 100)
    want = {(k + 20, 10) for k in range(12)} | {(12, 10), (20, 70), (21, 70)} | {(k + 20, 20) for k in range(5, 12)} | {(12, 20)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_walks_have_no_limit(spark, few_recursive_rows):
    parent = {1: 11, 2: 11, 11: 12, 3: 12, 12: 13, 4: 13, 13: 14, 5: 14}
    nodes = spark.createDataFrame([(14, None), *parent.items()], "node_id long, parent_id long")
    intervals = spark.createDataFrame([(12, 0, 50)], "node_id long, s long, e long")  # node 12 inherits there only
    redirects = spark.createDataFrame([(11, 30, 4)], "node_id long, at long, target long")
    points = spark.createDataFrame([(h, x) for h in (1, 2, 3, 5) for x in (10, 40, 60)], "hap_id long, position long")
    want = set()
    for h in (1, 2, 3, 5):
        for x in (10, 40, 60):
            at = h
            while at in parent:
                if at == 11 and x >= 30:
                    at = 4
                elif at == 12 and x >= 50:
                    break
                else:
                    want.add((at, x, h))
                    at = parent[at]
    assert len(want) > 20 and sorted(map(tuple, P.branch_carriers(nodes, intervals, redirects, points).collect())) == sorted(want)


def test_bitmaps_grow_with_carriers(spark):
    people = spark.range(200_000).selectExpr("id AS ind_id", "CAST(id AS INT) AS r")
    rows = [(r, p, 1 + r % 2) for p in range(40) for r in (p, 63, 64, 199_999 - p)]
    built = bitmaps.build(spark.createDataFrame(rows, "ind_id long, position long, g long"), people)
    assert built.count() == 40 * 3 and {x for _, x in built.dtypes} == {"bigint", "int"}  # words of 64 bits, those with a carrier alone
    assert sorted(map(tuple, bitmaps.unpack(built, people).collect())) == sorted(rows)


def test_correlations_come_from_products_of_blocks(spark):
    rng = np.random.default_rng(3)
    m = (rng.random((300, 1500)) < 0.02).astype(int) + (rng.random((300, 1500)) < 0.01)
    m[:, :1400] *= rng.integers(0, 2, (300, 1)) * (np.arange(1400) < 700) | 1  # sites that share words and others that don't
    m[200:, 64:] = 0
    rows = [(int(i), int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    people = spark.range(1500).selectExpr("id AS ind_id", "CAST(id AS INT) AS r")
    built = bitmaps.build(spark.createDataFrame([(i, p, g) for p, i, g in rows], "ind_id long, position long, g long"), people)
    vary = np.flatnonzero(m.std(axis=1) > 0)
    want, up = np.corrcoef(m[vary]), np.triu_indices(len(vary), 1)
    out = bitmaps.correlations(built, 1500, digits=6)
    assert "BatchEvalPython" not in (plan := out._jdf.queryExecution().toString()) and "zip_with" not in plan  # no pair of sites is a row before the result
    got = out.toPandas().sort_values(["pos_i", "pos_j"])
    assert got["pos_i"].tolist() == vary[up[0]].tolist() and got["pos_j"].tolist() == vary[up[1]].tolist() and np.abs(got["r"].to_numpy() - want[up]).max() < 6e-7


def test_compressed_vcf_files_hold_the_same(spark, tmp_path):
    import gzip

    for n in (5, 20_000):  # lines of a few bytes, several to a block, and lines of two blocks
        people = spark.range(1, n + 1).withColumnRenamed("id", "ind_id")
        rows = sorted({(1 + (p * 7919 + k * 9001) % n, p, 1 + (p + k) % 2) for p in range(1, 30) for k in (0,)})
        genotypes = spark.createDataFrame(rows, "ind_id long, position long, g long")
        vcf.save(genotypes, people, str(tmp_path / f"z{n}"), compression="bgzf")
        vcf.save(genotypes, people, str(tmp_path / f"p{n}"))
        packed, plain = ([x for x in sorted((tmp_path / f"{c}{n}").iterdir()) if x.name.startswith("part-")] for c in "zp")
        assert b"".join(gzip.decompress(x.read_bytes()) for x in packed) == b"".join(x.read_bytes() for x in plain)
        for c in "zp":
            assert sorted(map(tuple, vcf.load(spark, str(tmp_path / f"{c}{n}"), carriers=True).collect())) == rows
    assert sum(x.stat().st_size for x in packed[1:]) < sum(x.stat().st_size for x in plain[1:]) / 50  # without the header of names
