"""Exact values on a small matrix, moments of the generators, and each query against its SQL."""

import duckdb
import pytest

from popspark import queries as Q
from popspark.functions import models as M
from popspark.operators import intervals as I
from popspark.operators import lanczos
from popspark.operators import stats as S
from popspark.plans import genealogy as P
from popspark.sources import text as X

SF = "/root/testdata/sf0.001"
MATRIX = [[0, 1, 2], [1, 0, 1], [2, 2, 0]]


@pytest.fixture(scope="module")
def genotypes(spark):
    rows = [(i + 1, 100 * (j + 1), g) for i, r in enumerate(MATRIX) for j, g in enumerate(r) if g]
    return spark.createDataFrame(rows, "ind_id long, position long, g long")


@pytest.fixture(scope="module")
def freqs(spark, genotypes):
    from popspark.operators import genotypes as G

    return S.frequencies(G.allele_counts(genotypes), spark.createDataFrame([(6,)], "n_hap long"))


def test_small_matrix(freqs):
    r = S.population(freqs).first()
    assert (r["n_sites"], r["n_common"], r["mean_af"]) == (3, 3, 0.5)
    assert r["pi"] == pytest.approx(0.007462686567164179) and r["theta_w"] == pytest.approx(0.0065366597668591354) and r["density"] == pytest.approx(3 / 201)
    d = S.tajimas_d(freqs).first()
    assert d["tajimas_d"] == pytest.approx(0.24375465087287812) and d["tajimas_d_standard"] == pytest.approx(1.9098893821333744)


def test_spectrum_of_relatedness(spark, genotypes):
    people = spark.createDataFrame([(1,), (2,), (3,)], "ind_id long")
    values, n, p, _ = lanczos.leading(genotypes, people)
    assert (n, p) == (3, 3) and values == pytest.approx([2.3660254, 0.6339746, 0], abs=1e-6)
    r = lanczos.summary(genotypes, people).first()
    assert r["entropy"] == pytest.approx(0.5157067364635544) and r["mp_ratio"] == pytest.approx(0.5915063509461094) and r["tw_like"] == pytest.approx(-0.8189606534965251)
    assert r["top1"] == pytest.approx(0.7886751345948129) and r["top10"] == pytest.approx(1) and r["eig_variance"] == pytest.approx(1.5) and r["participation"] == pytest.approx(1.5)
    assert lanczos.summary(genotypes.filter("position = 100"), people).collect() == [] and lanczos.summary(genotypes.filter("false"), people).collect() == []


def test_no_sites(spark, freqs):
    r = S.population(freqs.filter("false")).first()
    assert r["n_sites"] == 0 and r["pi"] == 0
    assert S.tajimas_d(freqs.filter("false")).first()["tajimas_d"] == 0


def test_epochs_are_checked(spark):
    with pytest.raises(ValueError):
        M.epochs(spark, [(0.0, 10.0, 5.0), (11.0, None, 5.0)])


def test_adjacent_intervals_fuse(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 5, 8), (1, 9, 10)], "id long, s long, e long")
    assert sorted(map(tuple, I.merge(rows).collect())) == [(1, 1, 8), (1, 9, 10)]


def test_tree_moments(spark):
    params = spark.range(400).selectExpr("id AS rep", "10 AS n", "1000.0D AS ne", "7 AS seed")
    nodes = P.trees(params)
    assert nodes.count() == 400 * 19
    mean = nodes.groupBy("rep").agg({"time": "max"}).agg({"max(time)": "avg"}).first()[0]
    assert mean == pytest.approx(4000 * (1 - 1 / 10), rel=0.12)
    steady = P.trees(params, demography=[(0.0, 50.0, 1000.0), (50.0, float("inf"), 1000.0)])
    assert steady.groupBy("rep").agg({"time": "max"}).agg({"max(time)": "avg"}).first()[0] == pytest.approx(3600, rel=0.12)
    sites = P.mutations(nodes, 1e-6, 10_000).count() / 400
    assert sites == pytest.approx(4 * 1000 * 1e-6 * 10_000 * sum(1 / i for i in range(1, 10)), rel=0.1)


def test_reruns_agree(spark):
    params = spark.range(3).selectExpr("id AS rep", "6 AS n", "100.0D AS ne", "1 AS seed")
    one, two = (sorted(map(tuple, P.simulate(params, 1e-5, 500).collect())) for _ in range(2))
    assert one == two and one and {r[3] for r in one} <= {1, 2}


@pytest.mark.parametrize("fmt", ["csv", "vcf"])
def test_files_round_trip(spark, genotypes, tmp_path, fmt):
    people, sites = genotypes.select("ind_id").distinct(), genotypes.select("position").distinct()
    X.write(genotypes, people, sites, str(tmp_path / "x"), fmt)
    back = X.read(spark, str(tmp_path / "x"), fmt).filter("g > 0")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, genotypes.collect()))
    with pytest.raises(ValueError):
        X.write(genotypes, people, sites, str(tmp_path / "y"), "bed")


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    assert _rows(Q.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(Q.SQL[name]).df())


def test_whole_tables_equal_brute_force(spark, tmp_path):
    import random

    import numpy as np

    rng = random.Random(9)
    items = sorted({(rng.randrange(8), rng.choice([3, 250, 299, 300, 301, 5000]) if i % 2 else rng.randrange(60)) for i in range(220)})
    lines = [(s, p, float(rng.randrange(1, 30)), 1) for s, p in items]
    tables = {"supplier": ([(i,) for i in range(8)], "s_suppkey long"), "part": ([(i,) for i in (0, 1, 141, 142, 143, 900, 20_000)], "p_partkey long"), "lineitem": (lines, "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int")}
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    sites: dict[int, np.ndarray] = {}
    for s, p, q, _ in lines:
        if q <= 1 + p % 50:
            sites.setdefault(p + 1, np.zeros(4))[(s + 2) // 2 - 1] += 1
    varying = {p: g for p, g in sites.items() if g.std() > 0}
    got = {(r["pos_i"], r["pos_j"]): r["r"] for r in Q.QUERIES["site_corr"](spark, str(tmp_path)).collect()}
    assert len(varying) > 30 and got == {(a, b): pytest.approx(np.corrcoef(x, y)[0, 1], abs=2e-6) for a, x in varying.items() for b, y in varying.items() if a < b}
    merged: dict[int, list[list[int]]] = {}
    for s, e, i in sorted((p * 10 + 1, p * 10 + 1 + int(q), s) for s, p, q, _ in lines):
        own = merged.setdefault(i, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    want = {(a, b): n for a in merged for b in merged if a < b and (n := sum(x[0] < y[1] and y[0] < x[1] for x in merged[a] for y in merged[b]))}
    assert {(r["a"], r["b"]): r["n"] for r in Q.QUERIES["interval_overlap_pairs"](spark, str(tmp_path)).collect()} == want
    ends = [1, 3, 10, 990, 997, 1004, 6303, 140_003, 140_004]
    assert sorted(map(tuple, Q.QUERIES["breakpoint_intervals"](spark, str(tmp_path)).collect())) == list(zip(ends, ends[1:]))


def test_parameters_are_checked(spark):
    assert M.parameters(100, 1e-8, 0.0, 1000, 5)["ne"] == 100
    wrong = [lambda: M.parameters(0, 1e-8, 0, 10, 5), lambda: M.parameters(10, -1, 0, 10, 5), lambda: M.parameters(10, 0, 0, 10, 0), lambda: M.directional(0, 0.5, 1, 0), lambda: M.directional(0.1, 2, 1, 0), lambda: M.balancing([0.1], 5, [0.5, 0.5]), lambda: M.balancing([0.1, 0.1], 5, [0.6, 0.5]), lambda: M.background(1e-8, 0.1), lambda: M.recombination_map(spark, [1, 5], [0.1, 0.2]), lambda: M.recombination_map(spark, [5, 1], [0.1]), lambda: M.recombination_map(spark, [1, 5], [-0.1])]
    for f in wrong:
        with pytest.raises(ValueError):
            f()


def test_maps_without_rates(spark):
    draws = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.999)], "id int, u double")
    at = lambda m: [r["position"] for r in M.breakpoints(draws, m, 1000).orderBy("id").collect()]
    assert at(M.recombination_map(spark, [1, 101, 1001], [0.0, 0.0])) == [1, 501, 1000]
    assert at(M.recombination_map(spark, [1, 101, 1001], [0.0, 0.0]).filter("false")) == [1, 1, 1]
    assert at(M.recombination_map(spark, [1, 101, 201, 1001], [0.0, 1e-3, 0.0])) == [101, 151, 200]


def test_bottleneck_has_three_epochs(spark):
    rows = [tuple(r) for r in M.bottleneck(spark, 100.0, 10.0, 5.0, 9.0).collect()]
    assert rows == [(0, 0.0, 5.0, 100.0), (1, 5.0, 9.0, 10.0), (2, 9.0, None, 100.0)]
    assert [tuple(r) for r in M.constant(spark, 7.0).collect()] == [(0, 0.0, None, 7.0)]
    assert [tuple(r)[1:4] for r in M.uniform_map(spark, 1000, 1e-8).collect()] == [(1, 1001, 1e-8)]


def test_long_files_fill_and_last_rows_win(spark, tmp_path):
    (tmp_path / "x.csv").write_text("individual,position,genotype\n2,10,1\n1,30,2\n2,10,2\n")
    got = {(r["ind_id"], r["position"]): r["g"] for r in X.load_long(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {(1, 10): 0, (1, 30): 2, (2, 10): 2, (2, 30): 0}


def test_headers_and_plink(spark, genotypes, tmp_path):
    people, sites = genotypes.select("ind_id").distinct(), genotypes.select("position").distinct()
    lines = lambda p: [r["value"] for r in spark.read.text(str(tmp_path / p)).collect()]
    X.write(genotypes, people, sites, str(tmp_path / "w"), "wide")
    assert sorted(lines("w")) == ["0,1,2", "1,0,1", "100,200,300", "2,2,0"]
    X.write(genotypes, people, sites, str(tmp_path / "v"), "vcf")
    assert {"##fileformat=VCFv4.2", "##contig=<ID=1,length=1000000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tIND1\tIND2\tIND3"} <= set(lines("v"))
    X.write(genotypes, people, sites, str(tmp_path / "p"), "plink")
    assert sorted(lines("p.map")) == ["1\tSNP1\t0\t100", "1\tSNP2\t0\t200", "1\tSNP3\t0\t300"]
    assert sorted(lines("p.ped"))[0] == "FAM1\tIND1\t0\t0\t0\t-9\tA A\tA T\tT T"


def test_an_odd_last_haplotype(spark):
    from popspark.operators import genotypes as G

    held = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (3, 20)], "hap_id long, position long")
    samples = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "hap_id long, ind_id long")
    assert sorted(map(tuple, G.to_diploid(held, samples).collect())) == [(1, 10, 2), (2, 10, 1), (2, 20, 1)]


def test_numbers_follow_the_order(spark):
    from popspark.operators.numbering import numbered

    rows = spark.range(1000).selectExpr("id * 37 % 1009 AS x", "id AS w")
    got = {r["x"]: (r["k"], r["total"]) for r in numbered(rows, "x", "k", "w").collect()}
    weights, before = {r["x"]: r["w"] for r in rows.collect()}, 0
    for k, x in enumerate(sorted(weights), 1):
        assert got[x] == (k, before)
        before += weights[x]
    assert numbered(rows.filter("false"), "x", "k").collect() == []


def test_numbers_of_other_keys(spark, genotypes):
    from popspark.operators import genotypes as G
    from popspark.operators.numbering import numbered

    rows = spark.createDataFrame([("b", 2), ("a", 3), (None, 1), ("b", 1), ("a", 3)], "x string, y int")
    assert [(r["k"], r["x"], r["y"]) for r in sorted(numbered(rows, ["x", "y"], "k").collect(), key=lambda r: r["k"])] == [(1, None, 1), (2, "a", 3), (3, "a", 3), (4, "b", 1), (5, "b", 2)]
    sites = genotypes.select("position").distinct()
    assert sorted(r["line"] for r in X.map_lines(sites).collect()) == ["1\tSNP1\t0\t100", "1\tSNP2\t0\t200", "1\tSNP3\t0\t300"]
    assert sorted(map(tuple, G.column_pointers(genotypes, sites).collect())) == [(100, 1, 1, 2), (200, 2, 3, 2), (300, 3, 5, 2)]


def test_long_lines_take_pages_of_their_own(spark, tmp_path):
    n = 300_000
    sites, people = spark.range(1, n + 1).withColumnRenamed("id", "position"), spark.range(1, 31).withColumnRenamed("id", "ind_id")
    genotypes = spark.createDataFrame([(1, 1, 1), (1, n, 2), (2, 7, 2)], "ind_id long, position long, g long")
    spark.conf.unset("parquet.page.size.row.check.min")
    wide, ped = X.wide_lines(genotypes, people, sites), X.ped_lines(genotypes, people, sites)
    assert spark.conf.get("parquet.page.size.row.check.min") == "1"  # else a hundred lines are held at once
    wide.coalesce(1).write.parquet(str(tmp_path / "w"))
    lines = {r["ind_id"]: r["line"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    zeros = ["0"] * n
    assert len(lines) == 30 and lines[30] == ",".join(zeros) and lines[2] == ",".join([*zeros[:6], "2", *zeros[7:]]) and lines[1] == ",".join(["1", *zeros[2:], "2"])
    assert ped.filter("ind_id = 1").first()["line"] == "\t".join(["FAM1", "IND1", "0", "0", "0", "-9", "A T", *["A A"] * (n - 2), "T T"])


def test_the_dense_table_passes_no_shuffle(spark, monkeypatch):
    from popspark.operators import genotypes as G

    monkeypatch.setattr(G, "PEOPLE", 3)
    monkeypatch.setattr(G, "PLACES", 7)
    monkeypatch.setattr(G, "BATCH", 16)
    cells = [(i, p, (i * p) % 3, t) for i in range(10) for p in range(0, 40, 2) for t in (0, 1) if (i + p + t) % 4 == 0] + [(3, 4, 2, 9), (3, 4, 0, 10), (None, 4, 2, 1), (7, None, 1, 1), (5, 100, None, 1)]
    out = G.last_wins(spark.createDataFrame(cells, "ind_id long, position long, g long, t long"), ["t"])
    last = {(i, p): g for i, p, g, _ in sorted(cells, key=lambda c: c[3])}
    ids, places = {c[0] for c in cells}, {c[1] for c in cells}
    want = [(i, p, (last.get((i, p)) or 0) if i is not None and p is not None else 0) for i in ids for p in places]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")] and "CartesianProduct" not in plan


def test_vcf_lines_read_genotypes_once(spark):
    plan = Q.QUERIES["vcf_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation [l_") + plan.count("Relation[l_") == 1
