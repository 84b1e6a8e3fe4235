"""The relatedness matrix in tiles and its eigenvalues against numpy."""

import numpy as np
import pytest

from popspark import queries as Q
from popspark.operators import lanczos, tiles

SF = "/root/testdata/sf0.01"


def _random(spark, n: int, sites: int, seed: int, rare: float = 0.2):
    """A table of genotypes with sites that don't vary and an individual without any, and the matrix itself."""
    rng = np.random.default_rng(seed)
    m = (rng.random((n, sites)) < rare).astype(int) + (rng.random((n, sites)) < rare / 2)
    m[:, 1], m[:, 2], m[n // 2] = 0, 2, m[n // 2] * 0
    rows = [(int(i) + 1, int(j) * 10, int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "ind_id long, position long, g long").repartition(5), spark.range(1, n + 1).withColumnRenamed("id", "ind_id"), m


def _standard(m: np.ndarray) -> np.ndarray:
    sd = m.std(axis=0)
    return (m - m.mean(axis=0))[:, sd > 0] / sd[sd > 0]


@pytest.mark.parametrize(("tile", "held"), [(512, 128), (5, 128), (5, 3)])  # one tile, several, and in groups
def test_tiles_equal_the_matrix(spark, tile, held):
    genotypes, people, m = _random(spark, 23, 40, 1)
    z = _standard(m)
    k = z @ z.T / z.shape[1]
    got = tiles.relatedness(genotypes, people, tile, held).toPandas()
    assert len(got) == 23 * 23 and got.pivot(index="i", columns="j", values="k").to_numpy() == pytest.approx(k, abs=1e-12)
    values = np.linalg.eigvalsh(k)
    for small in (10**9, 0):  # whole in one task, or by tiles
        r = tiles.moments(genotypes, people, None, tile, held, small).first()
        assert r["p"] == z.shape[1] and r["trace"] == pytest.approx(23) and r["eig_variance"] == pytest.approx(values.var(ddof=1)) and r["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum())
    assert tiles.moments(genotypes.filter("false"), people).collect() == [] and tiles.relatedness(genotypes.filter("false"), people).collect() == []


def test_correlations_have_the_same_spectrum(spark):
    genotypes, people, m = _random(spark, 17, 30, 2)
    values = np.linalg.eigvalsh(np.corrcoef(m[:, m.std(axis=0) > 0].T))
    r = tiles.correlation_moments(tiles.moments(genotypes, people)).first()
    assert r["p"] == len(values) and r["eig_variance"] == pytest.approx(values.var(ddof=1)) and r["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum())


def test_many_matrices_in_one_plan(spark):
    import pandas as pd

    some = {}
    for x, sites in (("a", 12), ("b", 40), (None, 9), ("d", 25)):  # a null group too
        genotypes, people, m = _random(spark, 14, sites, sites)
        some[x] = (genotypes.toPandas().assign(x=x), m)
    whole = spark.createDataFrame(pd.concat([t for t, _ in some.values()]), "ind_id long, position long, g long, x string")
    for small in (10**9, 14 * 20, 0):
        got = {r["x"]: r for r in tiles.moments(whole, people, ["x"], 5, 3, small).collect()}
        assert set(got) == set(some)
        for x, (_, m) in some.items():
            z = _standard(m)
            values = np.linalg.eigvalsh(z @ z.T / z.shape[1])
            assert got[x]["p"] == z.shape[1] and got[x]["eig_variance"] == pytest.approx(values.var(ddof=1)) and got[x]["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum())


def test_plans_hold_no_cartesian_product(spark):
    d = Q.Data(spark, "/root/testdata/sf0.001")
    plan = tiles.relatedness(d.genotypes, d.individuals)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_leading_eigenvalues_equal_numpy(spark):
    d = Q.Data(spark, SF)
    g = d.genotypes.toPandas()
    m = np.zeros((50, int(g["position"].max()) + 1))
    m[g["ind_id"] - 1, g["position"]] = g["g"]
    z = _standard(m)
    want = np.sort(np.linalg.eigvalsh(z @ z.T / z.shape[1]))[::-1]
    values, n, p, _ = lanczos.leading(d.genotypes, d.individuals)
    assert (n, p) == (50, z.shape[1]) and values[:10] == pytest.approx(want[:10], rel=1e-9)
    share = want / want.sum()
    r = Q.QUERIES["spectral_stats"](spark, SF).first()
    assert r["top1"] == pytest.approx(share[0]) and r["top10"] == pytest.approx(share[:10].sum()) and r["entropy"] == pytest.approx(-(share[share > 1e-14] * np.log(share[share > 1e-14])).sum())


def test_leading_eigenvalues_of_five_thousand_individuals(spark):
    rng = np.random.default_rng(4)
    kin = rng.integers(0, 6, 5000)  # families that share alleles, so some eigenvalues stand out
    freq = rng.random((6, 150)) ** 3 * 0.5
    m = rng.binomial(2, freq[kin])
    z = _standard(m)
    want = np.sort(np.linalg.eigvalsh(z.T @ z / z.shape[1]))[::-1][:10]
    rows = np.argwhere(m > 0)
    import pandas as pd

    genotypes = spark.createDataFrame(pd.DataFrame({"ind_id": rows[:, 0], "position": rows[:, 1], "g": m[rows[:, 0], rows[:, 1]]}))
    values, n, p, held = lanczos.leading(genotypes, spark.range(5000).withColumnRenamed("id", "ind_id"))
    assert (n, p) == (5000, z.shape[1]) and held < 200 and values[:10] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("full", [26, 0])  # products of every two carriers, or dense ones
def test_few_or_many_carriers_give_the_same_tiles(spark, monkeypatch, full):
    monkeypatch.setattr(tiles, "FULL", full)
    monkeypatch.setattr(tiles, "PRODUCTS", 200)
    genotypes, people, m = _random(spark, 31, 60, 3, 0.1)
    z = _standard(m)
    k = z @ z.T / z.shape[1]
    for held in (128, 2):
        got = tiles.relatedness(genotypes, people, 4, held, digits=6).toPandas()
        assert len(got) == 31 * 31 and np.abs(got.pivot(index="i", columns="j", values="k").to_numpy() - k).max() < 6e-7 and (got["k"] * 1e6 - (got["k"] * 1e6).round()).abs().max() < 1e-3
    assert tiles.half_up(np.array([0.5, 1.5, -0.5, -0.2, 2.4]), 0).tolist() == [1, 2, -1, 0, 2]


def test_rare_sites_take_work_by_their_carriers_alone(spark):
    n = 40_000  # 79 blocks; dense products of 600 sites would be 3160 tiles of 512 x 512 x 600
    genotypes = spark.range(600).selectExpr("explode(array(id * 61 % 40000, (id * 61 + 20011) % 40000)) AS ind_id", "id AS position", "CAST(1 AS BIGINT) AS g")
    people = tiles.written(spark.range(n).selectExpr("id AS ind_id", "CAST(id AS INT) AS r"), "people")
    sites = tiles.site_rows(genotypes, people, n).withColumn("rep", tiles.F.lit(0).cast("long"))
    rows = tiles.gram(sites, n).collect()
    assert sum(len(r["data"]) // 8 for r in rows) < 4 * 600 and sum(np.frombuffer(r["data"]).sum() for r in rows) > 0


def test_correlations_of_rare_sites_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    m = (rng.random((1100, 90)) < 0.004).astype(int)  # three blocks of individuals, a few carriers a site
    rows = [(int(i), int(j), 1) for i, j in zip(*np.nonzero(m))]
    genotypes, people = spark.createDataFrame(rows, "ind_id long, position long, g long"), spark.range(1100).withColumnRenamed("id", "ind_id")
    values = np.linalg.eigvalsh(np.corrcoef(m[:, m.std(axis=0) > 0].T))
    r = tiles.correlation_moments(tiles.moments(genotypes, people, small=0)).first()
    assert r["p"] == len(values) and r["eig_variance"] == pytest.approx(values.var(ddof=1)) and r["participation"] == pytest.approx(values.sum() ** 2 / (values**2).sum())
    d = tiles.gram(tiles.written(tiles.site_rows(genotypes, *tiles.people_of(people)).withColumn("rep", tiles.F.lit(0).cast("long")), "sites"), 1100).filter("cells IS NULL")
    assert d.count() == 0  # no tile is dense


def test_the_whole_matrix_gives_what_lanczos_gives(spark):
    genotypes, people, m = _random(spark, 600, 1500, 5, 0.05)  # two blocks; Lanczos stops before it has all eigenvalues
    z = _standard(m)
    values = np.linalg.eigvalsh(z @ z.T / z.shape[1])
    share = values[values > 1e-12] / 600
    one, other = lanczos.summary(genotypes, people).first(), lanczos.summary(genotypes, people, whole=0, most=32).first()
    assert one["entropy"] == pytest.approx(-(share * np.log(share)).sum()) and other["entropy"] is None
    assert one["top10"] == pytest.approx(np.sort(share)[-10:].sum()) and one["eig_variance"] == pytest.approx(values.var(ddof=1))
    assert all(one[c] == pytest.approx(other[c]) for c in ("p", "eig_variance", "participation"))


def test_sweeps_deal_carriers_out_once(spark, monkeypatch):
    plans, real = [], tiles.written

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(tiles, "written", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of the size at hand go out because they are counted
    try:
        Q.QUERIES["sweep_spectrum"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = next(x for name, x in plans if name == "sites")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
