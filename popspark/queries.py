"""The queries of the genetics part over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.functions import models as M
from popspark.operators import bitmaps
from popspark.operators import genotypes as G
from popspark.operators import intervals as I
from popspark.operators import lanczos
from popspark.operators import linkage as L
from popspark.operators import stats as S
from popspark.operators import tiles
from popspark.operators.numbering import numbered
from popspark.plans import genealogy as P
from popspark.sources import tables as T
from popspark.sources import text as X
from popspark.sources import vcf
from popspark.sources.shared import BROADCAST_ROWS, shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Data:
    """The genotype tables that most queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.samples, self.haplotypes = T.samples(spark, sf_dir), T.carriers(spark, sf_dir)
        self.n_hap = self.samples.agg(F.count("*").alias("n_hap"))
        self.individuals = self.samples.select("ind_id").distinct()
        self.n_ind = self.individuals.agg(F.count("*").alias("n_ind"))
        self.near_samples = F.broadcast(self.samples) if self.samples.count() <= BROADCAST_ROWS else self.samples
        self.genotypes = G.to_diploid(self.haplotypes, self.near_samples)
        self.positions = self.haplotypes.select("position").distinct()
        self.counts = G.carrier_counts(self.haplotypes)
        self.freqs = S.frequencies(self.counts, self.n_hap)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


BASE = """
WITH s AS (SELECT CAST(s_suppkey AS BIGINT)+1 AS hap_id, CAST(FLOOR((s_suppkey+2)/2) AS BIGINT) AS ind_id FROM supplier),
h AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT)+1 AS hap_id, CAST(l_partkey AS BIGINT)+1 AS position FROM lineitem WHERE l_quantity <= 1 + l_partkey % 50),
g AS (SELECT ind_id, position, count(*) AS g FROM h JOIN s USING (hap_id) GROUP BY ALL),
n AS (SELECT count(*) AS n_hap, count(DISTINCT ind_id) AS n_ind FROM s),
c AS (SELECT position, CAST(sum(g) AS BIGINT) AS ac FROM g GROUP BY 1),
f AS (SELECT position, ac, ac / CAST(n_hap AS DOUBLE) AS p, n_hap FROM c, n)
"""
ALL = "{p}count(*) AS n_sites, count(*) FILTER (least(p, 1-p) > 0.05) AS n_common, round(avg(p), 6) AS mean_af, round(sum(2*p*(1-p)) / (max(position)-min(position)+1), 6) AS pi, round(count(*) / CAST(max(position)-min(position)+1 AS DOUBLE), 6) AS density, count(*) AS segregating, round(count(*) / list_sum(list_transform(range(1, CAST(any_value(n_hap) AS BIGINT)), lambda x: 1.0::DOUBLE / x)) / (max(position)-min(position)+1), 6) AS theta_w"


@query(BASE + "SELECT ind_id, position, g FROM g")
def hap_to_diploid(spark, sf):
    return Data(spark, sf).genotypes


@query(BASE + "SELECT position, ac, round(p, 6) AS p FROM f")
def allele_freq(spark, sf):
    return rounded(Data(spark, sf).freqs.select("position", "ac", "p"))


@query(BASE + f"SELECT {ALL.format(p='')} FROM f")
def pop_stats(spark, sf):
    return rounded(S.population(Data(spark, sf).freqs))


@query(BASE + "SELECT derived, (SELECT count(*) FROM c WHERE ac = derived) AS n_sites FROM (SELECT unnest(range(0, (SELECT n_hap FROM n)+1)) AS derived)")
def sfs(spark, sf):
    d = Data(spark, sf)
    return S.spectrum(d.counts, d.n_hap)


TAJIMA = BASE + """, o AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(2*p*(1-p)) AS pi, CAST(any_value(n_hap) AS DOUBLE) AS n,
  list_sum(list_transform(range(1, CAST(any_value(n_hap) AS BIGINT)), lambda x: 1.0::DOUBLE / x)) AS a1, list_sum(list_transform(range(1, CAST(any_value(n_hap) AS BIGINT)), lambda x: 1.0::DOUBLE / (x*x))) AS a2 FROM f),
v AS (SELECT *, ((n+1)/(3*(n-1)) - 1/a1)/a1*k + (2*(n*n+n+3)/(9*n*(n-1)) - (n+2)/(a1*n) + a2/(a1*a1))/(a1*a1+a2)*k*(k-1) AS var FROM o)
"""


@query(TAJIMA + "SELECT round(CASE WHEN k > 0 AND var > 0 THEN (pi/k - 1/a1)/sqrt(var) ELSE 0 END, 6) AS tajimas_d, round(CASE WHEN k > 0 AND var > 0 THEN (pi*n/(n-1) - k/a1)/sqrt(var) ELSE 0 END, 6) AS tajimas_d_standard FROM v")
def tajimas_d(spark, sf):
    return rounded(S.tajimas_d(Data(spark, sf).freqs))


@query(BASE + "SELECT count(*) FILTER (ac=1) AS singletons, count(*) FILTER (ac=2) AS doubletons, count(*) FILTER (ac BETWEEN 1 AND 20) AS rare, count(*) FILTER (ac BETWEEN 21 AND 100) AS low, count(*) FILTER (ac > 100) AS common, round(count(*) FILTER (ac=1) / CAST(count(*) FILTER (ac=2) AS DOUBLE), 6) AS ratio FROM c")
def freq_classes(spark, sf):
    return rounded(S.classes(Data(spark, sf).counts))


@query(BASE + "SELECT position, ac FROM f WHERE ac > 0 AND ac < n_hap")
def polymorphic_sites(spark, sf):
    d = Data(spark, sf)
    return G.polymorphic(d.counts, d.n_hap)


@query(BASE + "SELECT \"window\", count(*) AS n_sites, round(avg(2*p*(1-p)), 6) AS mean_d, round(min(2*p*(1-p)), 6) AS min_d, round(max(2*p*(1-p)), 6) AS max_d FROM f JOIN (SELECT unnest([20, 50, 100, 1000])::BIGINT AS \"window\") ON abs(position - 120) <= \"window\" GROUP BY 1")
def window_diversity(spark, sf):
    return rounded(S.windows(Data(spark, sf).freqs, 120, [20, 50, 100, 1000]))


@query(BASE + "SELECT position, round(2*p*(1-p), 6) AS diversity FROM f WHERE abs(position - 120) <= 50")
def selection_signature(spark, sf):
    return rounded(S.signature(Data(spark, sf).freqs, 120, 50))


@query(BASE + "SELECT position, abs(position - 500000) AS distance, round(p, 6) AS p, abs(position - 500000) <= 5000 AS near FROM f ORDER BY 2, 1 LIMIT 1")
def nearest_variant(spark, sf):
    return rounded(S.nearest(Data(spark, sf).freqs, 500_000))


SCENARIO = """
WITH s AS (SELECT CAST(s_suppkey AS BIGINT)+1 AS hap_id, CAST(FLOOR((s_suppkey+2)/2) AS BIGINT) AS ind_id FROM supplier),
h AS (SELECT DISTINCT l_returnflag AS scenario, CAST(l_suppkey AS BIGINT)+1 AS hap_id, CAST(l_partkey AS BIGINT)+1 AS position FROM lineitem WHERE l_quantity <= 1 + l_partkey % 50),
f AS (SELECT scenario, position, count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE) AS p, (SELECT count(*) FROM s) AS n_hap FROM h GROUP BY 1, 2)
"""


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    d = Data(spark, sf)
    held = T.carriers(spark, sf, F.col("l_returnflag").alias("scenario"))
    return S.population(S.frequencies(held.groupBy("scenario", "position").agg(F.count("*").alias("ac")), d.n_hap), ["scenario"])


@query(SCENARIO + f"SELECT {ALL.format(p='scenario, ')} FROM f GROUP BY scenario")
def stats_by_scenario(spark, sf):
    return rounded(_scenarios(spark, sf))


@query(SCENARIO + ", t AS (SELECT scenario, count(*) AS k, sum(2*p*(1-p))/(max(position)-min(position)+1) AS pi, count(*)/CAST(max(position)-min(position)+1 AS DOUBLE) AS d FROM f GROUP BY 1) SELECT t.scenario, t.k - b.k AS n_sites_diff, round(t.pi - b.pi, 6) AS pi_diff, round(100*(t.pi-b.pi)/b.pi, 4) AS pi_change, round(100*(t.d-b.d)/b.d, 4) AS theta_w_change FROM t, t b WHERE b.scenario = 'N' AND t.scenario <> 'N'")
def scenario_compare(spark, sf):
    out = S.compare(_scenarios(spark, sf), "scenario", "N")
    return out.select("scenario", "n_sites_diff", F.round("pi_diff", 6).alias("pi_diff"), F.round("pi_change", 4).alias("pi_change"), F.round("theta_w_change", 4).alias("theta_w_change"))


PAIRS = BASE + """, i AS (SELECT position, row_number() OVER (ORDER BY position) AS i FROM c),
m AS (SELECT position, sum(g)/CAST(any_value(n_ind) AS DOUBLE) AS mean, sqrt(greatest(sum(g*g)/CAST(any_value(n_ind) AS DOUBLE) - (sum(g)/CAST(any_value(n_ind) AS DOUBLE))*(sum(g)/CAST(any_value(n_ind) AS DOUBLE)), 0)) AS sd FROM g, n GROUP BY 1),
w AS (SELECT position, i, mean, sd FROM i JOIN m USING (position) WHERE sd > 1e-12),
r AS (SELECT a.position AS pos_i, b.position AS pos_j, pow((coalesce((SELECT sum(x.g*y.g) FROM g x JOIN g y USING (ind_id) WHERE x.position = a.position AND y.position = b.position), 0)/CAST((SELECT n_ind FROM n) AS DOUBLE) - a.mean*b.mean)/(a.sd*b.sd), 2) AS r2
  FROM w a JOIN w b ON b.i > a.i AND b.i <= a.i + 20 AND b.position - a.position <= 10000 WHERE a.i <= 100)
"""


@query(PAIRS + "SELECT pos_i, pos_j, round(r2, 6) AS r2 FROM r")
def ld_pairs(spark, sf):
    d = Data(spark, sf)
    return rounded(L.pairs(d.genotypes, d.n_ind))


@query(PAIRS + "SELECT count(*) AS n_pairs, round(avg(r2), 6) AS mean_r2, round(max(r2), 6) AS max_r2 FROM r")
def ld_summary(spark, sf):
    d = Data(spark, sf)
    return rounded(L.pairs(d.genotypes, d.n_ind).agg(F.count("*").alias("n_pairs"), F.avg("r2").alias("mean_r2"), F.max("r2").alias("max_r2")))


@query(BASE + """, m AS (SELECT position, sum(g)/CAST(any_value(n_ind) AS DOUBLE) AS mean, sqrt(sum(g*g)/CAST(any_value(n_ind) AS DOUBLE) - pow(sum(g)/CAST(any_value(n_ind) AS DOUBLE), 2)) AS sd FROM g, n GROUP BY 1 HAVING sum(g*g)*any_value(n_ind) > sum(g)*sum(g)),
x AS (SELECT a.position AS i, b.position AS j, sum(a.g*b.g) AS xy FROM g a JOIN g b USING (ind_id) WHERE a.position < b.position GROUP BY 1, 2)
SELECT a.position AS pos_i, b.position AS pos_j, round((coalesce(xy, 0)/CAST((SELECT n_ind FROM n) AS DOUBLE) - a.mean*b.mean)/(a.sd*b.sd), 6) AS r FROM m a JOIN m b ON a.position < b.position LEFT JOIN x ON x.i = a.position AND x.j = b.position""")
def site_corr(spark, sf):
    """The correlations of every two sites that vary."""
    d = Data(spark, sf)
    people, n = tiles.people_of(d.individuals)
    return bitmaps.correlations(bitmaps.build(d.genotypes, people), n, digits=6)


@query(BASE + "SELECT ind_id, position, g FROM g")
def bitmap_genotypes(spark, sf):
    """Genotypes read back from the bitmaps that they were packed in."""
    d = Data(spark, sf)
    people, _ = tiles.people_of(d.individuals)
    return bitmaps.unpack(written(bitmaps.build(d.genotypes, people), "bitmaps"), people)


@query(BASE + ", q AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) % (SELECT n_ind FROM n) + 1 AS ind_id, CAST(p_partkey AS BIGINT) AS position FROM part) SELECT q.ind_id, q.position, coalesce(g.g, 0) AS g FROM q LEFT JOIN g ON g.ind_id = q.ind_id AND g.position = q.position")
def bitmap_lookup(spark, sf):
    """Cells looked up in bitmaps."""
    d = Data(spark, sf)
    people, n = tiles.people_of(d.individuals)
    key = F.col("p_partkey").cast("long")
    cells = T.table(spark, sf, "part").select((key % n + 1).alias("ind_id"), key.alias("position")).distinct().join(people, "ind_id")
    return bitmaps.lookup(cells, bitmaps.build(d.genotypes, people)).select("ind_id", "position", "g")


GRM = BASE + """, m AS (SELECT position, sum(g)/CAST(any_value(n_ind) AS DOUBLE) AS mean, sum(g*g)/CAST(any_value(n_ind) AS DOUBLE) - pow(sum(g)/CAST(any_value(n_ind) AS DOUBLE), 2) AS v FROM g, n GROUP BY 1 HAVING v > 1e-24),
x AS (SELECT a.ind_id AS i, b.ind_id AS j, sum(a.g*b.g/v) AS xy FROM g a JOIN g b USING (position) JOIN m USING (position) GROUP BY 1, 2),
o AS (SELECT s.ind_id, coalesce(sum(g*mean/v), 0) AS own FROM (SELECT DISTINCT ind_id FROM s) s LEFT JOIN (g JOIN m USING (position)) USING (ind_id) GROUP BY 1),
k AS (SELECT a.ind_id AS i, b.ind_id AS j, (coalesce(xy, 0) - a.own - b.own + (SELECT sum(mean*mean/v) FROM m)) / (SELECT count(*) FROM m) AS k FROM o a CROSS JOIN o b LEFT JOIN x ON x.i = a.ind_id AND x.j = b.ind_id)
"""


@query(GRM + "SELECT i, j, round(k, 6) AS k FROM k")
def grm(spark, sf):
    d = Data(spark, sf)
    return tiles.relatedness(d.genotypes, d.individuals, digits=6)


@query(GRM + ", o1 AS (SELECT sum(CASE WHEN i=j THEN k ELSE 0 END) AS trace, sum(k*k) AS norm2, CAST(count(*) FILTER (i=j) AS DOUBLE) AS c FROM k) SELECT round(trace, 6) AS trace, round(norm2, 6) AS norm2, round((norm2 - trace*trace/c)/(c-1), 6) AS eig_variance, round(trace*trace/norm2, 6) AS participation FROM o1")
def grm_moments(spark, sf):
    d = Data(spark, sf)
    return rounded(tiles.moments(d.genotypes, d.individuals).select("trace", "norm2", "eig_variance", "participation"))


@query()
def spectral_stats(spark, sf):
    d = Data(spark, sf)
    return lanczos.summary(d.genotypes, d.individuals)


@query(BASE + """, m AS (SELECT position, sum(g)/CAST(any_value(n_ind) AS DOUBLE) AS mean, sqrt(sum(g*g)/CAST(any_value(n_ind) AS DOUBLE) - pow(sum(g)/CAST(any_value(n_ind) AS DOUBLE), 2)) AS sd FROM g, n GROUP BY 1 HAVING sum(g*g)/CAST(any_value(n_ind) AS DOUBLE) - pow(sum(g)/CAST(any_value(n_ind) AS DOUBLE), 2) > 1e-24),
x AS (SELECT a.position AS i, b.position AS j, sum(a.g*b.g) AS xy FROM g a JOIN g b USING (ind_id) GROUP BY 1, 2),
r AS (SELECT (coalesce(xy, 0)/CAST((SELECT n_ind FROM n) AS DOUBLE) - a.mean*b.mean)/(a.sd*b.sd) AS r FROM m a CROSS JOIN m b LEFT JOIN x ON x.i = a.position AND x.j = b.position)
SELECT p, round((norm2 - p)/(p - 1), 6) AS eig_variance, round(p*p/norm2, 6) AS participation FROM (SELECT (SELECT count(*) FROM m) AS p, sum(r*r) AS norm2 FROM r)""")
def correlation_spectrum(spark, sf):
    """The spectrum of all correlations between sites that vary; its SQL takes them pair by pair."""
    d = Data(spark, sf)
    return rounded(tiles.correlation_moments(tiles.moments(d.genotypes, d.individuals)).select("p", "eig_variance", "participation"))


@query(SCENARIO + """, g AS (SELECT scenario, position // 20 AS block, ind_id, position, count(*) AS g FROM h JOIN s USING (hap_id) GROUP BY ALL), n AS (SELECT CAST(count(DISTINCT ind_id) AS DOUBLE) AS n FROM s),
k AS (SELECT scenario, block FROM g GROUP BY 1, 2 HAVING count(DISTINCT position) >= 3),
m AS (SELECT scenario, block, position, sum(g)/any_value(n) AS mean, sqrt(sum(g*g)/any_value(n) - pow(sum(g)/any_value(n), 2)) AS sd FROM g, n GROUP BY 1, 2, 3 HAVING sum(g*g)/any_value(n) - pow(sum(g)/any_value(n), 2) > 1e-24),
x AS (SELECT scenario, block, a.position AS i, b.position AS j, sum(a.g*b.g) AS xy FROM g a JOIN g b USING (scenario, block, ind_id) GROUP BY ALL),
r AS (SELECT scenario, block, a.position AS i, (coalesce(xy, 0)/n - a.mean*b.mean)/(a.sd*b.sd) AS r FROM m a JOIN m b USING (scenario, block) LEFT JOIN x ON x.scenario = a.scenario AND x.block = a.block AND x.i = a.position AND x.j = b.position, n),
e AS (SELECT scenario, block, count(DISTINCT i) AS p, sum(r*r) * pow(any_value(n) / count(DISTINCT i), 2) AS norm2, any_value(n) AS n FROM r JOIN k USING (scenario, block), n GROUP BY 1, 2 HAVING count(DISTINCT i) >= 2),
v AS (SELECT scenario, p, (norm2 - n)/(n - 1) AS ev, n*n/norm2 AS pr FROM e)
SELECT scenario, count(*) AS n, round(avg(p), 6) AS mean_sites, round(avg(ev), 6) AS eig_variance, round(coalesce(stddev_samp(ev)/sqrt(count(*)), 0), 6) AS eig_variance_se, round(avg(pr), 6) AS participation, round(coalesce(stddev_samp(pr)/sqrt(count(*)), 0), 6) AS participation_se FROM v GROUP BY 1""")
def sweep_spectrum(spark, sf):
    """Eigenvalue variance and participation of each block of 20 positions in each scenario, as mean and standard error over the blocks."""
    d = Data(spark, sf)
    by = ["scenario", "block"]
    held = T.carriers(spark, sf, F.col("l_returnflag").alias("scenario")).withColumn("block", F.floor(F.col("position") / 20))
    held = written(held, "carriers")
    dealt = held.join(d.near_samples, "hap_id").repartition(*by, "position")  # sums by individual and by site need no other shuffle
    genotypes = dealt.groupBy(*by, "ind_id", "position").agg(F.count("*").alias("g"))
    enough = held.groupBy(*by, "position").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("k")).filter("k >= 3")
    each = tiles.moments(genotypes, d.individuals, by).filter("p >= 2").join(enough, by, "left_semi")
    return rounded(S.sweep_of(each, "scenario", {"eig_variance": "eig_variance", "participation": "participation"}, "p"))


@query(BASE + ", z AS (SELECT (SELECT n_ind FROM n) AS n_rows, (SELECT count(*) FROM c) AS n_cols, (SELECT count(*) FROM g) AS nnz, (SELECT max(g) FROM g) AS top) SELECT n_rows, n_cols, nnz, round((n_rows*n_cols-nnz)/CAST(n_rows*n_cols AS DOUBLE), 6) AS sparsity, 4*nnz + 4*(n_cols+1) + nnz + 4*n_cols + 8 AS bytes, CASE WHEN top <= 1 AND (n_rows*n_cols-nnz)/CAST(n_rows*n_cols AS DOUBLE) > 0.9 THEN 'bitpacked' WHEN (n_rows*n_cols-nnz)/CAST(n_rows*n_cols AS DOUBLE) > 0.7 THEN 'sparse' ELSE 'dense' END AS layout FROM z")
def representation_choice(spark, sf):
    d = Data(spark, sf)
    return G.shape(d.genotypes, d.individuals, d.positions)


@query(BASE + "SELECT position, row_number() OVER w AS \"column\", CAST(coalesce(sum(nnz) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS pointer, nnz FROM (SELECT position, count(*) AS nnz FROM g GROUP BY 1) WINDOW w AS (ORDER BY position)")
def csc_pointers(spark, sf):
    d = Data(spark, sf)
    return G.column_pointers(d.genotypes, d.positions)


@query(BASE + ", r AS (SELECT ind_id, row_number() OVER (ORDER BY ind_id) AS r FROM (SELECT DISTINCT ind_id FROM s)), k AS (SELECT position, row_number() OVER (ORDER BY position) AS c FROM c) SELECT ind_id, position, (k.c-1)*(SELECT n_ind FROM n) + r.r - 1 AS bit FROM g JOIN r USING (ind_id) JOIN k USING (position)")
def bit_positions(spark, sf):
    d = Data(spark, sf)
    return G.bit_positions(d.genotypes, d.individuals, d.positions)


FULL = BASE + ", d AS (SELECT i.ind_id, c.position, coalesce(g.g, 0) AS g FROM (SELECT DISTINCT ind_id FROM s) i CROSS JOIN c LEFT JOIN g ON g.ind_id = i.ind_id AND g.position = c.position)"


@query(FULL + " SELECT ind_id, string_agg(CAST(g AS VARCHAR), ',' ORDER BY position) AS line FROM d GROUP BY 1")
def csv_wide_lines(spark, sf):
    d = Data(spark, sf)
    return X.wide_lines(d.genotypes, d.individuals, d.positions)


@query(FULL + " SELECT position, '1' || chr(9) || position || chr(9) || '.' || chr(9) || 'A' || chr(9) || 'T' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || string_agg(CASE WHEN g=0 THEN '0/0' WHEN g=1 THEN '0/1' ELSE '1/1' END, chr(9) ORDER BY ind_id) AS line FROM d GROUP BY 1")
def vcf_lines(spark, sf):
    d = Data(spark, sf)
    return X.vcf_lines(d.genotypes, d.individuals)


@query(FULL + " SELECT ind_id, 'FAM' || ind_id || chr(9) || 'IND' || ind_id || chr(9) || '0' || chr(9) || '0' || chr(9) || '0' || chr(9) || '-9' || chr(9) || string_agg(CASE WHEN g=0 THEN 'A A' WHEN g=1 THEN 'A T' ELSE 'T T' END, chr(9) ORDER BY position) AS line FROM d GROUP BY 1")
def ped_lines(spark, sf):
    d = Data(spark, sf)
    return X.ped_lines(d.genotypes, d.individuals, d.positions)


@query(BASE + "SELECT position, '1' || chr(9) || 'SNP' || row_number() OVER (ORDER BY position) || chr(9) || '0' || chr(9) || position AS line FROM c")
def map_lines(spark, sf):
    return X.map_lines(Data(spark, sf).positions)


EPOCHS = [(0.0, 100.0, 10_000.0), (100.0, 500.0, 1_000.0), (500.0, None, 5_000.0)]


@query("SELECT p_partkey AS id, CAST(p_partkey AS DOUBLE) AS t, CASE WHEN p_partkey < 100 THEN 10000.0::DOUBLE WHEN p_partkey < 500 THEN 1000.0::DOUBLE ELSE 5000.0::DOUBLE END AS ne, CASE WHEN p_partkey < 100 THEN 100.0::DOUBLE WHEN p_partkey < 500 THEN 500.0::DOUBLE END AS t_end FROM part")
def epoch_lookup(spark, sf):
    times = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("t"))
    return M.size_at(times, M.epochs(spark, EPOCHS)).select("id", "t", "ne", "t_end")


HOT = "WITH b AS (SELECT CAST(x AS BIGINT)*100000+1 AS st FROM range(0, 10) r(x)), q AS (SELECT st AS s, st+5000 AS e, 1e-8::DOUBLE*20/(0.05*20+0.95*0.02) AS rate FROM b UNION ALL SELECT st+5000, st+100000, 1e-8::DOUBLE*0.02/(0.05*20+0.95*0.02) FROM b), m AS (SELECT row_number() OVER (ORDER BY s) AS idx, s, e, rate, sum((e-s)*rate) OVER (ORDER BY s) AS cum FROM q)"


@query(HOT + ", z AS (SELECT *, cum - (e-s)*rate AS before FROM m), d AS (SELECT p_partkey AS id, CAST(CAST('0x'||substr(md5(p_partkey||':hot'),1,13) AS BIGINT) AS DOUBLE)/pow(2,52) * (SELECT max(cum) FROM m) AS aim FROM part) SELECT id, CAST(least(greatest(floor(s + (aim-before)/rate), 1), 1000000) AS BIGINT) AS position FROM d JOIN z ON rate > 0 AND aim > before AND aim <= cum")
def hotspot_map(spark, sf):
    """Breakpoints drawn for every part from a map with periodic hotspots."""
    draws = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), M.uniform("p_partkey", F.lit("hot")).alias("u"))
    return M.breakpoints(draws, M.map_cumulative(M.hotspot_map(spark, 1_000_000, 1e-8)), 1_000_000).select("id", "position")


@query("SELECT p_partkey AS id, CAST(least(greatest(floor(1 + CAST(CAST('0x'||substr(md5(p_partkey||':break'),1,13) AS BIGINT) AS DOUBLE)/pow(2,52)*100000*1e-8/1e-8), 1), 100000) AS BIGINT) AS position FROM part")
def breakpoint_sample(spark, sf):
    draws = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), M.uniform("p_partkey", F.lit("break")).alias("u"))
    return M.breakpoints(draws, M.uniform_map(spark, 100_000, 1e-8), 100_000).select("id", "position")


@query("WITH c AS (SELECT DISTINCT CAST(p_partkey AS BIGINT)*7+3 AS position FROM part), b AS (SELECT position FROM c UNION SELECT 1 UNION SELECT max(position)+1 FROM c) SELECT position AS s, lead(position) OVER (ORDER BY position) AS e FROM b QUALIFY e IS NOT NULL")
def breakpoint_intervals(spark, sf):
    """The intervals between the breakpoints of a sequence that holds all of them."""
    breaks = T.table(spark, sf, "part").select((F.col("p_partkey").cast("long") * 7 + 3).alias("position"))
    return I.between(breaks, breaks.agg(F.coalesce(F.max("position"), F.lit(1))).first()[0])


IV = "WITH v AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS id, CAST(l_partkey AS BIGINT)*10+1 AS s, CAST(l_partkey AS BIGINT)*10+1+CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_linenumber=1)"
MERGED = IV + ", q AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), k AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM q), m AS (SELECT id, min(s) AS s, max(e) AS e FROM k GROUP BY id, island)"


@query(MERGED + " SELECT id, s, e FROM m")
def interval_merge(spark, sf):
    return I.merge(T.intervals(spark, sf))


@query(IV + " SELECT id, 'left' AS side, s, least(e, 5010) AS e FROM v WHERE s < 5010 UNION ALL SELECT id, 'right', greatest(s, 5010), e FROM v WHERE e > 5010")
def interval_split(spark, sf):
    return I.split(T.intervals(spark, sf), 5010)


@query(MERGED + " SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM m a JOIN m b ON a.id + 1 = b.id AND a.s < b.e AND b.s < a.e")
def interval_intersect(spark, sf):
    m = I.merge(T.intervals(spark, sf))
    return I.intersect(m, m.withColumn("id", F.col("id") - 1))


@query(MERGED + " SELECT a.id AS a, b.id AS b, count(*) AS n FROM m a JOIN m b ON a.id < b.id AND a.s < b.e AND b.s < a.e GROUP BY 1, 2")
def interval_overlap_pairs(spark, sf):
    return I.overlapping(I.merge(T.intervals(spark, sf)))


@query(IV + " SELECT id, position FROM (SELECT CAST(l_suppkey AS BIGINT) AS id, CAST(l_partkey AS BIGINT)*10+5 AS position FROM lineitem WHERE l_linenumber=2) p WHERE EXISTS (SELECT 1 FROM v WHERE v.id = p.id AND v.s <= p.position AND p.position < v.e)")
def points_in_intervals(spark, sf):
    pts = T.table(spark, sf, "lineitem").filter("l_linenumber = 2").select(F.col("l_suppkey").cast("long").alias("id"), (F.col("l_partkey").cast("long") * 10 + 5).alias("position"))
    return I.containing(pts, T.intervals(spark, sf))


@query(IV + " SELECT p.id, p.position, (SELECT max(s) FROM v WHERE v.id = p.id AND v.s <= p.position) AS target FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS id, CAST(l_partkey AS BIGINT)*10+5 AS position FROM lineitem WHERE l_linenumber=2) p")
def redirect_asof(spark, sf):
    pts = T.table(spark, sf, "lineitem").filter("l_linenumber = 2").select(F.col("l_suppkey").cast("long").alias("id"), (F.col("l_partkey").cast("long") * 10 + 5).alias("position")).distinct()
    return I.as_of(pts, T.intervals(spark, sf).select("id", F.col("s").alias("at"), F.col("s").alias("target")))


@query(IV + " SELECT id, s, e, unnest(range(CAST(floor(s/1000) AS BIGINT), CAST(floor((e-1)/1000) AS BIGINT)+1)) AS bin FROM v WHERE e > s")
def bin_index(spark, sf):
    return I.bins(T.intervals(spark, sf).filter("e > s"), 1000)


@query("SELECT p_partkey AS id, round(CASE WHEN p_partkey < 1000 THEN 5e-5 ELSE 5e-5*exp(x)/(1-5e-5+5e-5*exp(x)) END, 8) AS p, round(greatest(1000/(1+4*q*(1-q)*0.01), 10), 6) AS ne FROM (SELECT *, CASE WHEN p_partkey < 1000 THEN 5e-5 ELSE 5e-5*exp(x)/(1-5e-5+5e-5*exp(x)) END AS q FROM (SELECT p_partkey, 0.01*(0.5+(1-2*0.5)*5e-5)*(p_partkey-1000)::DOUBLE AS x FROM part))")
def afs_trajectory(spark, sf):
    p = M.trajectory(F.col("t"), 0.01, 0.5, 1000.0)
    rows = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("t"))
    return rows.select("id", F.round(p, 8).alias("p"), F.round(M.ne_sweep(p, 1000.0, 0.01), 6).alias("ne"))


@query("SELECT p_partkey AS id, round(1000/(1+0.01*exp(-abs(p_partkey-500)/1000.0::DOUBLE)), 6) AS ne_directional, round(1000*exp(-1e-8*1000*(0.5+0.5*0.01)/0.01), 6) AS ne_background, CASE WHEN p_partkey = 500 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS s FROM part")
def ne_eff_selection(spark, sf):
    at = F.col("p_partkey")
    return T.table(spark, sf, "part").select(at.alias("id"), F.round(M.ne_directional(at, 1000.0, 0.01, 500), 6).alias("ne_directional"), F.round(M.ne_background(1000.0, 1e-8, -0.01, 0.5), 6).alias("ne_background"), F.when(at == 500, F.lit(0.01)).otherwise(F.lit(0.0)).alias("s"))


@query("WITH r AS (SELECT s_suppkey AS rep, unnest(range(2, 21)) AS k FROM supplier), w AS (SELECT rep, k, -ln(1 - CAST(CAST('0x'||substr(md5(rep||':wait:'||k),1,13) AS BIGINT) AS DOUBLE)/pow(2,52))*4*1000/(k*(k-1)) AS w FROM r) SELECT rep, k, round(sum(w) OVER (PARTITION BY rep ORDER BY k DESC), 4) AS time FROM w")
def coalescent_times(spark, sf):
    params = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rep"), F.lit(20).alias("n"), F.lit(1000.0).alias("ne"))
    return M.coalescent_times(params).select("rep", F.col("k").cast("long").alias("k"), F.round("time", 4).alias("time"))


@query("SELECT p_partkey AS id, round(4*10000.0*1e-8*1000*list_sum(list_transform(range(1, 2*(p_partkey%200+1)), lambda x: 1.0::DOUBLE/x)), 6) AS sites, CASE WHEN p_partkey%200+1 > 100 THEN 'large' ELSE 'small' END AS class FROM part")
def memory_class(spark, sf):
    n = F.col("p_partkey") % 200 + 1
    sites = M.expected_sites(F.lit(10_000.0), F.lit(1e-8), F.lit(1000), n)
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(sites, 6).alias("sites"), M.size_class(n, F.lit(1000), F.lit(1.0)).alias("class"))


@query(SCENARIO + ", t AS (SELECT position, sum(2*p*(1-p)) AS d, count(*) AS k FROM f GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY round(d, 9), position) AS a, row_number() OVER (ORDER BY k, position) AS b FROM t) SELECT round(corr(a, b), 6) AS rho FROM r")
def rank_corr(spark, sf):
    d = Data(spark, sf)
    held = T.carriers(spark, sf, F.col("l_returnflag").alias("scenario")).groupBy("scenario", "position").agg(F.count("*").alias("ac"))
    each = S.frequencies(held, d.n_hap).groupBy("position").agg(F.round(F.sum(2 * F.col("p") * (1 - F.col("p"))), 9).alias("d"), F.count("*").alias("k"))
    return rounded(S.rank_correlation(each, "d", "k", "position"))


@query("SELECT l_returnflag AS scenario, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity)/sqrt(count(*)), 6) AS se FROM lineitem GROUP BY 1")
def sweep_summary(spark, sf):
    return rounded(S.sweep(T.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "scenario"), "scenario", "l_quantity"))


@query(BASE + f", a AS (SELECT {ALL.format(p='').replace('round(avg(p), 6)', 'round(avg(p), 4)').replace('round(count(*) / CAST(max(position)-min(position)+1 AS DOUBLE), 6) AS density', 'round(1000 * (count(*) / CAST(max(position)-min(position)+1 AS DOUBLE)), 2) AS density_per_kb')} FROM f) SELECT n_sites, n_common, mean_af, pi, theta_w, density_per_kb FROM a")
def stats_report(spark, sf):
    return S.rounded_report(S.population(Data(spark, sf).freqs))


@query(BASE + "SELECT count(*) FILTER (least(p, 1-p) > 0.05) AS n_common, count(*) FILTER (NOT least(p, 1-p) > 0.05) AS n_rare, round(count(*) FILTER (least(p, 1-p) > 0.05) / CAST(count(*) AS DOUBLE), 6) AS common_fraction FROM f")
def rare_common(spark, sf):
    return rounded(S.rare_and_common(Data(spark, sf).freqs))


@query(BASE + "SELECT derived, (SELECT count(*) FROM c WHERE ac = derived) AS n_sites FROM (SELECT unnest(range(1, 11)) AS derived)")
def sfs_first_bins(spark, sf):
    d = Data(spark, sf)
    return S.spectrum(d.counts, d.n_hap).filter(F.col("derived").between(1, 10))


@query(BASE + ", r AS (SELECT ind_id, row_number() OVER (ORDER BY ind_id) AS r FROM (SELECT DISTINCT ind_id FROM s)), k AS (SELECT position, row_number() OVER (ORDER BY position) AS c FROM c), q AS (SELECT CAST(p_partkey AS BIGINT) % 60 AS i, CAST(p_partkey AS BIGINT) AS j FROM part) SELECT i, j, CASE WHEN r.r IS NOT NULL AND k.c IS NOT NULL THEN coalesce(g.g, 0) END AS g FROM q LEFT JOIN r ON r.r = i LEFT JOIN k ON k.c = j LEFT JOIN g ON g.ind_id = r.ind_id AND g.position = k.position")
def sparse_lookup(spark, sf):
    d = Data(spark, sf)
    cells = T.table(spark, sf, "part").select((F.col("p_partkey").cast("long") % 60).alias("i"), F.col("p_partkey").cast("long").alias("j"))
    return G.lookup(cells, d.genotypes, d.individuals, d.positions)


@query("WITH r AS (SELECT CAST(l_suppkey AS BIGINT) % 50 AS ind_id, CAST(l_partkey AS BIGINT) % 400 AS position, CAST(l_linenumber AS BIGINT) % 3 AS g, l_orderkey, l_linenumber FROM lineitem), h AS (SELECT ind_id, position, arg_max(g, CAST(l_orderkey AS BIGINT) * 100 + l_linenumber) AS g FROM r GROUP BY 1, 2) SELECT i.ind_id, p.position, coalesce(g, 0) AS g FROM (SELECT DISTINCT ind_id FROM r) i CROSS JOIN (SELECT DISTINCT position FROM r) p LEFT JOIN h ON h.ind_id = i.ind_id AND h.position = p.position")
def long_rows_filled(spark, sf):
    key = lambda c, n, name: (F.col(c).cast("long") % n).alias(name)
    rows = T.table(spark, sf, "lineitem").select(key("l_suppkey", 50, "ind_id"), key("l_partkey", 400, "position"), key("l_linenumber", 3, "g"), "l_orderkey", "l_linenumber")
    return G.last_wins(rows, ["l_orderkey", "l_linenumber"])


@query(BASE + "SELECT string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS line FROM c")
def csv_wide_header(spark, sf):
    return X.wide_header(Data(spark, sf).positions)


@query(SCENARIO + ", w AS (SELECT scenario, position // 20 AS block, sum(2*p*(1-p)) / (max(position)-min(position)+1) AS pi FROM f GROUP BY 1, 2 HAVING count(*) >= 3) SELECT scenario, count(*) AS n, round(avg(pi), 6) AS mean, round(coalesce(stddev_samp(pi)/sqrt(count(*)), 0), 6) AS se FROM w GROUP BY 1")
def sweep_diversity(spark, sf):
    d = Data(spark, sf)
    held = T.carriers(spark, sf, F.col("l_returnflag").alias("scenario"))
    freqs = S.frequencies(held.groupBy("scenario", "position").agg(F.count("*").alias("ac")), d.n_hap).withColumn("block", F.floor(F.col("position") / 20))
    return rounded(S.sweep(S.population(freqs, ["scenario", "block"]).filter("n_sites >= 3"), "scenario", "pi"))


@query(IV + " SELECT id, s, e, unnest(range(CAST(least(greatest(ceil(s/700), 1), 20) AS BIGINT), CAST(least(greatest(ceil(greatest(s, e-1)/700), 1), 20) AS BIGINT)+1)) AS bin FROM v")
def bin_clamped(spark, sf):
    return I.clamped_bins(T.intervals(spark, sf), 700, 20)


@query(IV + " SELECT id, min(s) AS min_start, max(e) AS max_end FROM v GROUP BY 1")
def lineage_bounds(spark, sf):
    return I.bounds(T.intervals(spark, sf))


@query(MERGED + " SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id < b.id AND a.s < b.e AND b.s < a.e ORDER BY 1, 2 LIMIT 1")
def first_overlapping_pair(spark, sf):
    return I.first_overlap(I.merge(T.intervals(spark, sf)))


@query(SCENARIO + "SELECT hap_id, position FROM h WHERE scenario = 'A' UNION SELECT hap_id, position FROM h WHERE scenario = 'N'")
def position_union(spark, sf):
    held = T.carriers(spark, sf, F.col("l_returnflag").alias("scenario"))
    of = lambda x: held.filter(F.col("scenario") == x).select("hap_id", "position")
    return of("A").unionByName(of("N")).distinct()


@query(MERGED + ", cut AS (SELECT id, greatest(s, 1) AS s, least(e, 15001) AS e FROM m WHERE s < 15001), sums AS (SELECT *, coalesce(sum(e-s) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(e-s) OVER (PARTITION BY id) AS total FROM cut), aimed AS (SELECT *, floor(CAST(CAST('0x'||substr(md5(id||':at'),1,13) AS BIGINT) AS DOUBLE)/pow(2,52) * total) AS r FROM sums) SELECT id, CAST(total AS BIGINT) AS total, CAST(s + r - before AS BIGINT) AS position FROM aimed WHERE r >= before AND r < before + e - s")
def interval_sample(spark, sf):
    merged = I.merge(T.intervals(spark, sf))
    draws = merged.select("id").distinct().withColumn("u", M.uniform("id", F.lit("at")))
    return I.sample_position(merged, draws, 15_000)


@query("WITH m AS (SELECT * FROM (VALUES (1, 201, 2e-8, 0.0), (201, 501, 0.0, 200*2e-8), (501, 701, 1e-7, 200*2e-8), (701, 1001, 5e-9, 200*2e-8+200*1e-7)) t(s, e, rate, before)), d AS (SELECT p_partkey AS id, CAST(CAST('0x'||substr(md5(p_partkey||':map'),1,13) AS BIGINT) AS DOUBLE)/pow(2,52)*(200*2e-8+200*1e-7+300*5e-9) AS aim FROM part) SELECT id, CAST(least(greatest(floor(s + (aim-before)/rate), 1), 1000) AS BIGINT) AS position FROM d JOIN m ON rate > 0 AND aim > before AND aim <= before + (e-s)*rate")
def breakpoint_map_sample(spark, sf):
    draws = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), M.uniform("p_partkey", F.lit("map")).alias("u"))
    return M.breakpoints(draws, M.recombination_map(spark, [1, 201, 501, 701, 1001], [2e-8, 0.0, 1e-7, 5e-9]), 1000).select("id", "position")


@query("SELECT p_partkey AS id, 0.0::DOUBLE AS neutral, CASE WHEN p_partkey = 50 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS directional, CASE WHEN p_partkey = 60 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS balancing, -0.02::DOUBLE AS background FROM part")
def selection_coefficients(spark, sf):
    at = F.col("p_partkey")
    models = {"neutral": None, "directional": M.directional(0.01, 0.5, 50, 100.0), "balancing": M.balancing([0.2, 0.1], 60, [0.5, 0.5]), "background": M.background(1e-8, -0.02, 0.1)}
    return T.table(spark, sf, "part").select(at.alias("id"), *[M.coefficient_at(m, at).alias(k) for k, m in models.items()])


@query("WITH q AS (SELECT p_partkey AS id, p_partkey % 90 + 1 AS n, CASE WHEN p_partkey % 5 = 0 THEN 900000 ELSE 20000 END AS len, CASE WHEN p_partkey % 3 = 0 THEN 5e7 ELSE 1e4 END::DOUBLE AS ne FROM part), z AS (SELECT *, 4*ne*1e-8*len*list_sum(list_transform(range(1, 2*n), lambda x: 1.0::DOUBLE/x)) AS sites FROM q), m AS (SELECT id, 2*n*sites/1048576.0 AS genotype_mb, ((2*n-1)*64 + sites*8)/1048576.0 AS tree_mb FROM z), k AS (SELECT *, genotype_mb + tree_mb AS total_mb FROM m), c AS (SELECT *, CASE WHEN total_mb > 1024 THEN 'large' WHEN total_mb > 512 THEN 'medium' ELSE 'small' END AS class FROM k) SELECT id, round(genotype_mb, 6) AS genotype_mb, round(tree_mb, 6) AS tree_mb, round(total_mb, 6) AS total_mb, class, class = 'large' AS compact_nodes, class <> 'small' AS memory_pool, CASE class WHEN 'large' THEN 5000 WHEN 'medium' THEN 10000 ELSE 20000 END AS max_dense_sites, CASE class WHEN 'large' THEN 0.6 WHEN 'medium' THEN 0.7 ELSE 0.8 END::DOUBLE AS sparsity_threshold FROM c")
def memory_settings(spark, sf):
    n, key = F.col("n"), F.col("p_partkey")
    rows = T.table(spark, sf, "part").select(key.alias("id"), (key % 90 + 1).alias("n"), F.when(key % 5 == 0, 900_000).otherwise(20_000).alias("len"), F.when(key % 3 == 0, 5e7).otherwise(1e4).alias("ne"))
    rows = rows.withColumns(M.memory_estimate(F.col("ne"), F.lit(1e-8), F.col("len"), n))
    rows = rows.withColumn("class", M.size_class(n, F.col("len"), F.col("total_mb"))).withColumns(M.memory_settings(F.col("class")))
    return rounded(rows.drop("n", "len", "ne"))


#: A tree over all haplotypes in the shape of a heap, as tables: the driver's tables hold none.
TREE = """WITH RECURSIVE z AS (SELECT count(*) AS n FROM supplier), ids AS (SELECT unnest([CAST(s_suppkey AS BIGINT)+1, CAST(s_suppkey AS BIGINT)+1+n]) AS node_id, n FROM supplier, z),
t AS (SELECT node_id, CASE WHEN node_id < 2*n-1 THEN 2*n - (2*n-node_id)//2 END AS parent_id, CASE WHEN node_id <= n THEN 0 ELSE node_id - n END AS time, n FROM ids WHERE node_id < 2*n),
mu AS (SELECT 1 + CAST(p_partkey AS BIGINT)*31 % (2*n-2) AS node_id, 1 + CAST(p_partkey AS BIGINT)*7 % 1000 AS position FROM part, z),
iv AS (SELECT node_id, CASE WHEN node_id % 3 = 0 THEN 1 ELSE 201 END AS s, CASE WHEN node_id % 3 = 0 THEN 501 ELSE 1001 END AS e FROM t WHERE node_id % 3 <> 1)
"""


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Nodes, mutations and intervals of the tree that TREE gives, and its number of leaves."""
    keys = T.table(spark, sf, "supplier").select((F.col("s_suppkey").cast("long") + 1).alias("a"))
    n, node = keys.count(), F.col("node_id")
    ids = keys.select(F.explode(F.array("a", F.col("a") + n)).alias("node_id")).filter(node < 2 * n)
    parent = F.when(node < 2 * n - 1, 2 * n - F.floor((2 * n - node) / 2)).cast("long")
    nodes = ids.select(F.lit(0).cast("long").alias("rep"), "node_id", parent.alias("parent_id"), F.when(node <= n, 0).otherwise(node - n).cast("double").alias("time"))
    key = F.col("p_partkey").cast("long")
    mutated = T.table(spark, sf, "part").select(F.lit(0).cast("long").alias("rep"), (1 + key * 31 % (2 * n - 2)).alias("node_id"), (1 + key * 7 % 1000).alias("position"))
    third = node % 3
    intervals = nodes.filter(third != 1).select("node_id", F.when(third == 0, 1).otherwise(201).cast("long").alias("s"), F.when(third == 0, 501).otherwise(1001).cast("long").alias("e"))
    return nodes, mutated, intervals, n


@query(TREE + "SELECT CAST(0 AS BIGINT) AS rep, CAST(max(time) AS DOUBLE) AS height, count(*) AS n_nodes, count(*) FILTER (time = 0) AS n_leaves FROM t")
def tree_shape(spark, sf):
    return P.shape(_tree(spark, sf)[0])


@query(TREE + "SELECT node_id, count(*) AS n_mutations FROM mu GROUP BY 1")
def mutation_counts(spark, sf):
    return _tree(spark, sf)[1].groupBy("node_id").agg(F.count("*").alias("n_mutations"))


@query(TREE + "SELECT DISTINCT position FROM mu")
def mutation_positions(spark, sf):
    return _tree(spark, sf)[1].select("position").distinct()


@query(TREE + ", up(node_id, hap_id) AS (SELECT node_id, node_id FROM t WHERE time = 0 UNION ALL SELECT t.parent_id, up.hap_id FROM up JOIN t USING (node_id) WHERE t.parent_id IS NOT NULL) SELECT CAST(0 AS BIGINT) AS rep, CAST(ceil(hap_id/2) AS BIGINT) AS ind_id, position, count(*) AS g FROM (SELECT DISTINCT hap_id, position FROM up JOIN mu USING (node_id)) GROUP BY ALL")
def tree_genotypes(spark, sf):
    nodes, mutated, _, _ = _tree(spark, sf)
    return P.extract_genotypes(nodes, mutated)


@query(TREE + ", k AS (SELECT n - n//5 AS h FROM z), down(node_id, position) AS (SELECT DISTINCT node_id, position FROM mu UNION ALL SELECT t.node_id, d.position FROM down d JOIN t ON t.parent_id = d.node_id LEFT JOIN iv ON iv.node_id = t.node_id WHERE iv.s IS NULL OR d.position >= iv.s AND d.position < iv.e), held AS (SELECT DISTINCT CASE WHEN d.node_id <= h THEN d.node_id ELSE d.node_id - h END AS hap_id, position FROM down d JOIN t ON t.node_id = d.node_id AND t.time = 0, k) SELECT hap_id, position FROM held, k WHERE position IN (SELECT position FROM held GROUP BY 1 HAVING count(*) < (SELECT h FROM k))")
def graph_genotypes(spark, sf):
    nodes, mutated, intervals, n = _tree(spark, sf)
    n_hap = n - n // 5  # the leaves beyond are fragments, each of one haplotype
    samples = nodes.filter((F.col("time") == 0) & (F.col("node_id") > n_hap)).select("node_id", (F.col("node_id") - n_hap).alias("hap_id"))
    return P.inherited(nodes, mutated, intervals, samples, n_hap)


@query(TREE + ", rd AS (SELECT node_id, unnest([300, 600]) AS bp, CASE WHEN (2*n-node_id) % 2 = 0 THEN node_id - 1 ELSE node_id + 1 END AS target FROM t WHERE node_id % 4 = 0 AND node_id < 2*n-2), rs AS (SELECT node_id, bp AS s, coalesce(lead(bp) OVER (PARTITION BY node_id ORDER BY bp), 1000000) AS e, target FROM rd), walk(hap_id, position, node_id, passed) AS (SELECT node_id, x, node_id, CAST(NULL AS BIGINT) FROM t, (SELECT unnest([1, 251, 501, 751]) AS x) WHERE time = 0 UNION ALL SELECT w.hap_id, w.position, CASE WHEN rs.target IS NOT NULL THEN rs.target ELSE t.parent_id END, CASE WHEN rs.target IS NULL THEN t.node_id END FROM walk w JOIN t USING (node_id) LEFT JOIN rs ON rs.node_id = w.node_id AND w.position >= rs.s AND w.position < rs.e LEFT JOIN iv ON iv.node_id = w.node_id WHERE t.parent_id IS NOT NULL AND (rs.target IS NOT NULL OR iv.s IS NULL OR w.position >= iv.s AND w.position < iv.e)) SELECT DISTINCT passed AS node_id, CAST(position AS BIGINT) AS position, hap_id FROM walk WHERE passed IS NOT NULL")
def redirected_carriers(spark, sf):
    nodes, _, intervals, n = _tree(spark, sf)
    node = F.col("node_id")
    sibling = F.when((2 * n - node) % 2 == 0, node - 1).otherwise(node + 1)
    redirects = nodes.filter((node % 4 == 0) & (node < 2 * n - 2)).select("node_id", F.explode(F.array(F.lit(300).cast("long"), F.lit(600).cast("long"))).alias("at"), sibling.alias("target"))
    points = nodes.filter("time = 0").select(node.alias("hap_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 251, 501, 751)])).alias("position"))
    return P.branch_carriers(nodes, intervals, redirects, points)


@query(TREE + ", f AS (SELECT parent_id, min(node_id) AS child FROM t WHERE parent_id IS NOT NULL GROUP BY 1), down(node_id) AS (SELECT node_id FROM t WHERE parent_id IS NULL UNION ALL SELECT child FROM down JOIN f ON parent_id = node_id) SELECT CAST(0 AS BIGINT) AS rep, x AS start, t.node_id, CAST(500 AS BIGINT) AS position FROM down JOIN t USING (node_id), (SELECT unnest([0.0::DOUBLE, 5.0::DOUBLE, 1000000.0::DOUBLE]) AS x) WHERE t.time = 0 AND (SELECT max(time) FROM t) <= x")
def beneficial_mutation(spark, sf):
    nodes = _tree(spark, sf)[0]
    starts = spark.createDataFrame([(0, 0.0), (0, 5.0), (0, 1_000_000.0)], "rep long, start double")
    return P.beneficial(nodes, starts, 500)


@query(TREE + ", up(node_id, hap_id) AS (SELECT node_id, node_id FROM t WHERE time = 0 UNION ALL SELECT t.parent_id, up.hap_id FROM up JOIN t USING (node_id) WHERE t.parent_id IS NOT NULL) SELECT node_id, hap_id FROM up")
def tree_closure(spark, sf):
    """The leaves at or below every node."""
    return P.leaves_below(_tree(spark, sf)[0]).select("node_id", "hap_id")


@query(TREE + ", pt AS (SELECT DISTINCT CASE WHEN node_id <= n THEN node_id + n - 1 ELSE node_id END AS node_id, position FROM mu, z), down(top, position, node_id) AS (SELECT node_id, position, node_id FROM pt UNION ALL SELECT d.top, d.position, t.node_id FROM down d JOIN t ON t.parent_id = d.node_id LEFT JOIN iv ON iv.node_id = t.node_id WHERE iv.s IS NULL OR d.position >= iv.s AND d.position < iv.e) SELECT DISTINCT top AS node_id, position, node_id AS hap_id FROM down WHERE node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)")
def marginal_carriers(spark, sf):
    """The leaves that inherit from an inner node at a position."""
    nodes, mutated, intervals, n = _tree(spark, sf)
    edges = nodes.filter("parent_id IS NOT NULL").join(intervals, "node_id", "left").select("parent_id", F.col("node_id").alias("child_id"), F.coalesce("s", F.lit(1)).cast("long").alias("s"), F.coalesce("e", F.lit(1001)).cast("long").alias("e"))
    inner = F.when(F.col("node_id") <= n, F.col("node_id") + n - 1).otherwise(F.col("node_id"))
    return P.marginal_carriers(edges, mutated.select(inner.alias("node_id"), "position").distinct())


@query(BASE + "SELECT ind_id, position, g FROM g")
def vcf_round_trip(spark, sf):
    """Genotypes written and read by the VCF data source."""
    d = Data(spark, sf)
    path = f"{shared_dir(spark)}/vcf-{uuid.uuid4().hex}"
    vcf.save(d.genotypes, d.individuals, path, compression="bgzf")
    people = numbered(d.individuals, "ind_id", "at").select(F.col("at").alias("ind_id"), F.col("ind_id").alias("id"))  # columns back to ids
    return vcf.load(spark, path, carriers=True).join(people, "ind_id").select(F.col("id").alias("ind_id"), "position", "g")


@query(BASE + "SELECT i.ind_id, c.position, coalesce(g.g, 0) AS g FROM (SELECT DISTINCT ind_id FROM g) i CROSS JOIN c LEFT JOIN g ON g.ind_id = i.ind_id AND g.position = c.position")
def csv_long_filled(spark, sf):
    """Genotypes written as a long CSV file and loaded as the dense table."""
    d = Data(spark, sf)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    X.write(d.genotypes, d.individuals, d.positions, path)
    return X.load_long(spark, path)
