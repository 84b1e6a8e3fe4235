"""The queries of this folder's operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm import exact_dedup, fill_middle, html_text, language, manifest, mixing, near_dedup, packing, pieces, quality, toxicity, url_filter, warc
from popspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the time of its capture; the table has none, so page_id gives one in 2024."""
    seconds = F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 48_271, F.lit(31_536_000))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(seconds).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A log of list entries for the hosts of pages, as the tables hold no list: a hash of the host gives kinds and days."""
    n = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 7), 16, 10).cast("long")
    hosts = pages.select(url_filter.address(F.col("url"))["host"].alias("host")).distinct().withColumn("n", n)
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    day = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400)
    row = lambda when, pattern, category, action, d: F.when(when, F.struct(pattern.alias("pattern"), F.lit(category).alias("category"), F.lit(action).alias("action"), day(d).alias("at")))
    host, n = F.col("host"), F.col("n")
    rows = F.array(
        row(n % 3 == 0, host, "spam", "add", n % 200),
        row(n % 3 == 0, host, "spam", "remove", n % 200 + 20 + n % 90),
        row(n % 6 == 0, host, "spam", "add", n % 200 + 65 + n % 90),
        row(n % 2 == 0, F.concat(host, F.lit("/en")), "mature", "add", n % 300),
        row(n % 5 == 0, domain, "malware", "add", n % 330),
        row(n % 5 == 0, domain, "malware", "remove", n % 330 + 40),
    )
    return hosts.select(F.explode(rows).alias("r")).filter("r is not null").select("r.*")


def op1_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.evaluate(captures(spark, sf_dir), dated_list(table(spark, sf_dir, "pages")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The fields of a row that its leaf covers.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proofs of all rows, and the root that each gives where a third of the rows was tampered with."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    given = manifest.digest(*[tampered if c == "text" else F.col(c) for c in FIELDS])
    found = manifest.manifest(docs.withColumn("given", given), FIELDS, keep=["given"])
    found = found.withColumn("folded_root", manifest.folded(F.col("given"), F.col("slots"), F.col("proof")))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"))
    ids, text = F.sha2(F.array_join("ids", ","), 256), F.sha2(pieces.decoded(F.col("ids")), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), text.alias("decoded_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS mark
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS w
  FROM d GROUP BY source
), capped(step, names) AS (  -- clamp all that are above, again and again
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT step + 1, names || (SELECT coalesce(list(coalesce(source, chr(0))), []) FROM s
    WHERE NOT list_contains(names, coalesce(source, chr(0)))
      AND w * ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE list_contains(names, coalesce(source, chr(0)))))
        > 3 * source_size * (SELECT sum(w) FROM s WHERE NOT list_contains(names, coalesce(source, chr(0)))))
  FROM capped WHERE step < (SELECT count(*) FROM s)
), last AS (SELECT names FROM capped ORDER BY step DESC LIMIT 1), t AS (
  SELECT s.source, source_size, CASE WHEN list_contains(names, coalesce(s.source, chr(0))) THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(w * ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE list_contains(names, coalesce(source, chr(0))))) AS DOUBLE)
       / CAST((SELECT sum(w) FROM s WHERE NOT list_contains(names, coalesce(source, chr(0)))) AS DOUBLE) END AS target
  FROM s, last
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark % 1024, d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN ahead + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, to_timestamp(1704067200 + (page_id * 48271) % 31536000) AT TIME ZONE 'UTC' AS fetched,
         lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
         rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS path
  FROM pages
), h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS n FROM c
), log AS (
  SELECT host AS pattern, 'spam' AS category, 'add' AS action, n % 200 AS day FROM h WHERE n % 3 = 0
  UNION ALL SELECT host, 'spam', 'remove', n % 200 + 20 + n % 90 FROM h WHERE n % 3 = 0
  UNION ALL SELECT host, 'spam', 'add', n % 200 + 65 + n % 90 FROM h WHERE n % 6 = 0
  UNION ALL SELECT host || '/en', 'mature', 'add', n % 300 FROM h WHERE n % 2 = 0
  UNION ALL SELECT regexp_extract(host, '[^.]*\.?[^.]*$', 0), 'malware', 'add', n % 330 FROM h WHERE n % 5 = 0
  UNION ALL SELECT regexp_extract(host, '[^.]*\.?[^.]*$', 0), 'malware', 'remove', n % 330 + 40 FROM h WHERE n % 5 = 0
), state AS (
  SELECT pattern, category, to_timestamp(1704067200 + day * 86400) AT TIME ZONE 'UTC' AS since, bool_and(action = 'add') AS active
  FROM log GROUP BY ALL
), valid AS (
  SELECT *, coalesce(lead(since) OVER (PARTITION BY pattern, category ORDER BY since), TIMESTAMP '9999-12-31') AS until FROM state
), hit AS (
  SELECT c.page_id, v.pattern, v.category
  FROM c JOIN valid v ON v.active AND c.fetched >= v.since AND c.fetched < v.until
   AND (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern) OR c.host || c.path = v.pattern OR starts_with(c.host || c.path, v.pattern || '/') AND contains(v.pattern, '/'))
)
SELECT c.page_id, c.host, c.fetched, count(hit.pattern) > 0 AS blocked, count(hit.pattern) AS n_active,
       max_by(hit.pattern, contains(hit.pattern, '/')::INT * 1000 + length(hit.pattern)) AS pattern,
       coalesce(string_agg(DISTINCT hit.category, ',' ORDER BY hit.category), '') AS categories
FROM c LEFT JOIN hit USING (page_id) GROUP BY ALL
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), k AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _merkle_sql(levels: int = 7, upper: int = 3) -> str:
    """Trees of up to 8^levels leaves, and of 8^upper groups, one level of nodes after another."""
    coded = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v} END"
    leaf = lambda text: "sha256(" + " || ".join(coded(c, text if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "4294967295 - list_reduce([4294967295] || list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    ctes = [
        f"d AS (SELECT *, CAST(doc_id AS VARCHAR) AS key, {leaf('text')} AS leaf, {leaf(lower)} AS changed FROM documents)",
        f"r AS (SELECT doc_id, lang, leaf, CASE WHEN ({crc}) % 3 = 0 THEN changed ELSE leaf END AS given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT lang AS g, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM r)",
    ]
    top, grow = f"a{levels}", lambda x, n: [f"{x}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, CAST(ceil(any_value(n) / 8.0) AS BIGINT) AS n FROM {x}{k} GROUP BY 1, 2)" for k in range(n)]
    run = lambda x, n: [f"{x}r{k} AS (SELECT g, i, d, n, string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, i // 8 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {x}{k})" for k in range(n)]
    ctes += grow("a", levels) + run("a", levels)
    ctes += [f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n, g AS lang FROM {top})"]
    ctes += grow("b", upper) + run("b", upper)
    ctes += [f"f0 AS (SELECT r.doc_id, r.leaf, r.lang, r.i, b0.i AS j, b0.d AS subroot, (SELECT d FROM b{upper}) AS root, given AS f, '' AS proof FROM r JOIN b0 ON r.lang IS NOT DISTINCT FROM b0.lang)"]
    for k in range(levels + upper):
        x, h, at, g = ("a", k, "i", "f.lang") if k < levels else ("b", k - levels, "j", "0")
        slot, many = f"64 * CAST(x.i % 8 AS INTEGER)", "x.n > 1"
        ctes.append(f"f{k + 1} AS (SELECT f.* EXCLUDE (f, proof), CASE WHEN {many} THEN sha256(substr(run, 1, {slot}) || f || substr(run, {slot} + 65)) ELSE f END AS f, CASE WHEN {many} THEN proof || substr(run, 1, {slot}) || substr(run, {slot} + 65) ELSE proof END AS proof FROM f{k} f JOIN {x}r{h} x ON x.g IS NOT DISTINCT FROM {g} AND x.i = f.{at} // {8**h})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{levels + upper}"


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_dated_url_lists, op2_exact_dedup, op3_warc_zstd, op4_language_backoff, op5_mix_sources, op6_host_suffix_array, op7_best_fit_packing, op8_minhash_near_dedup, op9_toxicity, op10_quality_outliers, op11_fill_middle, op12_merkle_manifest, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op1_dated_url_lists": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_warc_zstd": OP3_SQL, "op5_mix_sources": OP5_SQL, "op11_fill_middle": OP11_SQL, "op12_merkle_manifest": _merkle_sql()}
