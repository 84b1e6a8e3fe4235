"""URL filters whose list entries are dated.

A list is a log: at some time a pattern was added under a category, at another it was removed. The log becomes
intervals of validity, and an as-of join holds every capture against the entries that were active when it was fetched.
A pattern is a host, which also covers its subdomains, or a host with a path, which covers what lies below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.llm.common import BROADCAST_ROWS, join_groups, written

FAR = "9999-12-31 00:00:00"


def address(url: Column) -> Column:
    """Host and path of a URL: lower-case host without user or port, no query, fragment or slash at the end."""
    bare = F.regexp_replace(F.trim(url), r"^(?i)[a-z][a-z0-9+.-]*:", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^//", ""), r"[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/]*", 0), r"^.*@", ""), r":\d*$", ""))
    return F.struct(F.rtrim(host, F.lit(".")).alias("host"), F.rtrim(F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1), F.lit("/")).alias("path"))


def patterns(host: Column, path: Column, deepest: int) -> Column:
    """The patterns that cover an address, the most specific first: path after path, none of more steps than deepest, then host after host."""
    steps = F.split(path, "/", deepest + 1)
    paths = F.transform(F.sequence(F.least(F.size(steps), F.lit(max(2, deepest))), F.lit(2), F.lit(-1)), lambda n: F.concat(host, F.array_join(F.slice(steps, 1, n), "/")))
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    return F.array_distinct(F.when(F.size(steps) > 1, F.concat(paths, hosts)).otherwise(hosts))


def intervals(log: DataFrame) -> DataFrame:
    """From a log (pattern, category, action, at) to intervals (pattern, category, since, until), until excluded.

    action is add or remove; of both at one time the removal counts. Rows with a null in any of the four are left out,
    and an entry that is never removed stays active.
    """
    log = log.select("pattern", "category", "action", "at").dropna().filter(F.col("action").isin("add", "remove"))
    state = log.groupBy("pattern", "category", "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    then = F.lead("at").over(Window.partitionBy("pattern", "category").orderBy("at"))
    return state.withColumn("until", F.coalesce(then, F.lit(FAR).cast("timestamp"))).filter("on = 1").select("pattern", "category", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, log: DataFrame, capture_id: str = "page_id", url: str = "url", at: str = "fetched", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Each capture with what was active against it: its id, host, fetched, blocked, n_active, pattern, categories.

    n_active counts active pairs of pattern and category, pattern is the most specific active one, categories are all
    of them in order. A null url or time matches nothing; its host is empty. Repeated rows are each evaluated. Empty
    captures give an empty result, an empty log blocks nothing.
    """
    rows = captures.select(F.col(capture_id).alias("capture"), address(F.coalesce(F.col(url), F.lit(""))).alias("a"), F.col(at).cast("timestamp").alias("fetched"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "capture", "a.host", "a.path", "fetched"), "captures")
    entries = intervals(log).groupBy("pattern").agg(F.collect_list(F.struct("category", "since", "until")).alias("entries"))
    entries = written(entries, "entries")
    deepest = entries.agg(F.max(F.size(F.split("pattern", "/")))).first()[0] or 1
    each = rows.filter("fetched is not null and host != ''").select("row", "fetched", F.posexplode(patterns(F.col("host"), F.col("path"), deepest)).alias("rank", "pattern"))
    if entries.limit(limit + 1).count() <= limit:
        met = each.join(F.broadcast(entries), "pattern")
    else:  # a long list: the shuffle splits patterns that many captures share
        sizes = written(each.groupBy("pattern").agg(F.count("*").alias("size")).join(entries, "pattern"), "met")
        each = each.join(sizes.select("pattern"), "pattern", "left_semi")
        met = join_groups(each, sizes, ["pattern"], "size", rows.count()).drop("size")
    active = F.filter("entries", lambda e: (e["since"] <= F.col("fetched")) & (F.col("fetched") < e["until"]))
    met = met.withColumn("active", active).filter(F.size("active") > 0)
    hits = met.groupBy("row").agg(F.sum(F.size("active")).alias("n_active"), F.min(F.struct("rank", "pattern")).alias("first"), F.flatten(F.collect_list(F.col("active.category"))).alias("categories"))
    out = rows.join(hits, "row", "left")
    return out.select(
        F.col("capture").alias(capture_id), "host", "fetched", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("first.pattern").alias("pattern"), F.coalesce(F.array_join(F.sort_array(F.array_distinct("categories")), ","), F.lit("")).alias("categories"),
    )
