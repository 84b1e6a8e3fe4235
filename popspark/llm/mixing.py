"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source gets words in proportion to its weight, but at most max_epochs times what it has; what a capped source
can't take is shared among the others by weight, until none is above its cap. Sorted by cap over weight, a source is
capped if and only if all before it are and its share of the rest still exceeds its cap, so one ordered pass decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.llm.common import WORD, copied, null_safe, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of a source are dealt over so many buckets, so a source of a third of all rows isn't one group.
BUCKETS = 1024
#: With more rows than so many for each bucket, buckets are halved until they hold about so many.
BUCKET_ROWS = 100_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Words to take from each source: sizes has a row (source, source_size) for each; adds weight, capped, target.

    Sources are ranked by code point, null last. One row for each source is all that is ordered here.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumns({"filled": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after), "all": F.sum("source_size").over(all_rows)})
    exact = "decimal(38,0)"
    capped = (F.col("weight") * (F.col("all") - F.col("filled"))).cast(exact) > (F.col("cap").cast("decimal(19,0)") * F.col("open").cast("decimal(18,0)")).cast(exact)
    ranked = ranked.withColumn("capped", capped)
    rest = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows)
    shared = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_rows)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / shared.cast("double"))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "capped", "target")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """How often each document is taken so that its source comes to its target.

    Returns a row for each row of docs: doc_id, size (words), source_size, target, taken (words, repeats counted) and
    repeats. Every document is taken floor(target / source_size) times; the rest of the target is filled with further
    whole documents in an order that a hash of seed and doc_id gives, up to the one whose middle is beyond it. So a
    source misses its target by half a document at most, and reruns agree. Null sources form a source of their own;
    documents without words, and all of a source without words, take 0. Repeated rows count each for itself; rows that
    share source, doc_id (or have none) and size are one row with a count until the end, however many there are. Only
    the number of a text's words is used, so texts may have any length. An empty table gives an empty result. Whatever
    else docs holds is left alone, and its names don't matter.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string")).cast("binary")), 1, 15)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.conv(mark, 16, 10).cast("long").alias("mark"))
    rows = written(rows.groupBy("source", "mark", "doc_id", "size").agg(F.count("*").alias("n")), "sizes")
    # A mark has 60 bits. Buckets in their order, and marks in theirs within each, give the same order for any number of halvings.
    halved = max(0, (rows.count() // (BUCKETS * bucket_rows)).bit_length())
    bucket = F.col("mark") % BUCKETS * (1 << halved) + F.shiftright("mark", 60 - halved)
    rows = rows.withColumns({"of": null_safe(F.col("source"))[0], "bucket": bucket})
    dealt = written(rows.groupBy("of", "source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("n").alias("most")), "buckets")
    most = dealt.agg(F.max("most")).first()[0] or 0
    sources = targets(dealt.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    sources = sources.withColumn("of", null_safe(F.col("source"))[0]).drop("source")
    run = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = dealt.withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0))).join(sources, "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    own = Window.partitionBy("of", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("source").withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("n")).over(own), F.lit(0)))
    placed = placed.join(plan.select("of", "bucket", "start", "source_size", "target", "whole", "part"), ["of", "bucket"])
    placed = copied(placed, "n", most)
    more = (F.col("start") + F.col("ahead") + F.col("copy") * F.col("size") + F.col("size") / 2 < F.col("part")).cast("long")
    placed = placed.withColumn("repeats", F.col("whole") + more)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats")
