"""The training-data pipeline over documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from popspark.llm.common import null_safe, shared_dir, ship, table, without, written

#: Words in a shingle of the near_dedup stage; operator 8's own query takes four.
WORDS = 5


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _row_key(docs: DataFrame, *more: str) -> Column:
    """A digest of doc_id, text and further columns, each after its length: rows that share it count as the same document."""
    parts = [*null_safe(F.col("doc_id"), *map(F.col, more)), F.coalesce("text", F.lit(""))]
    return F.unhex(F.md5(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that operator 9 predicts to be toxic; it learns from the labels of documents given.

    Null and empty texts stay, repeated rows stay or go together, and an empty table gives an empty one.
    """
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.chance(model)(F.col("text")) < toxicity.CUT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text keep the one that operator 2 keeps.

    Null texts count as empty, and of all empty ones one row stays. An id, null or not, may stand on several rows:
    of rows that share id and text one stays, and rows of other texts under the id of a copy are left alone.
    """
    row = _fresh(docs, "row_key")
    keyed = docs.withColumn(row, _row_key(docs))
    found = exact_dedup.exact_dedup(keyed, row=row).select(F.col("row").alias(row), "kept", F.lit(True).alias("once"))
    return _one_of_each(docs, keyed, row, found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component that operator 8 finds in shingles of five words keep one document, that of the smallest doc_id.

    Null texts and texts without words are linked with nothing and all stay. An id, null or not, may stand on several
    rows: of rows that share id and text one stays, and rows of other texts under the id of a copy are left alone.
    """
    row = _fresh(docs, "row_key")
    keyed = docs.withColumn(row, _row_key(docs))
    found = near_dedup.near_dedup(keyed, words=WORDS, row=row).select(F.col("row").alias(row), "kept", (F.col("n_shingles") > 0).alias("once"))
    return _one_of_each(docs, keyed, row, found)


def _one_of_each(docs: DataFrame, keyed: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """The rows whose key is kept; of several rows of a key that counts once the first one."""
    keys = written(found.groupBy(row).agg(F.max("kept").alias("kept"), F.max("once").alias("once"), F.count("*").alias("size")), "keys")
    rest = without(keyed, keys.filter("not kept").select(row), row)
    repeated = keys.filter("kept and once and size > 1").select(row)
    if repeated.isEmpty():  # so texts move only if there are any
        return rest.select(*docs.columns)
    whole = F.struct(*docs.columns)
    some = rest.join(repeated, row, "left_semi").groupBy(row).agg(F.min_by(whole, F.to_json(whole)).alias("first")).select("first.*")
    return without(rest, repeated, row).select(*docs.columns).unionByName(some)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as operator 5 takes it; its order goes by a digest of doc_id, text and source.

    Documents without words are taken as often as their source's whole repeats. Rows that are alike in all three are
    each taken as often as the one of them that is taken most. An empty table gives an empty one.
    """
    row, times = _fresh(docs, "row_key"), _fresh(docs, "times")
    keyed = docs.withColumn(row, F.hex(_row_key(docs, "source")))
    taken = mixing.mix(keyed, doc_id=row).filter("repeats > 0").groupBy(F.col("doc_id").alias(row)).agg(F.max("repeats").alias(times))
    taken = written(taken, "taken")
    few = taken.limit(1_000_001).count() <= 1_000_000
    joined = keyed.join(F.broadcast(taken) if few else taken, row)
    copies = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(_fresh(docs, "copy"))
    return joined.select(*docs.columns, copies).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, by operator 7. Null and empty texts are a piece of one token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, signatures and tokens can't be expressed in SQL; a test holds run() against a plain version row for row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
