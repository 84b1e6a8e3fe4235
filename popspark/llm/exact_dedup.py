"""Exact deduplication by composable polynomial fingerprints.

A fingerprint of a byte string s of n bytes is (n, s[0]*B^(n-1) + ... + s[n-1] mod P) for two primes P. Fingerprints
of adjoining chunks combine without the bytes: shift the left one by the length of the right one and add. So chunks
of a huge document are hashed apart from each other, in any task, and put together afterwards. Documents of equal
fingerprints are then compared chunk by chunk; a fingerprint that two different texts share is split by their digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import BROADCAST_ROWS, WHITE, join_groups, partitions, ship, written

#: Two primes under 2^31; with both, different texts share a fingerprint once in about 2^62 pairs.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
#: Bytes that are hashed at once, and compared at once.
CHUNK = 1 << 16
#: Texts over so many characters are cut into chunks that any tasks hash.
LONG = 1 << 20


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 mod prime."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:  # what is there, shifted by its own length
        step = pow(base, done, prime)
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step) % np.uint64(prime)
        done += take
    return out[::-1].copy()


def combine(left: tuple, right: tuple, primes: tuple = PRIMES) -> tuple:
    """The fingerprint (n, h1, h2) of two adjoining chunks, from the fingerprints of each."""
    n = left[0] + right[0]
    return (n, *((a * pow(b, right[0], p) + c) % p for a, c, b, p in zip(left[1:], right[1:], BASES, primes)))


class Fingerprint:
    """Fingerprints of byte strings, chunk by chunk."""

    def __init__(self, primes: tuple = PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk = primes, chunk
        self.powers = [_powers(b, p, chunk) for b, p in zip(BASES, primes)]

    def of_chunk(self, data: np.ndarray) -> tuple:
        wide, n = data.astype(np.uint64), len(data)
        return (n, *(int(np.dot(wide, w[len(w) - n :])) % p for w, p in zip(self.powers, self.primes)))

    def of(self, data: bytes) -> tuple:
        whole, out = np.frombuffer(data, dtype=np.uint8), (0, 0, 0)
        for at in range(0, len(whole), self.chunk):
            part = self.of_chunk(whole[at : at + self.chunk])
            out = combine(out, part, self.primes) if at else part
        return out


def fingerprint(text: Column, primes: tuple = PRIMES, chunk: int = CHUNK) -> Column:
    """struct(n, h1, h2) of a string column in UTF-8."""

    @F.pandas_udf("n long, h1 long, h2 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Fingerprint(primes, chunk)
        for s in batches:
            yield pd.DataFrame([f.of(x.encode("utf-8", "surrogatepass")) for x in s], columns=["n", "h1", "h2"])

    return run(text)


def combine_parts(parts: DataFrame, key: str, order: str, fp: str, primes: tuple = PRIMES) -> DataFrame:
    """One fingerprint for each key from the fingerprints of its parts, which any tasks may have hashed.

    A key's parts are combined in their order; only fingerprints move, never bytes.
    """

    @F.pandas_udf("n long, h1 long, h2 long")
    def fold(lists: pd.Series) -> pd.DataFrame:
        out = []
        for found in lists:
            whole = (0, 0, 0)
            for x in found:
                whole = combine(whole, (x["n"], x["h1"], x["h2"]))
            out.append(whole)
        return pd.DataFrame(out, columns=["n", "h1", "h2"])

    one = F.struct(F.col(order).alias("at"), F.col(f"{fp}.n").alias("n"), F.col(f"{fp}.h1").alias("h1"), F.col(f"{fp}.h2").alias("h2"))
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("parts")).select(key, fold("parts").alias(fp))


def normalised(text: Column) -> Column:
    """text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _cut(keys: list[str], chunk: int):
    """Rows of keys with each of their text's chunks: at, piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, norm in pdf[[*keys, "norm"]].itertuples(index=False):
                places = list(range(0, max(1, len(norm)), chunk))
                for at in range(0, len(places), 64):
                    some = places[at : at + 64]
                    yield pd.DataFrame(dict(zip(keys, key)) | {"at": [i // chunk for i in some], "piece": [norm[i : i + chunk] for i in some]})

    return run


def fingerprints(texts: DataFrame, primes: tuple = PRIMES, chunk: int = CHUNK, long: int = LONG, limit: int = BROADCAST_ROWS) -> DataFrame:
    """texts (with columns norm and text_sha256) without norm but with n, h1 and h2, its fingerprint.

    Chunks of texts over long characters are rows of their own, hashed in any task and combined by their order; rows
    that share a digest are hashed once.
    """
    spark = texts.sparkSession
    short = texts.filter(F.length("norm") <= long).withColumn("fp", fingerprint(F.col("norm"), primes, chunk))
    huge = texts.filter(F.length("norm") > long)
    cut = huge.select("text_sha256", "norm").mapInPandas(_cut(["text_sha256"], chunk), "text_sha256 string, at long, piece string")
    hashed = cut.repartition(partitions(spark), "text_sha256", "at").select("text_sha256", "at", fingerprint(F.col("piece"), primes, chunk).alias("fp"))
    whole = written(combine_parts(hashed.dropDuplicates(["text_sha256", "at"]), "text_sha256", "at", "fp", primes), "whole")
    few = whole.limit(limit + 1).count() <= limit
    both = short.drop("norm").unionByName(huge.drop("norm").join(F.broadcast(whole) if few else whole, "text_sha256"))
    return both.select(*[c for c in both.columns if c != "fp"], "fp.*")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes: tuple = PRIMES, chunk: int = CHUNK, limit: int = BROADCAST_ROWS, long: int = LONG, row: str | None = None) -> DataFrame:
    """Groups of documents whose texts are equal after deleting white space.

    Returns a row for each row of docs, whatever else docs holds: doc_id, keep_id, group_size, kept, text_sha256 and
    n_chars. The row with the most code points in its original text stays, then that of the smallest doc_id (null
    last), then any one of repeated rows. Null texts and texts of white space only are equal to the empty text.
    Texts of any length are taken whole. An empty table gives an empty result.

    row names a binary column that tells rows apart and goes into the result; of ties the smallest row stays, and all
    rows that share it.
    """
    spark = docs.sparkSession
    ship(spark)
    key, fp = ["n", "h1", "h2", "same"], ["n", "h1", "h2"]
    raw = F.coalesce(F.col(text), F.lit(""))
    more = [] if row is None else ["row"]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.length(raw).cast("long").alias("n_chars"), normalised(F.col(text)).alias("norm"), *[F.col(row).alias("row") for _ in more])
    found = fingerprints(base.withColumn("text_sha256", F.sha2("norm", 256)), primes, chunk, long, limit)
    rows = written(found if more else found.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    sizes = written(rows.groupBy(*fp).agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated")
    # Equal fingerprints: every chunk must be the same in all texts of the group, which the smallest and the largest tell.
    few = sizes.limit(limit + 1).count() <= limit
    again = rows.join(F.broadcast(sizes.select(*fp)), fp) if few else join_groups(rows, sizes, fp, "rows", sizes.agg(F.sum("rows")).first()[0])
    wanted = written(again.groupBy("text_sha256", *fp).agg(F.count("*").alias("rows")), "wanted")
    texts = docs.select(normalised(F.col(text)).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    few = wanted.limit(limit + 1).count() <= limit
    texts = texts.join(F.broadcast(wanted), "text_sha256") if few else join_groups(texts, wanted, ["text_sha256"], "rows", rows.count())
    pieces = texts.select(*fp, "norm").mapInPandas(_cut(fp, chunk), "n long, h1 long, h2 long, at long, piece string")
    compared = pieces.groupBy(*fp, "at").agg((F.min("piece") != F.max("piece")).alias("differ"))
    clash = written(compared.filter("differ").select(*fp).distinct(), "clashes")
    if clash.isEmpty():
        rows = rows.withColumn("same", F.lit(""))
    else:  # texts that share a fingerprint only
        rows = rows.join(clash.withColumn("clash", F.lit(True)), fp, "left").withColumn("same", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
    first = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = written(rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(first).alias("first")), "groups")
    joined = join_groups(rows, groups, key, "group_size", rows.count())
    return joined.select("doc_id", *more, F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "n_chars")
