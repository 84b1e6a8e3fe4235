"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Only the lengths of pieces decide where they go, and there are at most as many lengths as a sequence has tokens. So
the packing of a corpus of any size is planned on its histogram of lengths: bins of equal remaining capacity form runs,
a segment tree over the capacities finds the tightest open one for a piece, and one step places all pieces of a length
that the run takes. The plan places every piece by its rank among pieces of its length; ranks come from a shuffle.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popspark.llm.common import copied, ship, written

MAX_TOKENS = 2048
#: Pieces of one length are ranked in buckets of about so many, as one length may hold a third of all pieces.
BUCKET_ROWS = 65_536
TOKENIZER = "word_bpe_49k.json"
#: Distinct words whose ids a worker process remembers, some 200 bytes each.
REMEMBERED = 400_000
SEPARATOR = 0
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class CapacityTree:
    """A segment tree over capacities 0..size that finds the smallest one at or above a bound which has an open bin."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size.bit_length())
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:  # up until a right sibling has an open bin, then down to its leftmost
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple]:
    """Best-fit decreasing for counts of lengths: rows (length, first rank, last rank + 1, first bin, pieces for each bin, offset).

    The piece of rank r lies in bin first_bin + (r - first) // each, at offset + (r - first) % each * length.
    """
    tree, runs, bins, out = CapacityTree(size), defaultdict(deque), 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first, n = runs[capacity].popleft()
                tree.add(capacity, -n)
            each = capacity // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, size - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last bin takes fewer pieces
                out.append((length, rank, rank + left, first + full, left, size - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return out


def _shown(data: bytes) -> str:
    """Bytes as the characters that byte-level tokenizers show them as: printable ones as themselves, the others from U+0100 on."""
    return charmap_decode(data, "strict", _SHOWN)[0]


_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _PRINTED]
_SHOWN = "".join(chr(b if b in _PRINTED else 256 + _HIDDEN.index(b)) for b in range(256))
#: Words in which the tokenizer's cuts are surely known, and these cuts.
_PLAIN = re.compile("[!-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
_CUTS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Here case counts, or lower case isn't made letter by letter: special tokens, the final sigma, the dotted I.
_KEEP_CASE = ("<|", "\u03a3", "\u0130")
#: Python's split takes these for white space, the tokenizer doesn't.
_NO_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class Ids(dict):
    """The ids of a word, as little-endian unsigned 32-bit bytes; words are remembered up to a bound.

    The tokenizer cuts between letters, digits and punctuation and ignores case, so a word is looked up by these parts
    in lower case. Letters alone go to the tokenizer's model straight away, what is cut no further through all of it.
    Words are remembered in two halves: when the newer is full it becomes the older, and words in use move back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.older: dict[str, bytes] = {}
        self.bytes_of = [i.to_bytes(4, "little") for i in range(max(self.whole.get_vocab().values()) + 1)]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) < 100:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        if word.isalpha():
            if word.lower() == word and (word.isascii() or is_normalized("NFC", word)):
                return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(word if word.isascii() else _shown(word.encode()))])
        else:
            core = word.rstrip(punctuation)
            if core != word and core.isalpha() and core.lower().isalpha() and is_normalized("NFC", core):
                return self[core] + self[word[len(core) :]]
            if _PLAIN.fullmatch(word) and "<|" not in word and len(parts := _CUTS.findall(word)) > 1:
                return b"".join(map(self.__getitem__, parts))
        return b"".join([self.bytes_of[i] for i in self.whole.encode(word, add_special_tokens=False).ids])

    def of(self, text: str) -> bytes:
        """Words are cut at white space, where the tokenizer itself always cuts."""
        if is_normalized("NFC", text) and not any(map(text.__contains__, _KEEP_CASE)):
            lower = text.lower()
            if is_normalized("NFC", lower):  # a mark may join a small letter but not the capital
                text = lower
        words = re.split("[ \t\n\r]+", text) if any(map(text.__contains__, _NO_SPACE)) else text.split()
        return b"".join(map(self.__getitem__, words))


@cache
def _ids(path: str) -> Ids:
    """One for each worker process, so its later tasks know the words of earlier ones."""
    return Ids(path)


def _tokenise(path: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = _ids(path), SEPARATOR.to_bytes(4, "little")
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                data = memoryview(ids.of(text or "") + end)
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64", "piece": "int32"})

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", size: int = MAX_TOKENS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizer file, by default that of the public word tokenizer. A document is its ids
    and then id 0; a null or empty text is id 0 alone. Documents over size tokens are cut into pieces of that size.
    Repeated rows are packed each for itself; equal pieces are one row with a count until they get their places, however
    many there are. Pieces of equal length trade places by hash, which reruns repeat. A text of any length is cut by one
    task. An empty table gives an empty result. Whatever else docs holds is left alone, and its names don't matter.
    """
    spark = docs.sparkSession
    ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInPandas(_tokenise(tokenizer, size), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces.groupBy(*PIECE).agg(F.count("*").alias("n")), "pieces")
    lengths = written(pieces.groupBy("length").agg(F.sum("n").alias("pieces"), F.max("n").alias("most"), F.ceil(F.count("*") / bucket_rows).alias("buckets")), "lengths")
    histogram, most = {}, 0
    for r in lengths.collect():  # size rows at most
        histogram[r["length"]], most = r["pieces"], max(most, r["most"])
    steps = np.array(plan(histogram, size), dtype=np.int64).reshape(-1, 6)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    sent = spark.sparkContext.broadcast(steps[order])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        known = sent.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        base = np.int64(1) << 48
        at = np.searchsorted(known[:, 0] * base + known[:, 1], n * base + r, side="right") - 1
        step, ahead = known[at], r - known[at, 1]
        return pd.DataFrame({"sequence_id": step[:, 3] + ahead // step[:, 4], "offset": step[:, 5] + ahead % step[:, 4] * n})

    pieces = pieces.join(F.broadcast(lengths.select("length", "buckets")), "length").withColumn("bucket", F.pmod(F.xxhash64(*PIECE), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("length", "bucket").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    own = Window.partitionBy("length", "bucket").orderBy(*PIECE).rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, ["length", "bucket"])
    placed = copied(ranked, "n", most).withColumn("at", place("length", F.col("before") + F.col("own") + F.col("copy")))
    return placed.select(*PIECE, "at.sequence_id", "at.offset")
