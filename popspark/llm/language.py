"""Language identification, words first: known words score by their frequency in each language, others by shorter and shorter pieces.

Words of a bounded sample of labelled texts are counted by language; character n-grams of these words are counted
likewise. A text's word that is known adds its log frequencies. One that isn't adds the mean over its n-grams of the
greatest length of which any is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import bounded_sample, ship

#: Labelled texts that the model is fitted on, at most, in order of a hash of their ids.
TRAIN_DOCS = 12_000
#: Words and n-grams that the model holds, at most: the most frequent ones.
WORDS, GRAMS = 150_000, 150_000
LONGEST = 5
SMOOTH = 0.1
#: Words that a task remembers besides those of the model; longer ones than LONG letters are read in pieces of that length.
REMEMBERED, LONG = 100_000, 64
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LONG)


def pieces(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _logs(counts: pd.DataFrame, langs: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Rows of log frequencies by language, each less its mean, and where each key's row is."""
    table = counts.pivot_table(index="key", columns="lang", values="n", fill_value=0.0).reindex(columns=langs, fill_value=0.0)
    logs = np.log((table.to_numpy(float) + SMOOTH) / (totals + SMOOTH * len(table)))
    return {k: i for i, k in enumerate(table.index)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    known: dict[str, int] = field(default_factory=dict)

    def backoff(self, word: str) -> np.ndarray:
        get = self.grams.get
        for n in range(LONGEST, 0, -1):
            at = [i for i in map(get, pieces(word, n)) if i is not None]
            if at:
                return self.gram_logs[at].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """The language and its score of each text in lower case."""
        if len(self.known) > len(self.words) + REMEMBERED or not self.known:
            self.known, self.logs = dict(self.words), self.word_logs
        found = [_LETTERS.findall(t) if t else [] for t in texts]
        known = self.known
        fresh = list(dict.fromkeys(w for f in found for w in f if w not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.logs = np.concatenate([self.logs, [self.backoff(w) for w in fresh]]).astype(np.float32)
        names, scores = [], []
        for f, t in zip(found, texts):
            if not self.langs or not any(map(str.isalpha, f)) and not any(map(str.isalpha, t or "")):
                names.append("und")
                scores.append(0.0)
                continue
            total = self.logs[np.fromiter(map(known.__getitem__, f), np.int64, len(f))].sum(axis=0) / max(1.0, len(f) ** 0.5)
            chance = np.exp(total - total.max())
            best = int(np.argmax(chance))
            names.append(self.langs[best])
            scores.append(float(chance[best] / chance.sum()))
        return names, scores


def _grams(word: Column, n: int) -> Column:
    """The n-grams of a string column as an array; none where it is shorter."""
    starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))


def train(labelled: DataFrame, most: int = TRAIN_DOCS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model from rows (doc_id, text, lang) with a language, at most so many. Only the model's counts come to the driver."""
    ids = bounded_sample(labelled.select("doc_id", "lang"), "doc_id", most).select("doc_id")
    sample = labelled.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    each = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,%d}" % LONG), F.lit(0))).alias("key"))
    counts = each.groupBy("lang", "key").agg(F.count("*").alias("n")).cache()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).toPandas().set_index("lang")["n"]
        langs = sorted(totals.index, key=lambda x: x.encode("utf-8", "surrogatepass"))
        if not langs:
            return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
        known = counts.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter("all > 1")
        known = known.orderBy(F.desc("all"), "key").limit(words).select("key", F.explode("by").alias("x")).select("key", "x.*").toPandas()
        marked = F.concat(F.lit("^"), "key", F.lit("$"))
        cut = [_grams(marked, n) for n in range(1, LONGEST + 1)]
        shown = counts.select("lang", "n", F.explode(F.concat(*cut)).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        shown = shown.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter("all > 1")
        shown = shown.orderBy(F.desc("all"), "key").limit(grams).select("key", F.explode("by").alias("x")).select("key", "x.*").toPandas()
        sums = totals.reindex(langs).to_numpy(float)
        spread = np.array([shown["n"][shown["lang"] == x].sum() for x in langs], float) / LONGEST + 1
        return Model(langs, *_logs(known, langs, sums), *_logs(shown, langs, spread))
    finally:
        counts.unpersist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for each row of docs.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out of the fit, and so are those without a language. A null
    text, or one without a letter, is `und` with score 0, and so is every text if no row can be learned from. Of
    languages that score alike the first by code point wins. Repeated rows are each predicted. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    model = train(rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), most)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for s in batches:
            for at in range(0, max(1, len(s)), 1000):
                part = s.iloc[at : at + 1000]
                if at == 0:
                    names, scores = own.predict(part)
                else:
                    more = own.predict(part)
                    names, scores = names + more[0], scores + more[1]
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.lower("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
