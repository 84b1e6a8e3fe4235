"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words counts their shared subsequences of LETTERS characters that span at most SPAN, each weighted by
DECAY to the power of its span, and is normalised to 1 for equal words; so a word with a few characters put in or
changed stays near the plain one. Labels belong to whole texts: grams that set toxic texts apart pick witness words
from them, hard and random words of clean texts stand against them, and the machines are trained on these words. Some
words are never used in clean texts, others only mark a text as toxic where they come again and again; so there are two
machines, one for a text's single worst word and one that counts marked words. A word's value is linear in its
subsequences, so the landmarks fold into one weight for each subsequence. Two logistic curves put the highest word and
the count of marked words on a scale of 0 to 1; a text's score is the higher of both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import bounded_sample, ship, written

LETTERS, SPAN, DECAY = 4, 6, 0.7
LANDMARKS = 256
#: Labelled texts that the model is fitted on, at most; taken in order of a hash of their ids.
TRAIN_DOCS = 6_000
#: Grams that tell toxic texts apart, at most.
GRAMS = 4_000
#: A gram stands out by far at this share of the highest evidence.
RELATIVE = 0.15
#: Words of clean texts that the machine is fitted on, at most.
GOOD = 6_000
CUT = 0.3
REMEMBERED = 50_000
#: Longer words are read in overlapping pieces of so many characters.
LONG = 48
_PLACES = [(0, *c) for c in combinations(range(1, SPAN), LETTERS - 1)]
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def tokens(text: str | None) -> list[str]:
    """A text's words in order, without those equal to the one before; runs of single characters also count as one word."""
    raw = text.split() if text else []
    out = [w for w, before in zip(raw, ["", *raw]) if w != before]
    if any(len(w) == 1 for w in raw):
        run: list[str] = []
        for w in (*raw, "  "):
            if len(w) == 1:
                run.append(w)
            elif run:
                if len(run) > 2:
                    out.append("".join(run))
                run = []
    return out


def forms(token: str) -> list[str]:
    """What a word may stand for: without marks at its ends, and without those inside; long ones in overlapping pieces."""
    bare = _EDGE.sub("", token)
    found = [bare] if bare.isalnum() else [bare, _INNER.sub("", bare)]
    out = []
    for w in found:
        out += [w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w), LONG // 2)]
    return [w for w in out if w]


def words(text: str | None) -> Counter:
    """How often each form of a word comes in a text."""
    out: Counter = Counter()
    for token, n in Counter(tokens(text)).items():
        for w in forms(token):
            out[w] += n
    return out


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def coded(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps (rows, codes, weight): codes of the words' subsequences and the rows of their words.

    The word's start counts as a character.
    """
    chars = np.array(["^" + w for w in batch])
    chars = chars.view(np.uint32).reshape(len(batch), -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        for places in _PLACES:
            end = chars.shape[1] - places[-1]
            if end > 0:
                codes = sum(chars[:, p : p + end] * m for p, m in zip(places, _MIX))
                codes ^= codes >> np.uint64(29)
                row, at = np.nonzero(chars[:, places[-1] :])
                yield row, codes[row, at], DECAY ** (places[-1] + 1)


def _norms(batch: list[str]) -> np.ndarray:
    """The length of a word's vector of subsequences, as if none came twice."""
    n = np.array([len(w) + 1 for w in batch])
    return np.sqrt(sum(np.maximum(n - p[-1], 0) * DECAY ** (2 * p[-1] + 2) for p in _PLACES)) + 1e-9


def grams(word: str) -> set[str]:
    w = "^" + word
    return {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}


def levels(found: Counter) -> set[tuple[str, int]]:
    """The grams of a text's words, at level 1 those that it has and at level 2 those that it has twice or more."""
    n: Counter = Counter()
    for w, c in found.items():
        for g in grams(w):
            n[g] += c
    return {(g, 1) for g in n} | {(g, 2) for g, c in n.items() if c > 1}


def features(batch: list[str], index: np.ndarray) -> np.ndarray:
    """Rows of subsequence weights of the words, for the sorted codes in index."""
    out = np.zeros((len(batch), len(index)), np.float32)
    for row, codes, weight in coded(batch):
        at = np.minimum(np.searchsorted(index, codes), len(index) - 1)
        hit = index[at] == codes
        np.add.at(out, (row[hit], at[hit]), weight)
    return out / _norms(batch)[:, None].astype(np.float32)


@dataclass
class Model:
    """Two machines over the same subsequences: column 0 of the weights is that of the worst word, column 1 that of marked words."""

    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    worst: tuple[float, float] = (4.0, 0.0)
    marked: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -9.0)

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.codes >> np.uint64(48)).astype(np.int64)] = True

    def values(self, batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), 2))
        for row, codes, weight in coded(batch):
            may = np.flatnonzero(self.seen[(codes >> np.uint64(48)).astype(np.int64)])
            row, codes = row[may], codes[may]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == codes)
            row, at = row[hit], at[hit]
            for k in (0, 1):
                out[:, k] += weight * np.bincount(row, self.weights[at, k], len(batch))
        return self.bias + out / _norms(batch)[:, None]

    def measurer(self):
        """For a batch of texts: each one's worst word, sum of marked words and number of words. Words are remembered up to a bound."""
        known: dict[str, int] = {}
        table = np.zeros((0, 2))

        def measure(texts) -> np.ndarray:
            texts = list(texts)
            return np.concatenate([np.zeros((0, 3)), *(part(texts[at : at + 1000]) for at in range(0, len(texts), 1000))])

        def part(texts: list) -> np.ndarray:
            nonlocal table
            found = [tokens(t) for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
                table = np.zeros((0, 2))
            fresh = list(dict.fromkeys(w for f in found for w in f if w not in known))
            of = sorted(((w, i) for i, t in enumerate(fresh) for w in forms(t)), key=lambda x: len(x[0]))
            new = np.full((len(fresh), 2), -9.0)
            for at in range(0, len(of), 5000):
                some = of[at : at + 5000]
                np.maximum.at(new, [i for _, i in some], self.values([w for w, _ in some]))
            known.update(zip(fresh, range(len(table), len(table) + len(fresh))))
            new[:, 1] = np.clip(4 * new[:, 1] - 1, 0, 1)
            table = np.concatenate([table, new])
            out = np.zeros((len(found), 3))
            for i, f in enumerate(found):
                own = table[np.fromiter(map(known.__getitem__, f), np.int64, len(f))]
                out[i] = (own[:, 0].max(initial=-9.0), own[:, 1].sum(), len(f))
            return out

        return measure

    def chance(self, measured: np.ndarray) -> np.ndarray:
        slope, shift = self.worst
        one = slope * (np.maximum(measured[:, 0], -2.0) - shift)
        two = _density(measured) @ np.array(self.marked)
        return 1 / (1 + np.exp(-np.clip(np.maximum(one, two), -40, 40)))


def _density(measured: np.ndarray) -> np.ndarray:
    k, n = measured[:, 1] + 0.3, measured[:, 2] + 30
    return np.c_[np.log(k / n), np.log(k), np.minimum(k, 2.3), np.ones(len(k))]


def _landmarks(names: list[str], n: int) -> list[str]:
    """Words far from one another: in turn that which the chosen ones cover least, of the first 1500."""
    names = names[:1500]
    if not names:
        return []
    x = features(names, np.unique(np.concatenate([c for _, c, _ in coded(names)] or [np.zeros(1, np.uint64)])))
    near, out = np.full(len(names), -1.0), []
    while len(out) < min(n, len(names)) and near.min() < 0.95:
        at = int(np.argmin(near))
        out.append(names[at])
        near = np.maximum(near, x @ x[at])
    return out


def fit_words(bad: dict[str, int], good: dict[str, int], landmarks: int = LANDMARKS, steps: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes, weights and bias of a squared-hinge machine on Nystroem features of weighted words. good comes in order, hardest first."""
    names = [*bad, *good]
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    c = np.array([*bad.values(), *good.values()], float)
    c = np.where(y > 0, c / c[y > 0].sum(), c / c[y < 0].sum()) / 2
    marks = _landmarks(sorted(bad, key=lambda w: (-bad[w], w)), landmarks // 2)
    marks += list(good)[: landmarks - len(marks)]
    index = np.unique(np.concatenate([x for _, x, _ in coded(marks)] or [np.zeros(1, np.uint64)]))
    known = features(marks, index)
    values, vectors = np.linalg.eigh((known @ known.T).astype(float))
    keep = values > 1e-4 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.concatenate([features(names[i : i + 2000], index) @ known.T for i in range(0, len(names), 2000)]) @ root
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(len(w))
    penal[-1, -1] = 1e-9
    for _ in range(steps):  # Newton steps on the words inside the margin
        inside = y * (x @ w) < 1
        a = x[inside] * c[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + penal, a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return index, (known.T @ (root @ w[:-1])).astype(float), float(w[-1])


def joined(first: tuple, second: tuple) -> Model:
    codes = np.union1d(first[0], second[0])
    weights = np.zeros((len(codes), 2))
    for k, one in enumerate((first, second)):
        weights[np.searchsorted(codes, one[0]), k] = one[1]
    return Model(codes, weights, np.array([first[2], second[2]]))


def _curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A logistic curve through columns of values, drawn in so that it stays finite if the labels part fully. The last column is 1."""
    y = np.where(toxic == 1, 0.99, 0.01)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 2e-3)
    ridge[-1] = 1e-5
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge), x.T @ (p - y) / len(y) + ridge * w)
        w = w - np.clip(step, -1, 1)
    return w


def _calibrate(model: Model, measured: np.ndarray, toxic: np.ndarray) -> None:
    slope, at = _curve(np.c_[np.maximum(measured[:, 0], -2.0), np.ones(len(toxic))], toxic)
    slope = max(float(slope), 0.1)
    model.worst, model.marked = (slope, -float(at) / slope), tuple(map(float, _curve(_density(measured), toxic)))


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            found = levels(words(text))
            yield pd.DataFrame({"gram": [g for g, _ in found], "level": [n for _, n in found], "toxic": toxic})


def _present(evidence: dict[tuple[str, int], float]):
    """The grams of interest of each toxic text, as one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"found": [[f"{n}{g}" for g, n in sorted(levels(words(t)) & evidence.keys())] for t in pdf["text"]]})

    return run


def choose(evidence: dict[tuple[str, int], float], texts: list[set[tuple[str, int]]]) -> set[tuple[str, int]]:
    """Grams that stand out by far, and those that best cover the texts without one, each at least two."""
    far = RELATIVE * max(evidence.values(), default=0.0)
    out = {g for g, v in evidence.items() if v >= far}
    left = [t for t in texts if not t & out]
    while left:
        counts = Counter(g for t in left for g in t)
        best = max(counts, key=lambda g: (counts[g] * evidence[g], g), default=None)
        if best is None or counts[best] < 2:
            break
        out.add(best)
        left = [t for t in left if best not in t]
    return out


def _witnesses(chosen: set[tuple[str, int]], evidence: dict[tuple[str, int], float]):
    """Of toxic texts the words with a chosen gram, by its level; of clean ones the two with most evidence, and four by hash."""
    most: dict[str, float] = {}
    for (g, _), v in evidence.items():
        most[g] = max(v, most.get(g, 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                count = words(text)
                found = sorted(count)
                if toxic:
                    own = levels(count) & chosen
                    for w in found:
                        at = [n for n in (1, 2) if any((g, n) in own for g in grams(w))]
                        rows += [(w, at[0])] if at else []
                else:
                    value = {w: max((most.get(g, 0.0) for g in grams(w)), default=0.0) for w in found}
                    rows += [(w, 0) for w in sorted(found, key=lambda w: -value[w])[:2]]
                    rows += [(w, 0) for w in sorted(found, key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))[:4]]
            yield pd.DataFrame(rows, columns=["word", "level"])

    return run


def _hardest(model: Model, marks: set[str]):
    """Of clean texts the words that either machine rates highest; a word with a mark may come there, if not often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = sorted(words(text))
                value = model.values(found) if found else np.zeros((0, 2))
                value[[bool(grams(w) & marks) for w in found], 1] = -9.0
                rows += [(float(value[at, k]), found[at], k) for k in (0, 1) if found for at in [int(np.argmax(value[:, k]))]]
            yield pd.DataFrame(rows, columns=["value", "word", "machine"])

    return run


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = model.measurer()
        for pdf in batches:
            yield pd.DataFrame(measure(pdf["text"]), columns=["worst", "marked", "n"]).assign(toxic=pdf["toxic"].to_numpy())

    return run


def labels_to_learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(doc_id, toxic) that a model may learn from: the document is there, crc32(doc_id as text) mod 4 isn't 2, the label is known."""
    known = labels.filter(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", most: int = TRAIN_DOCS, landmarks: int = LANDMARKS) -> Model | None:
    """A model from at most so many labelled documents; None if one of the labels is missing.

    Ids are sampled before texts are read, so no text is shuffled but those of the sample. Of rows that share an id one
    is learned from. Only counts of the sample's grams and a few words of each of its texts come to the driver. The machines are fitted
    twice: the second time also against the words that the first ones rate highest in clean texts.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = written(bounded_sample(labels_to_learn(docs, labels, doc_id, toxic), "doc_id", most), "sample")
    totals = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return None
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text")).join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    sample = written(sample.repartition(4 * spark.sparkContext.defaultParallelism), "sample-texts")
    counts = sample.mapInPandas(_gram_rows, "gram string, level int, toxic int").groupBy("gram", "level").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    counts = written(counts.filter(F.col("t") >= min(3, bad)), "grams")
    least = float(np.log(max(1, counts.count())) + 1)  # what the best of so many grams may reach by chance
    base, rate = bad / (bad + good), F.col("t") / F.col("n")
    bits = rate * F.log(rate / base) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    top = counts.filter(rate >= 0.8).withColumn("evidence", F.col("n") * bits).filter(F.col("evidence") >= min(least, bad * float(-np.log(base)) / 2))
    evidence = {(r["gram"], r["level"]): r["evidence"] for r in top.orderBy(F.desc("evidence"), "gram", "level").limit(GRAMS).collect()}
    texts = [{(x[1:], int(x[0])) for x in r["found"]} for r in sample.filter("toxic = 1").mapInPandas(_present(evidence), "found array<string>").collect()]
    chosen = choose(evidence, texts)
    found = sample.mapInPandas(_witnesses(chosen, evidence), "word string, level int").groupBy("word", "level").count().toPandas()
    by = {n: Counter(dict(zip(found["word"][found["level"] == n], found["count"][found["level"] == n]))) for n in (0, 1, 2)}
    clean = by[0]
    toxic = [{w: n for w, n in x.items() if n > 3 * clean[w]} for x in (by[1], by[1] + by[2])]
    unsure = {g for g, n in chosen if n == 2 and (g, 1) not in evidence}  # once is no sign, again and again is
    toxic[0] = {w: n for w, n in toxic[0].items() if not grams(w) & unsure} or toxic[1]
    if not toxic[1]:
        return None
    marks, hard = {g for g, _ in chosen}, [Counter(), Counter()]
    for _ in range(2):
        fits = []
        for k in (0, 1):
            order = sorted(clean | hard[k], key=lambda w: (-hard[k][w], -clean[w], w))
            rest = {w: clean[w] + 5 * hard[k][w] for w in order if w not in toxic[k] and not (k and grams(w) & marks)}
            fits.append(fit_words(toxic[k], dict(list(rest.items())[:GOOD]) or {" ": 1}, landmarks))
        model = joined(*fits)
        seen = sample.filter("toxic = 0").mapInPandas(_hardest(model, marks), "value double, word string, machine int").filter("value > -0.7").groupBy("word", "machine").count().toPandas()
        for k in (0, 1):
            hard[k].update(dict(zip(seen["word"][seen["machine"] == k], seen["count"][seen["machine"] == k].map(int))))
    seen = sample.mapInPandas(_measured(model), "worst double, marked double, n double, toxic int").toPandas()
    _calibrate(model, seen[["worst", "marked", "n"]].to_numpy(float), seen["toxic"].to_numpy())
    return model


def chance(model: Model | None):
    """A function that makes a column of scores from a text column; without a model every score is 0."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = model.measurer() if model else None
        for s in batches:
            yield pd.Series(model.chance(measure(s)) if model else np.zeros(len(s)))

    return lambda text: run(F.lower(text))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", cut: float = CUT, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= cut) for each row of docs.

    Null and empty texts get the score of a text without words. Of repeated label rows the highest counts; repeated
    documents are scored each for itself. Without both labels every score is 0. An empty table gives an empty result.
    """
    model = train(docs, labels, text, doc_id, toxic, most)
    out = docs.select(F.col(doc_id).alias("doc_id"), chance(model)(F.col(text)).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
