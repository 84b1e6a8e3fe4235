"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source a minimum-covariance-determinant
estimate of location and scatter is made the way it is for large groups: the rows are dealt into parts of bounded size,
each part searches for its half of least determinant, and the best candidates are concentrated further over all rows of
the group by sums that Spark makes. Texts whose Mahalanobis distance to their group's estimate is too large go.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import WORD, join_groups, null_safe, ship, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: The vector: mean word length, shares of symbols, upper case, digits and other marks, distinct words, repeated words, words equal to the one before.
NAMES = ("v_length", "v_symbols", "v_upper", "v_marks", "v_distinct", "v_repeats", "v_runs")
#: Words of a typical text that a short one is drawn towards, so its statistics scatter no more than those of a long one.
DRAWN = 60
#: Rows in a part at most, on average.
PART = 2_000
#: Share of rows that the estimate rests on, and groups under so many rows take the estimate of their language or of all.
HALF, SMALL = 0.75, 200
#: Concentration steps over all rows of a group.
STEPS = 3
#: No statistic scatters less than this, whatever the group; without it a statistic that is 0 in most texts would decide.
FLOOR = np.array([0.04, 0.05, 0.05, 0.05, 0.06, 0.08, 0.06])
#: Squared distance at which a text is rejected, beyond what the chi-square distribution of the statistics makes of chance.
CUT = 80.0


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that come twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        for i in range(window):
            code = code * np.uint64(0x94D049BB133111EB) + x[i : n + i]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c"))
    return sum(lines.values()) - len(lines)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word, symbols = re.compile(WORD), set(SYMBOLS)
    for pdf in batches:
        rows = []
        for key, group, lang, doc, text in zip(pdf["row"], pdf["group"], pdf["lang"], pdf["doc_id"], pdf["text"]):
            text = text or ""
            found = word.findall(text)
            n, chars = len(found), sum(map(len, found))
            sym = sum(map(text.count, symbols))
            rep = repeated_words(found)
            upper = sum(map(str.isupper, found)) if not text.islower() else 0
            marks = len(re.findall(r"[^\w\s]|\d", text))
            weight = n + DRAWN
            distinct = len(set(found))
            vector = (
                math.log((chars + 5.0 * DRAWN) / weight),
                math.sqrt(sym / weight),
                math.sqrt(upper / weight) if upper > 2 else 0.0,
                math.sqrt((marks + 0.2 * DRAWN) / weight),
                math.log((distinct + DRAWN) / weight) / math.log(2 + weight / DRAWN),
                math.sqrt(rep / weight),
                math.sqrt(sum(map(str.__eq__, found, found[1:])) / weight),
            )
            rows.append((key, group, lang, doc, n, chars, sym, repeated_lines(text), rep, *vector))
        yield pd.DataFrame(rows, columns=["row", "group", "lang", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *NAMES]).astype({"doc_id": "Int64"})


def _scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    d = x - mean
    return mean, d.T @ d / len(x) + np.diag(FLOOR**2)


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, share: float = HALF, steps: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """From a start to the half of the rows whose determinant shrinks no more: mean, scatter, log determinant."""
    h, last = max(1, int(share * len(x))), math.inf
    for _ in range(steps):
        d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
        mean, cov = _scatter(x[np.argpartition(d, h - 1)[:h]])
        now = np.linalg.slogdet(cov)[1]
        if now >= last - 1e-9:
            break
        last = now
    return mean, cov, float(np.linalg.slogdet(cov)[1])


def search(x: np.ndarray, starts: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """The best of several starts: medians, and small subsets that a fixed seed picks."""
    rng, p = np.random.default_rng(11), x.shape[1]
    mid = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - mid), axis=0)
    found = [concentrate(x, mid, np.diag(spread**2 + FLOOR**2), steps=2)]
    found += [concentrate(x, *_scatter(x[rng.choice(len(x), min(len(x), 2 * p), replace=False)]), steps=2) for _ in range(starts)]
    return min((concentrate(x, m, c) for m, c, _ in sorted(found, key=lambda f: f[2])[:3]), key=lambda f: f[2])


def _part(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf.sort_values("row")[list(NAMES)].to_numpy(float)
    mean, cov, det = search(x)
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "det": [det], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()]})


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """The squared Mahalanobis distance of a row's vector, as a sum of products."""
    d = [F.col(n) - F.element_at(mean, i + 1) for i, n in enumerate(NAMES)]
    p = len(NAMES)
    return sum(d[i] * d[j] * F.element_at(inverse, i * p + j + 1) for i in range(p) for j in range(p))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Estimates from sums over the rows that stayed; one row for each group comes in."""
    p, rows = len(NAMES), []
    for r in pdf.itertuples():
        mean = np.array(r.sums) / r.h
        cov = np.array(r.products).reshape(p, p) / r.h - np.outer(mean, mean) + np.diag(FLOOR**2)
        rows.append((r.group, mean.tolist(), np.linalg.inv(cov).ravel().tolist()))
    return pd.DataFrame(rows, columns=["group", "mean", "inverse"])


def dealt(rows: DataFrame, part: int = PART) -> DataFrame:
    """rows (row, group, size) with part, so that about part rows of a group share one.

    Rows go by their hash, whatever the layout of files. More than part equal ones, of which there are few kinds, would
    all meet in one part, so they go by where they lie; as they are equal, it doesn't matter which goes where.
    """
    hot = written(rows.groupBy("group", "row").agg(F.count("*").alias("equal")).filter(F.col("equal") > part), "hot")
    few = hot.limit(1_000_001).count() <= 1_000_000
    marked = rows.join(F.broadcast(hot) if few else hot, ["group", "row"], "left")
    key = F.when(F.col("equal").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("row", F.monotonically_increasing_id()))
    return marked.withColumn("part", F.pmod(key, F.ceil(F.col("size") / part))).drop("equal")


def estimates(rows: DataFrame, part: int = PART, steps: int = STEPS) -> DataFrame:
    """One row for each value of group: group, size, mean, inverse. rows: row, group and the vector."""
    sizes = written(rows.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    total = rows.count()
    rows = written(join_groups(rows, sizes, ["group"], "size", total), "sized")
    parts = dealt(rows, part).groupBy("group", "part").applyInPandas(_part, "group string, det double, mean array<double>, inverse array<double>")
    best = written(parts.groupBy("group").agg(F.min_by(F.struct("mean", "inverse"), "det").alias("best")).select("group", "best.*").join(sizes, "group"), "estimates")
    values = [F.col(n) for n in NAMES]
    for _ in range(steps):  # concentration over all rows of the group
        near = join_groups(rows.drop("size"), best, ["group"], "size", total).withColumn("d", distance()).drop("mean", "inverse")
        near = written(near.drop("size"), "distances")
        cut = near.groupBy("group").agg(F.percentile_approx("d", HALF, 10_000).alias("cut"), F.count("*").alias("size"))
        held = join_groups(near, written(cut, "cuts"), ["group"], "size", total).filter(F.col("d") <= F.col("cut"))
        sums = held.groupBy("group").agg(F.count("*").alias("h"), F.array(*[F.sum(v) for v in values]).alias("sums"), F.array(*[F.sum(a * b) for a in values for b in values]).alias("products"))
        settled = sums.mapInPandas(lambda it: map(_settle, it), "group string, mean array<double>, inverse array<double>")
        best = written(settled.join(sizes, "group"), "estimates")
    return best


def rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", part: int = PART, cut: float = CUT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance for each row.

    base_failed: under 20 words, or over 30 % of the words repeated. Others are kept unless they lie far from their
    group's estimate. Only texts that pass the base are estimated from. A null language or source is one of its own.
    Groups under SMALL rows use their language's estimate, languages under SMALL rows that of all texts. Repeated rows
    count each for itself. Rows are dealt out by a hash of doc_id and text, so another layout of files gives the same
    estimates, up to the deal of thousands of equal rows. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    of_lang, of_source = null_safe(F.col(lang), F.col(source))
    base = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.concat_ws("\x1f", of_lang, of_source).alias("group"), of_lang.alias("lang"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = base.mapInPandas(_measure, "row long, group string, lang string, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{n} double" for n in NAMES))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(measured.withColumn("base_failed", failed), "measured")
    good = rows.filter("not base_failed")
    total = good.count()
    counts = written(good.groupBy("lang", "group").agg(F.count("*").alias("size")), "groups")
    by_lang = counts.groupBy("lang").agg(F.sum("size").alias("all"))
    # Each group is estimated once, from its own rows or from those of the language, or of all texts.
    choice = F.when(F.col("size") >= SMALL, F.concat(F.lit("g"), "group")).when(F.col("all") >= SMALL, F.concat(F.lit("l"), "lang")).otherwise("a")
    use = written(counts.join(by_lang, "lang").select("group", "size", choice.alias("use")), "use")
    keyed = written(join_groups(good, use, ["group"], "size", total), "keyed")
    wide = use.select("use").distinct()
    sample = keyed.select("row", F.concat(F.lit("g"), "group").alias("group"), *NAMES).unionByName(keyed.select("row", F.concat(F.lit("l"), "lang").alias("group"), *NAMES)).unionByName(keyed.select("row", F.lit("a").alias("group"), *NAMES))
    few = F.broadcast(wide) if wide.limit(1_000_001).count() <= 1_000_000 else wide
    wanted = written(sample.join(few, F.col("group") == F.col("use"), "left_semi"), "wanted")
    models = estimates(wanted, part).drop("size")
    sizes = keyed.groupBy("use").agg(F.count("*").alias("rows"))
    models = written(models.join(sizes, models["group"] == sizes["use"]).select("use", "rows", "mean", "inverse"), "models")
    judged = join_groups(keyed.drop("size"), models, ["use"], "rows", total).withColumn("distance", distance())
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    done = judged.select(*out, (F.col("distance") <= cut).alias("kept"), "distance")
    return done.unionByName(rows.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))
