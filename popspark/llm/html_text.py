"""Main text of web pages by structure and by the runs that a host repeats.

A page becomes blocks of text, without what its structure marks as menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles. Runs of RUN tokens or more that recur on PAGES distinct pages of a host are
boilerplate, whatever the host's size: the token streams of a host's pages are concatenated into a suffix array, whose
common prefixes give the long substrings of several pages. A host that is too large for one task has its suffixes dealt
out by hashes of their first RUN tokens, and the pages of each counted. Such runs are removed and unique ones kept.
Inside an explicit article they go as whole blocks at its edges, unless they are most of it: then the article is a copy.
What is outside an article is left out only where the article is the larger part of the page's unique text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import BROADCAST_ROWS, join_groups, partitions, ship, written
from popspark.llm.near_dedup import Shingles
from popspark.llm.url_filter import address

#: Tokens of a run that counts as long.
RUN = 8
#: A run is boilerplate on so many distinct pages of a host.
PAGES = 3
#: Tokens of the short runs by which long ones are first sought on large hosts.
SHORT = 4
#: Hosts up to so many characters of html are compared in one task, by their suffix array.
PART = 8_000_000
#: Characters of html for each partition of hosts.
DEALT = 16_000_000
#: A page that would lose this share of all blocks is a copy, not boilerplate.
COPY = 0.9
#: Repeated blocks at an article's edges go below this share of it, and outside text counts if the article is below this share of both.
MINOR = 0.5
#: A block outside an article goes if this share of it is links.
LINKS = 0.5

RAW = "script style noscript template svg iframe object canvas textarea select title".split()
#: Of these, those that are over at once if their tag ends in a slash.
CLOSED = "svg math iframe object canvas select template noscript".split()
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option button".split())
DROP = set("nav aside footer form menu dialog button head".split())
MAIN = {"article", "main"}
#: Names of a class or id that mark what isn't the article: whole ones, or as the last part of a name.
MARKS = set("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination popup promo promos promoted related respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Whole names that mark containers inside an article; all else there is judged by what the host repeats.
INNER = set("ad ads advert adverts advertisement ad-slot ad-unit ad-container ad-wrapper breadcrumb breadcrumbs comment comments comment-list comments-section comment-section reader-comments user-comments menu nav navbar newsletter newsletter-signup sidebar".split())
#: A name that begins so and ends so is the article's own heading.
OWN, HEADING = set("article content entry main post story".split()), {"header", "masthead", "banner"}
#: Elements that hold text of their own, which no name inside an article marks.
TEXT = set("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption span b i em strong a".split())
#: Roles that do.
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

# What a tag's text takes in is never given back, and an open quote is read as text, so each pattern ends in linear time.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:" + "|".join(CLOSED) + r")(?=[\s/>])[^>]*+(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_SPLIT = re.compile(r"[-_]+")
_INLINE_CLOSE = {"p"}


def _named(tag: str, value: str, inside: bool) -> bool:
    names = value.split()
    if inside:
        return tag not in TEXT and not INNER.isdisjoint(names)
    parts = [_SPLIT.split(n) for n in names]
    return any(n in MARKS or p[-1] in MARKS and not (p[0] in OWN and p[-1] in HEADING) for n, p in zip(names, parts))


def _unwanted(tag: str, rest: str, inside: bool) -> bool:
    if tag in DROP or tag == "header" and not inside:
        return True
    if tag in MAIN or tag in ("body", "html") or "=" not in rest and "hidden" not in rest:
        return False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and _named(tag, value, inside):
            return True
    return False


_NOSCRIPT = re.compile(r"</?noscript(?=[\s/>])[^>]*+>", re.I)


def blocks(page: str) -> list[tuple[str, bool, float]]:
    """The page's blocks of text that structure doesn't rule out: (text, in an article, share of links).

    What stands in noscript counts only if there is more of it than of all else, as on pages that scripts fill.
    """
    out = _blocks(page)
    opened = _NOSCRIPT.sub("", page)
    if len(opened) < len(page):
        size = lambda x: sum(len(b[0]) for b in x)
        whole = _blocks(opened)
        out = whole if size(whole) > 2 * size(out) else out
    return out


def _blocks(page: str) -> list[tuple[str, bool, float]]:
    out: list[tuple[str, bool, float]] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, unwanted, article
    opened: Counter = Counter()  # how many of each tag are open
    text: list[str] = []
    dropped = inside = links = linked = 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((whole, inside > 0, linked / len(whole)))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, inside
        tag, bad, main = stack.pop()
        opened[tag] -= 1
        dropped -= bad
        inside -= main

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) * (links > 0)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, rest = tag.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                if not dropped:
                    close()
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK:
            if not dropped:
                close()
            links = 0
            while stack and stack[-1][0] in _INLINE_CLOSE:  # a new block ends a paragraph
                pop()
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in MAIN and dropped and not inside:  # an article ends what was left open before it
            while stack and dropped:
                pop()
        if tag == "body":
            while stack and dropped:
                pop()
        bad = _unwanted(tag, rest, inside > 0)
        if bad and not dropped:
            close()
        if bad or tag in BLOCK:
            main = tag in MAIN and not dropped
            stack.append((tag, bad, main))
            opened[tag] += 1
            dropped += bad
            inside += main
    if at < len(page) and not dropped:
        text.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    close()
    return out


def suffix_array(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of an array of numbers in order, and the length of the prefix that each shares with the one before it.

    Suffixes are ordered by their first 1, 2, 4, ... numbers; only those that still tie are ordered again. The ranks of
    each step tell afterwards how far two suffixes agree.
    """
    n = len(whole)
    names, rank = np.unique(whole, return_inverse=True)
    rank = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(names)))])[:-1][rank].astype(np.int64)  # places of the first of each group
    order, step, ranks = np.argsort(rank, kind="stable"), 1, [rank]
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_) and step < n:
        ahead = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + ahead
        sort = np.argsort(key, kind="stable")
        key, at, old = key[sort], open_[sort], rank[open_[sort]]
        idx = np.arange(len(at))
        starts = lambda x: np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], idx, 0))
        place = idx - starts(old) + old
        order[place] = at
        rank = rank.copy()
        rank[at] = place[starts(key)]
        ranks.append(rank)
        open_ = np.sort(at[np.bincount(rank[at], minlength=n)[rank[at]] > 1])
        step *= 2
    shared = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = (np.maximum(i, j) < n) & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        same &= np.maximum(i, j) + (1 << k) <= n
        shared[1:] += same * (1 << k)
        i, j = i + same * (1 << k), j + same * (1 << k)
    return order, shared


def repeated(streams: list[list[int]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream which tokens lie in a substring of run tokens or more that so many distinct streams hold.

    The streams are concatenated with a different separator each. In the suffix array's order suffixes that share run
    tokens or more adjoin, and the distinct streams of each such stretch are counted.
    """
    lengths = np.array([len(s) for s in streams], np.int64)
    if not lengths.sum():
        return [np.zeros(n, bool) for n in lengths]
    top = max((max(s) for s in streams if s), default=0) + 1
    whole = np.concatenate([np.array([*s, top + i], np.int64) for i, s in enumerate(streams)])
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    order, shared = suffix_array(whole)
    stretch = np.cumsum(shared < run) - 1
    seen = np.unique(stretch * len(streams) + page[order]) // len(streams)
    start = order[np.bincount(seen, minlength=int(stretch[-1]) + 1)[stretch] >= pages]
    ends = np.cumsum(lengths + 1)
    start = start[start + run < ends[page[start]]]
    edge = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + run, -1)
    covered = np.cumsum(edge)[: len(whole)] > 0
    return [covered[e - n - 1 : e - 1] for e, n in zip(ends, lengths)]


def _kept(page: list[tuple[str, bool, float]], tokens: list[list[str]], covered: np.ndarray) -> str:
    """The main text of a page, given which of its tokens lie in a run that its host repeats."""
    at, spans = 0, []
    for t in tokens:
        spans.append(covered[at : at + len(t)])
        at += len(t)
    inner = [i for i, b in enumerate(page) if b[1]]
    size = sum(len(tokens[i]) for i in inner)
    edges: set[int] = set()
    for order in (inner, inner[::-1]):
        for i in order:
            if not spans[i].all():
                break
            edges.add(i)
    if sum(len(tokens[i]) for i in edges) >= MINOR * size:
        edges = set()
    outer = [i for i, b in enumerate(page) if not b[1]]
    unique = sum(int((~spans[i]).sum()) for i in outer if page[i][2] <= LINKS)
    main = bool(inner) and size >= MINOR * (size + unique)
    open_tokens = np.concatenate([spans[i] for i in outer]) if outer else np.zeros(0, bool)
    copy = not inner and open_tokens.any() and open_tokens.mean() >= COPY
    kept = []
    for i, ((text, inside, links), t, c) in enumerate(zip(page, tokens, spans)):
        if inside:
            if i not in edges:
                kept.append(text)
        elif main or links > LINKS or not copy and c.all():
            continue
        elif copy or not c.any():
            kept.append(text)
        else:
            kept.append(" ".join(w for w, x in zip(t, c) if not x))
    return "\n".join(kept)


def prune(pages: list[list[tuple[str, bool, float]]], run: int = RUN, least: int = PAGES) -> list[str]:
    """The main text of each page of a host."""
    known: dict[str, int] = {}
    words = [[b[0].split(" ") for b in page] for page in pages]
    streams = [[known.setdefault(w, len(known)) for b in page for w in b] for page in words]
    distinct = {tuple(s): i for i, s in enumerate(streams)}  # copies of a page count once
    cover = dict(zip(distinct, repeated([streams[i] for i in distinct.values()], run, least)))
    return [_kept(page, tokens, cover[tuple(stream)]) for page, tokens, stream in zip(pages, words, streams)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page in pdf["html"]:
            found = blocks(page) if page else []
            rows.append(([b[0] for b in found], [b[1] for b in found], [b[2] for b in found]))
        yield pdf.drop(columns="html").assign(texts=[r[0] for r in rows], inside=[r[1] for r in rows], links=[r[2] for r in rows])


def _main(pdf: pd.DataFrame) -> pd.DataFrame:
    pages = [list(zip(t, i, x)) for t, i, x in zip(pdf["texts"], pdf["inside"], pdf["links"])]
    return pdf[["page_id", "url"]].assign(text=prune(pages))


class Runs:
    """The hashes of a page's runs of RUN tokens, different on each host, and for each run the least hash of its short runs.

    Equal runs have equal least hashes, so a run is on no more pages than its least hash; there are about a third as many.
    """

    def __init__(self) -> None:
        self.all, self.few = Shingles(RUN), Shingles(SHORT)

    def _of(self, shingles: Shingles, host: str, tokens: list[str]) -> np.ndarray:
        import xxhash

        return shingles.runs(tokens) ^ np.uint64(xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")))

    def long(self, host: str, tokens: list[str]) -> np.ndarray:
        return self._of(self.all, host, tokens).view(np.int64) if len(tokens) >= RUN else np.zeros(0, np.int64)

    def least(self, host: str, tokens: list[str]) -> np.ndarray:
        if len(tokens) < RUN:
            return np.zeros(0, np.int64)
        short = self._of(self.few, host, tokens)
        n, low = len(tokens) - RUN + 1, short
        for i in range(1, RUN - SHORT + 1):
            low = np.minimum(low[: len(low)], np.append(short[i:], np.full(i, np.uint64(2**64 - 1))))
        return low[:n].view(np.int64)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _hashes(least: bool, known):
    """What each distinct page holds of least hashes, or of runs (those of the least hashes in known, if given), dealt into buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs()
        for pdf in batches:
            found = [np.zeros(0, np.int64)]
            for host, texts in zip(pdf["host"], pdf["texts"]):
                tokens = " ".join(texts).split(" ")
                if least:
                    found.append(np.unique(runs.least(host, tokens)))
                else:
                    at = None if known is None else _among(runs.least(host, tokens), known.value)
                    found.append(np.unique(runs.long(host, tokens)[at] if at is not None else runs.long(host, tokens)) if at is None or at.any() else found[0])
            whole = np.concatenate(found)
            bucket = (whole.view(np.uint64) >> np.uint64(54)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            whole, names, at = whole[order], *np.unique(bucket[order], return_index=True)
            yield pd.DataFrame({"bucket": names, "hashes": [x.tobytes() for x in np.split(whole, at[1:])] if len(names) else []})

    return run


def _often(pdf: pd.DataFrame) -> pd.DataFrame:
    runs, pages = np.unique(np.frombuffer(b"".join(pdf["hashes"]), np.int64), return_counts=True)
    return pd.DataFrame({"run": runs[pages >= PAGES], "pages": pages[pages >= PAGES]})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = Runs()
    for pdf in batches:
        found = [runs.long(host, " ".join(texts).split(" ")) for host, texts in zip(pdf["host"], pdf["texts"])]
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in found]]).astype(np.int32)
        yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), list(map(len, found))), "at": at, "run": np.concatenate([np.zeros(0, np.int64), *found])})


def _main_of_large(known):
    """The text of each page, whose repeated runs begin at the tokens in the column at or are those in known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs()
        for pdf in batches:
            out = []
            for host, texts, inside, links, at in zip(pdf["host"], pdf["texts"], pdf["inside"], pdf["links"], pdf["at"]):
                tokens = [t.split(" ") for t in texts]
                if known is not None:
                    at = np.flatnonzero(_among(runs.long(host, [w for t in tokens for w in t]), known.value))
                edge = np.zeros(sum(map(len, tokens)) + 1, np.int64)
                if at is not None:
                    np.add.at(edge, np.asarray(at, np.int64), 1)
                    np.add.at(edge, np.asarray(at, np.int64) + RUN, -1)
                out.append(_kept(list(zip(texts, inside, links)), tokens, np.cumsum(edge)[:-1] > 0))
            yield pdf[["page_id", "url"]].assign(text=out)

    return run


def _large_hosts(parsed: DataFrame, kind: str, limit: int) -> DataFrame:
    """The text of pages of hosts that are too large for one task: their runs are hashed and distinct pages counted."""
    spark = parsed.sparkSession
    stream = F.unhex(F.md5(F.concat_ws("\n", "host", F.array_join("texts", " "))))
    rows = written(parsed.withColumns({"id": F.monotonically_increasing_id(), "stream": stream}), "parsed")
    # Copies of a page count once.
    copied = written(rows.groupBy("stream").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1").select("stream", "first"), "copied")
    few = copied.limit(limit + 1).count() <= limit
    single = rows.join(F.broadcast(copied) if few else copied, "stream", "left").filter("first is null or first = id").select("host", "texts")

    def often(least: bool, known) -> DataFrame:
        dealt = single.mapInPandas(_hashes(least, known), "bucket int, hashes binary")
        return written(dealt.groupBy("bucket").applyInPandas(_often, "run long, pages long"), "runs")

    def held(found: DataFrame):
        """The hashes, sorted, for all tasks, if there are few."""
        if found.limit(limit + 1).count() > limit:
            return None
        return spark.sparkContext.broadcast(np.sort(found.select("run").toPandas()["run"].to_numpy(np.int64)))

    hits = often(False, held(often(True, None)))
    known, text = held(hits), f"page_id {kind}, url string, text string"
    if known is not None:
        return rows.withColumn("at", F.lit(None).cast("array<int>")).mapInPandas(_main_of_large(known), text)
    places = rows.select("id", "host", "texts").mapInPandas(_places, "id long, at int, run long")
    places = join_groups(places, hits, ["run"], "pages", hits.agg(F.sum("pages")).first()[0])
    return rows.join(places.groupBy("id").agg(F.collect_list("at").alias("at")), "id", "left").mapInPandas(_main_of_large(None), text)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", part: int = PART, limit: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages.

    Blocks come in page order, joined by a line end. A null or empty html, or one without an article or other text,
    gives an empty text. Pages with a null url form a host of their own. Repeated rows each give their text; copies of
    a page count as one page where repeats are sought. An empty table gives an empty result. A page of any length is
    read in time that grows with its length; hosts of over part characters are compared by hashes of their suffixes.
    Whatever else pages holds is left alone, and its names don't matter.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(address(F.coalesce(F.col(url), F.lit("")))["host"], F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    sizes = written(rows.groupBy("host").agg(F.count("*").alias("size"), F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("chars")), "hosts")
    large = sizes.filter(F.col("chars") > part).select("host", "size", F.lit(True).alias("large"))
    if large.limit(limit + 1).count() <= limit:
        dealt = rows.join(F.broadcast(large), "host", "left")
    else:
        dealt = join_groups(rows, sizes.select("host", "size", (F.col("chars") > part).alias("large")), ["host"], "size", rows.count())
    is_large, kind = F.coalesce("large", F.lit(False)), rows.schema["page_id"].dataType.simpleString()
    parse = lambda some: some.select("page_id", "url", "html", "host").mapInPandas(_parse, f"page_id {kind}, url string, host string, texts array<string>, inside array<boolean>, links array<double>")
    chars = sizes.filter(F.col("chars") <= part).agg(F.sum("chars")).first()[0] or 0
    small = parse(dealt.filter(~is_large)).repartition(max(partitions(spark), chars // DEALT), "host")
    out = small.groupBy("host").applyInPandas(_main, f"page_id {kind}, url string, text string")
    if not large.isEmpty():
        out = out.unionByName(_large_hosts(parse(dealt.filter(is_large)), kind, limit))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
