"""The operators against plain versions on small tables with nulls, repeated rows, ties, long texts and other columns."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from popspark.llm import exact_dedup, html_text, language, mixing, near_dedup, packing, quality, queries, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, size string, kept string"
ODD = [(1, None, None, None, "x", "y"), (2, "", "en", "a", None, None), (3, " \n ", "en", "a", None, None), (4, "one two", "en", "a", None, None), (4, "one two", "en", "a", None, None), (None, "one  two", "de", None, None, None), (5, "word " * 30_000, "en", "b", None, None), (6, "x" * 100_000, None, "b", None, None), (7, "12 34 !!", "de", "c", None, None)]
RUNS = {
    "exact": exact_dedup.exact_dedup, "near": near_dedup.near_dedup, "mix": mixing.mix, "pack": packing.pack, "language": language.identify, "quality": quality.rules,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(odd, name):
    rows = RUNS[name](odd).collect()
    assert len({r["doc_id"] for r in rows}) == 8 and (name == "pack" or len(rows) == len(ODD))
    assert RUNS[name](odd.filter("false")).collect() == []


def test_toxicity_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(odd, none).collect()] == [0.0] * len(ODD)
    assert toxicity.score(odd.filter("false"), none).collect() == []


def test_exact_copies_with_colliding_fingerprints(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "ab", "c", "d", "a  b", "d", "ef" * 9])], "doc_id long, text string")
    want = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert want == {(0, 4, 3, False), (1, 4, 3, False), (4, 4, 3, True), (2, 2, 1, True), (3, 3, 2, True), (5, 3, 2, False), (6, 6, 1, True)}
    for primes, chunk in (((3, 5), 2), ((2, 2), 1)):  # nearly all fingerprints clash
        got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, primes=primes, chunk=chunk).collect()}
        assert got == want


def test_fingerprints_combine():
    data, f = bytes(range(256)) * 50, exact_dedup.Fingerprint(chunk=100)
    assert exact_dedup.combine(f.of(data[:777]), f.of(data[777:])) == f.of(data)


def _components(docs: dict[int, str | None], k: int = 4) -> dict[int, int]:
    sets, root = {}, {d: d for d in docs}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_near_copies_equal_brute_force(spark):
    rng, docs = random.Random(3), {}
    base = [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(120)]
    for i in range(150):  # a group around the threshold, and other texts
        words = list(base) if i < 110 else [str(rng.randrange(10_000)) for _ in range(60)]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"new{i}"
        docs[i] = " ".join(words)
    docs |= {150: None, 151: "", 152: "a b", 153: "A  B", 154: "b a"}
    table, want = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), _components(docs)
    for region, limit in ((64, 100_000), (4, 0)):  # with and without wide runs, by broadcast and by shuffle
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(table, region=region, limit=limit).collect()}
        assert got == want


def test_packing_is_gapless_and_tight(spark):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 2048) + 1


def test_word_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, ids = Tokenizer.from_file(path), packing.Ids(path)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [*texts, "A\tb\r\nC ", "ΣΣ İx", "é <|x|> café!!", "x y"]:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_letters_of_words_never_go_through_the_whole_tokenizer():
    from types import SimpleNamespace

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, ids, sent = Tokenizer.from_file(path), packing.Ids(path), []
    ids.whole = SimpleNamespace(encode=lambda word, **how: sent.append(word) or whole.encode(word, **how))
    text = " ".join(f"{a}{b}%%%, L'{a}{b}e-{b}2 (\u00e9{a}{b}) {b}{a}'ll_" for a in "abcdefghij" for b in "klmnopqrst")
    assert np.frombuffer(ids.of(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(sent) < 20


def test_word_ids_of_odd_characters_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole, ids = Tokenizer.from_file(path), packing.Ids(path)
    marks = ["H\u0331 x", "H\u0331, T\u0308.", "\u0958, x", "\ufb1d. <|x", "a\x1cb\x1f c", "a\xa0b\u2003c\u0085d", "x<|endoftext|>, y", "'S 'll 'sam I'VE", "_a_ 1,5%", "\u00b5m \u00aa\u00b2"]
    for t in [*marks, *(f"Ab{c}c {c}, {c} 'S{c}x" for c in map(chr, range(0x1000)))]:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_best_fit_plan_places_every_piece_once():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 65) for _ in range(500))
    seen, fill = Counter(), {}
    for length, first, last, bin_, each, offset in packing.plan(dict(counts), 64):
        for r in range(first, last):
            seen[length, r] += 1
            fill.setdefault(bin_ + (r - first) // each, set()).update(range(at := offset + (r - first) % each * length, at + length))
    assert len(seen) == 500 and set(seen.values()) == {1}
    assert sum(len(x) for x in fill.values()) == sum(n * c for n, c in counts.items()) and max(map(max, fill.values())) < 64


def test_mixing_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert (got["taken"] <= 3 * got["size"]).all()


def test_archives_reject_damage(tmp_path):
    import io

    out = io.BytesIO()
    warc.write_archive(out, iter([warc.record(1, "http://a/", b"x" * 50, "a" * 40, None)]))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(out.getvalue()[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"no archive at all")))
    with pytest.raises(ValueError):
        warc.parse(next(warc.frames(io.BytesIO(out.getvalue()))))  # the digest is wrong


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000), (2, None, "x" * 2000), (3, "u", None), (4, "u", "s"), (5, "u", "s")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, warc.write(pages)).collect()}
    assert got == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 0), 4: ("response", None, 1), 5: ("response", None, 1)}
    assert warc.read(spark, warc.write(pages.filter("false"))).collect() == []


def test_lists_count_when_they_are_valid(spark):
    log = spark.createDataFrame([("a.com", "spam", "add", "2024-01-01"), ("a.com", "spam", "remove", "2024-02-01"), ("a.com/x", "adult", "add", "2024-01-15"), (None, "spam", "add", "2024-01-01")], "pattern string, category string, action string, at string").selectExpr("pattern", "category", "action", "cast(at AS timestamp) AS at")
    seen = spark.createDataFrame([(1, "http://w.a.com/", "2024-01-10"), (2, "http://a.com/x/y", "2024-01-20"), (3, "http://a.com/", "2024-02-01"), (4, None, None), (5, "http://ba.com", "2024-01-10")], "page_id long, url string, t string").selectExpr("page_id", "url", "cast(t AS timestamp) AS fetched")
    got = {r["page_id"]: (r["blocked"], r["n_active"], r["categories"]) for r in url_filter.evaluate(seen, log).collect()}
    assert got == {1: (True, 1, "spam"), 2: (True, 2, "adult,spam"), 3: (False, 0, ""), 4: (False, 0, ""), 5: (False, 0, "")}


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Big &amp; new</h1><p>First  <b>words</b>\nhere</p><script>x()</script></article><div class='comments'>bad</div></body></html>"
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame([(1, "http://h/", page), (2, None, None)], "page_id long, url string, html string")).collect()}
    assert got == {1: "Big & new\nFirst words here", 2: ""}


def test_repeated_words():
    assert quality.repeated_words("a b c d e f g h".split() * 2) == 16
    assert quality.repeated_words(list("abcdefghi")) == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    found = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    clean = found[found["toxic"] == 0]
    assert (clean["predicted"] == 1).mean() < 0.05 and found[found["toxic"] == 1]["predicted"].mean() > 0.5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    want = want.astype({c: "float64" for c, kind in want.dtypes.items() if str(kind) == "Int64"})  # Spark gives whole numbers with nulls as floats
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        kept = after
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_near_copies_are_dropped_by_row(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9_000)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    docs = [(None, a, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (2, c + " more", "x"), (0, e, "x"), (1, e + " more", "x"), (3, b, "y"), (3, b, "x"), (None, None, "x"), (None, "", "x")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), SF).collect()
    want = [(None, a, "x"), (1, c, "x"), (1, d, "x"), (0, e, "x"), (3, b, "x"), (None, None, "x"), (None, "", "x")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_copies_of_the_pipeline_take_five_words(spark):
    one = [f"w{i}" for i in range(120)]
    two = [f"x{i}" if i in (20, 60, 100) else w for i, w in enumerate(one)]  # similar by 0.81 in fours, 0.77 in fives
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    assert near_dedup.near_dedup(docs, words=4).filter("kept").count() == 1
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == 2


def test_large_runs_are_compared_in_full(spark):
    rng = random.Random(2)
    # One run of four hashes in one tree; no two nodes share a longer prefix.
    rows = [(bytes([i]), 50, i if i > 40 else 0, [7, (i << 48) + rng.randrange(1 << 40)]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node binary, n long, root long, labels array<long>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and a[2] != b[2]}
    for limit in (1000, 0):
        regions = {}
        for r in near_dedup.candidates(nodes, 1, region=8, limit=limit).collect():
            regions.setdefault(r["region"], set()).add(bytes(r["node"]))
        assert want <= {(x, y) for m in regions.values() for x in m for y in m}


def _joined(size, links):
    """The least member of each member's component."""
    at = list(range(size))
    for a, b in links:
        low, high = sorted((at[a], at[b]))
        at = [low if x == high else x for x in at]
    return at


@pytest.mark.parametrize("size,share", [(1, 1.0), (30, 0.02), (60, 0.05), (200, 0.5), (300, 1.0)])
def test_a_block_sends_as_few_links_as_join_the_same_groups(size, share):
    rng = np.random.default_rng(size)
    linked = np.triu(rng.random((size, size)) < share)
    linked |= linked.T
    for groups in (1, max(size // 5, 1), size):
        group = np.unique(rng.integers(0, groups, size), return_inverse=True)[1]
        found = near_dedup._forest(linked, group)
        want = _joined(group.max() + 1, [(group[i], group[j]) for i, j in np.argwhere(linked)])
        assert all(linked[i, j] for i, j in found)
        assert _joined(group.max() + 1, [(group[i], group[j]) for i, j in found]) == want
        assert len(found) == len(want) - len(set(want))
    assert near_dedup._forest(np.zeros((0, 0), bool), np.zeros(0, np.int64)) == []


def test_runs_are_sought_over_the_whole_host(spark):
    rng = random.Random(4)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(640)]
    notice = "we use small files to know you when you return here"
    rows = [(i, "http://big/" if i < 600 else "http://small/", f"<p>{own[i]}</p><p>{notice} mark{i}</p>" if i % 150 == 0 or i > 630 else f"<p>{own[i]}</p>") for i in range(640)]
    rows += [(700, "http://big/", rows[1][2]), (701, "http://big/", rows[1][2])]  # copies of a page are one page
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: own[i] + (f"\nmark{i}" if i % 150 == 0 or i > 630 else "") for i in range(640)} | {700: own[1], 701: own[1]}
    for part, limit in ((50_000, 1000), (50_000, 0), (1_000_000, 1000)):  # the large host by hashes or by its suffix array
        got = {r["page_id"]: r["text"] for r in html_text.main_text(table, part=part, limit=limit).collect()}
        assert got == want


def test_runs_decide_at_the_edges_of_articles():
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, copied = "all rights to this page stay with its first author", [own(20), own(20)]
    long = [own(60) for _ in range(3)]
    pages = [[(x, True, 0.0), (notice, True, 0.0)] for x in long]  # a notice in the article
    pages += [[(c, True, 0.0) for c in copied] + [(own(3), False, 0.0)] for _ in range(3)]  # copied articles stay
    teaser, body = own(5), own(80)
    pages += [[(teaser, True, 0.0), (body, False, 0.0), (notice, False, 0.0), (own(9), False, 0.9)], [(long[0], True, 0.0), (own(10), False, 0.0)]]
    assert html_text.prune(pages) == [*long, *["\n".join(copied)] * 3, f"{teaser}\n{body}", long[0]]


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for size in [*range(21), 40, 80]:
        for _ in range(12):
            streams = [[rng.randrange(3) for _ in range(rng.randrange(size + 1))] for _ in range(rng.randrange(1, 7))]
            run, pages = rng.randrange(1, 9), rng.randrange(1, 4)
            want = [np.zeros(len(s), bool) for s in streams]
            for s, w in zip(streams, want):
                for i in range(len(s) - run + 1):
                    held = sum(any(t[j : j + run] == s[i : i + run] for j in range(len(t) - run + 1)) for t in streams)
                    w[i : i + run] |= held >= pages
            got = html_text.repeated(streams, run, pages)
            assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_suffix_array_equals_sorting():
    rng = random.Random(9)
    for n in [*range(1, 30), 200]:
        x = [rng.randrange(2) for _ in range(n)]
        order, shared = html_text.suffix_array(np.array(x))
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:])
        for k in range(1, n):
            a, b = x[order[k - 1] :], x[order[k] :]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_names_inside_articles_take_nothing(spark):
    inner = ['<p data-id="nav">one two</p>', '<p data-hidden="false">three</p>', '<div class="share-price">four</div>', '<p class="notice">five</p>', "<math>x</math>"]
    pages = [(i, f"http://h{i}/", f"<body><div class='site-footer'>no</div><article>{x}</article><div hidden>no</div></body>") for i, x in enumerate(inner)]
    pages += [(9, "http://one.page/", "<p>Not Found</p>"), (10, None, "<p>a</p>"), (10, None, "<p>a</p>"), (11, "http://h/", "")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(table).collect()]
    want = [(0, "one two"), (1, "three"), (2, "four"), (3, "five"), (4, "x"), (9, "Not Found"), (10, "a"), (10, "a"), (11, "")]
    assert sorted(got) == [(i, t, len(t)) for i, t in want]
    assert html_text.main_text(table.filter("false")).collect() == []


def test_hostile_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ('<a "' * 40_000, "<div>" * 30_000 + "</p>" * 30_000, "<![CDATA[" * 20_000, "<script x" * 20_000, "<p " + "a " * 100_000, "<!--" * 40_000):
        html_text.blocks(page)
    assert time.process_time() - began < 10


def test_rows_without_ids_of_their_own_stay(spark):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9_000)) for _ in range(60))
    docs = [(None, text(), "a") for _ in range(5)] + [(9, text(), "a"), (9, text(), "b"), (1, text(), "b")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, row_key int")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert sorted(map(str, map(tuple, stage(spark, table, SF).collect()))) == sorted(str((*d, 1)) for d in docs)
        assert stage(spark, table.filter("false"), SF).collect() == []
    twice = table.unionByName(table)
    assert corpus_pipeline.drop_copies(spark, twice, SF).count() == corpus_pipeline.drop_near_copies(spark, twice, SF).count() == len(docs)
    got = corpus_pipeline.mix_sources(spark, table, SF)
    assert got.columns == table.columns and corpus_pipeline.mix_sources(spark, table.filter("false"), SF).collect() == []


def test_huge_documents_are_hashed_in_parts(spark):
    rng = random.Random(12)
    huge = "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(300_000))
    docs = spark.createDataFrame([(1, huge), (2, huge + "b"), (3, huge.replace(" ", "\n")), (4, "ab"), (5, huge + " b "), (6, None)], "doc_id long, text string")
    texts = docs.selectExpr("translate(coalesce(text, ''), ' \\n', '') AS norm").selectExpr("norm", "sha2(norm, 256) AS text_sha256")
    got = {r["text_sha256"]: (r["n"], r["h1"], r["h2"]) for r in exact_dedup.fingerprints(texts, chunk=1000, long=5_000).collect()}
    f = exact_dedup.Fingerprint()
    assert got == {r["text_sha256"]: f.of(r["norm"].encode()) for r in texts.collect()} and len(got) == 4
    for long, limit in ((5_000, 1000), (5_000, 0), (1 << 20, 1000)):
        kept = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, chunk=1000, long=long, limit=limit).collect()}
        assert kept == {(1, 1, 2), (3, 1, 2), (2, 5, 2), (5, 5, 2), (4, 4, 1), (6, 6, 1)}


def _mixed(rows: list[tuple[str, str | None, int]]) -> dict[str, int]:
    """Repeats by key of rows (key, source, size), one source after another."""
    import hashlib

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {s: sum(n for _, t, n in rows if t == s) for s in sources}
    capped: set = set()
    while True:
        left, open_ = sum(size.values()) - sum(3 * size[s] for s in capped), [s for s in sources if s not in capped]
        over = {s for s in open_ if weight[s] * left > 3 * size[s] * sum(weight[x] for x in open_)}
        if not over:
            break
        capped |= over
    out = {}
    for s in sources:
        target = 3 * size[s] if s in capped else weight[s] * left / sum(weight[x] for x in open_)
        whole, ahead = int(target // size[s]) if size[s] else 0, 0
        mark = lambda k: int(hashlib.md5(f"mix-1:{k}".encode()).hexdigest()[:15], 16)
        for k, n in sorted(((k, n) for k, t, n in rows if t == s), key=lambda x: (mark(x[0]) % 1024, mark(x[0]), x)):
            out[k] = whole + (ahead + n / 2 < target - whole * size[s])
            ahead += n
    return out


def _best_fit(lengths: list[int], size: int) -> int:
    """How many bins best-fit decreasing opens, one piece after another."""
    import bisect

    bins: list[int] = []
    n = 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, x)
        room = bins.pop(at) if at < len(bins) else size
        n += room == size and at >= len(bins)
        if room > x:
            bisect.insort(bins, room - x)
    return n


def test_packing_equals_best_fit_one_by_one():
    rng = random.Random(13)
    for size in (16, 64, 500):
        for _ in range(20):
            lengths = [min(size, max(1, int(rng.expovariate(4 / size)))) for _ in range(rng.randrange(1, 400))]
            steps = packing.plan(dict(Counter(lengths)), size)
            used = max((bin_ + (last - first - 1) // each for _, first, last, bin_, each, _ in steps), default=-1) + 1
            assert used == _best_fit(lengths, size)


def test_pipeline_equals_a_plain_version(spark):
    import hashlib
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if _plain_chance(model, r["text"]) < 0.3]
    norm, best = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), {}
    for r in sorted(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        best.setdefault(norm(r), r)
    rows = {r["doc_id"]: r for r in best.values()}
    root = _components({d: r["text"] for d, r in rows.items()}, 5)
    rows = [r for d, r in rows.items() if root[d] == d]
    tagged = lambda x: "n" if x is None else f"v{x}"
    key = lambda r: hashlib.md5("".join(f"{len(x)}:{x}" for x in [tagged(r["doc_id"]), tagged(r["source"]), r["text"] or ""]).encode()).hexdigest().upper()
    times = _mixed([(key(r), r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows])
    whole, want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), []
    for r in rows:
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want += [(r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] * times[key(r)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == _best_fit([x[3] for x in want], 2048)


def _plain_chance(model: toxicity.Model, text: str | None) -> float:
    """A text's score from its words' subsequences, listed one by one."""
    weight = dict(zip(model.codes.tolist(), model.weights))

    def value(w: str) -> np.ndarray:
        w, total, norm = "^" + w, np.zeros(2), 0.0
        for start in range(len(w)):
            for places in toxicity._PLACES:
                if start + places[-1] < len(w):
                    code = sum(ord(w[start + p]) * int(m) for p, m in zip(places, toxicity._MIX)) % 2**64
                    lam = toxicity.DECAY ** (places[-1] + 1)
                    total = total + lam * weight.get(code ^ code >> 29, np.zeros(2))
                    norm += lam**2
        return model.bias + total / (norm**0.5 + 1e-9)

    found = toxicity.tokens(text.lower() if text else text)
    each = {t: np.max([value(w) for w in toxicity.forms(t)] or [np.full(2, -9.0)], axis=0) for t in set(found)}
    marked = sum(float(np.clip(4 * each[t][1] - 1, 0, 1)) for t in found)
    measured = np.array([[max([each[t][0] for t in found], default=-9.0), marked, len(found)]])
    return float(model.chance(measured)[0])


def test_scores_equal_subsequences_listed_one_by_one(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(25).collect()] + [None, "", "x" * 200, "a b c d", "\u00e9\U0001f600 q\u00df"]
    got = model.chance(model.measurer()([t.lower() if t else t for t in texts]))
    assert got == pytest.approx([_plain_chance(model, t) for t in texts], abs=1e-5)


def test_all_words_as_landmarks_give_the_kernel_machine():
    bad, good = {"grumpf": 3, "grumpel": 2}, {"garden": 4, "water": 1, "grams": 1}
    codes, weights, bias = toxicity.fit_words(bad, good, landmarks=5, ridge=1e-3)
    names = [*bad, *good]
    x = toxicity.features(names, np.unique(np.concatenate([c for _, c, _ in toxicity.coded(names)])))
    kernel, y = (x @ x.T).astype(float), np.array([1.0, 1, -1, -1, -1])
    c = np.array([3 / 5, 2 / 5, 4 / 6, 1 / 6, 1 / 6]) / 2
    a, b, now = np.zeros(5), 0.0, None
    for _ in range(200):  # Newton steps in the dual variables of the kernel itself
        inside = y * (kernel @ a + b) < 1
        lhs = np.block([[(c * inside)[:, None] * kernel + 1e-3 * np.eye(5), (c * inside)[:, None]], [(c * inside) @ kernel, np.array([[(c * inside).sum() + 1e-9]])]])
        a_b = np.linalg.solve(lhs, np.append(c * inside * y, (c * inside * y).sum()))
        a, b = a_b[:5], a_b[5]
    model = toxicity.joined((codes, weights, bias), (codes, weights, bias))
    assert model.values(names)[:, 0] == pytest.approx(kernel @ a + b, abs=2e-2)


def test_languages_equal_plain_backoff(spark):
    import math
    import zlib

    rng = random.Random(14)
    words = {"aa": ["bal", "balo", "kirun", "tas"], "bb": ["zub", "zubel", "mork", "tas"]}
    docs = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 9))), x) for i in range(40) for x in [rng.choice("ab") * 2]]
    docs += [(100, "balomork Zubelu 12", None), (101, "qqq", None), (102, "12 !!", None), (103, None, "aa"), (104, "", "bb")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    by, grams = {"aa": Counter(), "bb": Counter()}, {"aa": Counter(), "bb": Counter()}
    for i, t, x in docs:
        if x and t and zlib.crc32(str(i).encode()) % 3 != 1:
            by[x].update(t.split())
            grams[x].update(f"^{w}$"[j : j + n] for w in t.split() for n in range(1, 6) for j in range(len(w) + 3 - n))
    langs = sorted(by)

    def logs(tables: dict[str, Counter], totals: dict[str, float]) -> dict[str, list[float]]:
        keys = {k for k in set().union(*tables.values()) if sum(t[k] for t in tables.values()) > 1}
        rows = {k: [math.log((tables[x][k] + 0.1) / (totals[x] + 0.1 * len(keys))) for x in langs] for k in keys}
        return {k: [v - sum(r) / len(r) for v in r] for k, r in rows.items()}

    known = logs(by, {x: sum(by[x].values()) for x in langs})
    shown = logs(grams, {x: sum(n for g, n in grams[x].items() if sum(t[g] for t in grams.values()) > 1) / 5 + 1 for x in langs})

    def word(w: str) -> list[float]:
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            at = [shown[g] for j in range(len(w) + 3 - n) if (g := f"^{w}$"[j : j + n]) in shown]
            if at:
                return [sum(c) / len(at) for c in zip(*at)]
        return [0.0] * len(langs)

    for i, t, _ in docs:
        found = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not found:
            assert got[i] == ("und", 0.0)
            continue
        total = [sum(c) / len(found) ** 0.5 for c in zip(*map(word, found))]
        chance = [math.exp(v - max(total)) for v in total]
        assert got[i][0] == langs[chance.index(max(chance))] and got[i][1] == pytest.approx(max(chance) / sum(chance), abs=1e-4)


def test_base_rules_equal_plain_loops(spark):
    rng = random.Random(15)
    texts = [None, "", " \n ", "a", "# $ <x>"] + ["\n".join(" ".join(rng.choice(["ab", "c#", "Dé", "e", "f"][: rng.randrange(1, 6)]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality.rules(spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        rep = {k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_least_determinant_equals_trying_all_subsets():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(3):
        x = rng.normal(0, 0.3, (12, len(quality.NAMES)))
        x[:3] += 2
        best = min(np.linalg.slogdet(quality._scatter(x[list(c)])[1])[1] for c in combinations(range(12), 9))
        assert quality.search(x)[2] == pytest.approx(best, abs=1e-9)


def test_very_deep_addresses_and_odd_captures(spark):
    log = spark.createDataFrame([("a.com/x", "spam", "add", "2024-01-01"), ("a.com/x", "spam", "add", "2024-01-01"), ("a.com", "ad", "add", "2024-01-05"), ("a.com", "ad", "remove", "2024-01-05")], "pattern string, category string, action string, at string").selectExpr("*", "1 AS host").selectExpr("pattern", "category", "action", "cast(at AS timestamp) AS at", "host")
    seen = spark.createDataFrame([(1, "http://a.com/x" + "/y" * 16_000, "2024-02-01", "c"), (1, "http://a.com/x" + "/y" * 16_000, "2024-02-01", "c"), (2, "http://a.com/xy", "2024-02-01", "c"), (3, "http://a.com/x/", None, "c")], "page_id long, url string, t string, pattern string").selectExpr("page_id", "url", "cast(t AS timestamp) AS fetched", "pattern")
    got = [(r["page_id"], r["n_active"], r["pattern"]) for r in url_filter.evaluate(seen, log).collect()]
    assert sorted(got, key=str) == [(1, 1, "a.com/x"), (1, 1, "a.com/x"), (2, 0, None), (3, 0, None)]
    assert url_filter.evaluate(seen.filter("false"), log).collect() == [] and url_filter.evaluate(seen, log.filter("false")).filter("blocked").count() == 0


def test_no_link_is_lost_among_a_thousand_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(path).select("doc_id", "text").collect()}
    held: dict[tuple, list[int]] = {}
    sizes, root = {}, {d: d for d in docs}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        own = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        sizes[d] = len(own)
        for x in own:
            held.setdefault(x, []).append(d)
    shared = Counter((a, b) for own in held.values() for i, a in enumerate(own) for b in own[i + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (sizes[a] + sizes[b] - n)]
    before = None
    while before != root:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_dedup(spark.read.parquet(path)).collect()
    assert len(links) > 50 and {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {d: (root[d], sizes[d]) for d in docs}
