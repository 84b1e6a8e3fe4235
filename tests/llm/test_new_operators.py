"""Operators 11 to 13 against plain versions, on the driver's rows and on odd ones."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.llm import fill_middle, manifest, pieces, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, form string, n string, root string, ids string, grp string"
TEXTS = [None, "", " \n ", "a", "one two", "one two", "  lead and trail \t", "has <P> mark", "ends <", "é\U0001f600 \x1fx y \U0001f600", "w " * 20_000, "x" * 100_000, " " * 50_000, "\x00\n\x0b\x0c\r"]
ODD = [(i // 2 if i % 5 else None, t, [None, "en", "de", "ü", "\U0001f600"][i % 5], "s", i, "x", "y", "z", "i", "g") for i, t in enumerate([*TEXTS, *TEXTS[3:9]])] + [(7, "same", "en", "s", 1, "", "", "", "", "")] * 3


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _moved(doc_id, text):
    """n, form, prefix, middle and output of one text, by the grammar's own pattern."""
    text = text or ""
    found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(found) == text
    digest, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(found)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_a_plain_version(spark, odd):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(i, t) for i in range(100, 140) for t in TEXTS], "doc_id long, text string")
    forms = set()
    for docs in (odd, real, more):
        want = [(r["doc_id"], *_moved(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()]
        got = fill_middle.restore(fill_middle.transform(docs)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        forms |= {r["form"] for r in got}
    assert forms == {"plain", "psm", "spm"} and fill_middle.transform(odd.filter("false")).collect() == []


def test_other_grammars_lose_nothing(spark, odd):
    for grammar, text, want in (("lines", "a\n\nb\nc", ["a\n", "\n", "b\n", "c"]), ("chars", "a\U0001f600\n", ["a", "\U0001f600", "\n"]), ("parts", "getHTTPUrl42 ünX", ["get", "HTTPUrl", "42", " ", "ün", "X"]), ("words", " a  b ", [" a", "  b", " "])):
        assert spark.range(1).select(fill_middle.units(F.lit(text), grammar)).first()[0] == want
        got = fill_middle.restore(fill_middle.transform(odd, grammar=grammar, rate=100, seed=3)).select("doc_id", "restored")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], r[1] or "")) for r in ODD)


def _root(nodes: list[str], fanout: int = 8) -> str:
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0]


def _proofs(nodes: list[str], fanout: int = 8) -> list[list[str]]:
    """The other nodes of the run at each level, for each leaf."""
    out, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, i in zip(out, at):
            first = i - i % fanout
            proof.append("".join(n for j, n in enumerate(nodes[first : first + fanout], first) if j != i))
        nodes, at = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return out


def _leaf(r) -> str:
    return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in queries.FIELDS))


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (2, 1), (3, 2), (8, 1)])
def test_manifest_equals_a_plain_version(spark, odd, fanout, levels):
    some = odd.limit(12).unionByName(odd) if levels == 2 else odd
    for docs in (some, spark.read.parquet(f"{SF}/documents.parquet").select(queries.FIELDS)) if fanout != 3 else (some,):
        by: dict = {}
        for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r))):
            by.setdefault(r["lang"], []).append((r["doc_id"], _leaf(r)))
        order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
        subroots = [_root([x for _, x in by[g]], fanout) for g in order]
        upper, root, want = _proofs(subroots, fanout), _root(subroots, fanout), []
        for g, subroot, more in zip(order, subroots, upper):
            want += [(i, leaf, subroot, root, proof + more) for (i, leaf), proof in zip(by[g], _proofs([x for _, x in by[g]], fanout))]
        got = manifest.manifest(docs, queries.FIELDS, fanout=fanout, levels=levels).collect()
        assert sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"])) for r in got) == sorted(map(str, want))
        assert all(manifest.fold(r["leaf"], r["slots"], r["proof"]) == root for r in got)
        assert all(manifest.fold("0" * 64, r["slots"], r["proof"]) != root for r in got)


def test_manifests_of_few_rows(spark, odd):
    assert manifest.manifest(odd.filter("false"), queries.FIELDS).collect() == []
    one = odd.filter("doc_id = 0 and text = ''")
    (r,) = manifest.manifest(one, queries.FIELDS, keep=["root", "grp"]).select("leaf", "subroot", manifest.folded(F.col("leaf"), F.col("slots"), F.col("proof")).alias("f"), "proof", "grp").collect()
    assert r["leaf"] == r["subroot"] == r["f"] == _leaf(one.first()) and r["proof"] == [] and r["grp"] == "g"


def test_equal_rows_spread_over_ranges(spark):
    rows = spark.range(40_000).selectExpr("CAST(NULL AS BIGINT) AS id", "'x' AS lang", "'d' AS digest").repartition(16)
    got, groups = manifest.ranked(rows, ["lang"], ["id", "digest"])
    assert groups.collect()[0]["n"] == 40_000 and got.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (40_000, 0, 39_999)
    keys = [F.col(c).asc_nulls_first() for c in ("lang", "id", "digest", "turn")]
    sizes = [r["count"] for r in rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 15_000


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_ids_equal_the_library(spark, odd, library):
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")):
        want = [(r["doc_id"], ids := library.encode(r["text"] or ""), library.decode(ids)) for r in docs.collect()]
        got = pieces.encode(docs).withColumn("text", pieces.decoded(F.col("ids"))).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert pieces.encode(odd.filter("false")).collect() == []


def test_merge_rounds_equal_one_merge_after_another(library):
    own, rng = pieces.loaded(pieces.model_path()), random.Random(16)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    alphabet = "  ▁\n\tabcdefghiThe=-x<>sé日本\U0001f600\x00ﷺ0123"
    for k in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) if k % 3 else "".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))).replace("▁", " ")
        text = text.replace("a", " " * rng.randrange(90)) if k % 5 == 0 else text
        assert np.frombuffer(own.encode([text])[0], "<i4").tolist() == library.encode(text)
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, np.int64), np.array([len(ids)])) == [library.decode(ids)]


def test_long_words_take_few_rounds(library):
    import time

    own, rng, began = pieces.loaded(pieces.model_path()), random.Random(17), time.process_time()
    for text in ("x" * 200_000, " " * 200_000, "=" * 100_001, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))):
        assert np.frombuffer(own.encode([text])[0], "<i4").tolist() == library.encode(text)
    assert time.process_time() - began < 20


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m"))


def test_equal_rows_of_the_outliers_are_dealt_out(spark):
    from popspark.llm import quality

    rows = spark.range(14_000).selectExpr("'g' AS group", "CASE WHEN id < 12000 THEN 5 ELSE id END AS row", "CAST(14000 AS BIGINT) AS size").repartition(4)
    sizes = [r["count"] for r in quality.dealt(rows, 2000).groupBy("part").count().collect()]
    assert sum(sizes) == 14_000 and max(sizes) < 3000
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words that are the same in each of a very large number of rows of one table and so on and on").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert quality.rules(docs).groupBy("kept").count().collect() == [(True, 5000)]
