"""What odd rows come out as: nulls, empty and long texts, ties, repeated rows and clashing names, for operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from popspark.llm import exact_dedup, language, mixing, near_dedup, packing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
LONG = "word " * 30_000
ODD = [(1, None, None, None, 0, "x", "y"), (2, "", "en", "a", 0, None, None), (3, " \n ", "en", "a", 3, None, None), (4, "one two", "en", "a", 7, None, None), (4, "one two", "en", "a", 7, None, None), (None, "one  two", "de", None, 8, None, None), (5, LONG, "en", "b", 0, None, None), (6, "x" * 100_000, None, "b", 0, None, None), (7, "12 34 !!", "de", "c", 8, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def _by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=str)


def test_languages_of_odd_rows(spark, odd):
    import zlib

    assert {(r["lang_pred"], r["score"]) for r in language.identify(odd).collect()} == {("und", 0.0)}  # all ids are held out, or null, or have no letter
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    seen = spark.createDataFrame([(ids[k], *r[1:]) for k, r in enumerate(ODD)], DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(seen).collect()}
    assert all(got[ids[k]] == ("und", 0.0) for k in (0, 1, 2, 8)) and got[ids[6]][0] == "en" and all(got[ids[k]][0] in ("de", "en") and 0 < got[ids[k]][1] <= 1 for k in (3, 4, 5, 6, 7))


def test_exact_copies_of_odd_rows(odd):
    got = _by_id(exact_dedup.exact_dedup(odd), "keep_id", "group_size", "kept")
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True)]  # the longest of the empty ones stays
    assert [x[2] for x in got if x[0] in (4, None)] == [3, 3, 3] and sum(x[3] for x in got if x[0] in (4, None)) == 1  # "one  two" is the longest
    assert [x for x in got if x[0] in (5, 6, 7)] == [(5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)]


def test_near_copies_of_odd_rows(odd):
    got = _by_id(near_dedup.near_dedup(odd.filter("doc_id IS NOT NULL")), "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True)], key=str)


def test_sizes_of_odd_rows(odd):
    got = {(r["doc_id"], r["size"]) for r in mixing.mix(odd).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (4, 2), (None, 2), (5, 30_000), (6, 1), (7, 3)}
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix(odd).collect())


def test_pieces_of_odd_rows(odd):
    got = packing.pack(odd).toPandas()
    assert sorted(got[got["doc_id"].isin([1, 2, 3])]["length"]) == [1, 1, 1] and sorted(got[got["doc_id"] == 4]["length"]) == [3, 3]
    long = got[got["doc_id"] == 5].sort_values("piece")
    assert long["length"].sum() == 30_001 and (long["start"] == long["piece"] * 2048).all() and (long["length"].iloc[:-1] == 2048).all()
    used = got.sort_values(["sequence_id", "offset"])
    assert (used.groupby("sequence_id")["length"].cumsum() - used["length"] == used["offset"]).all()


def test_quality_of_odd_rows(odd):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality.rules(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 0, 0, True, False) and got[4] == (2, 6, 0, True, False) and got[5] == (30_000, 120_000, 30_000, True, False) and got[6] == (1, 100_000, 0, True, False)


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "é" * 700, "x"), (1, None, "é" * 700, "x"), (None, "u", "é" * 700, "x"), (2, "http://a/", "y" * 3_000_000, "x"), (3, "", None, "x")], "page_id long, url string, html string, payload_digest string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.write(pages)).collect()), key=str)
    assert [x[:2] for x in got] == sorted([(1, 1400), (1, 1400), (None, 1400), (2, 3_000_000), (3, 0)], key=str)
    assert [x[2:] for x in got if x[0] in (2, 3)] == [("response", None), ("response", None)] and all(x[3] == 1 for x in got if x[2] == "revisit")


def test_stages_of_odd_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = {"toxicity": 9, "exact_dedup": 5, "near_dedup": 5}
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
        if name in want:
            assert docs.count() == want[name]
    texts = {r["text"] for r in docs.collect()}
    assert texts <= {r[1] for r in ODD} and LONG in texts
    assert packed_length(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))) > 30_000


def packed_length(packed) -> int:
    return packed.agg(F.sum("length")).first()[0]


def test_the_pipeline_of_an_empty_table(spark, odd, tmp_path):
    odd.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and {"doc_id", "piece", "sequence_id"} <= set(got.columns)


def test_scores_of_odd_rows_with_a_model(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x" * 50_000), (5, "12 !!"), (6, LONG)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in rows.select("doc_id", toxicity.chance(model)(F.col("text")).alias("s")).collect()}
    assert got[1] == got[2] == got[3] and all(0 <= s <= 1 for s in got.values()) and got[1] < toxicity.CUT


@pytest.mark.parametrize("most", [65_536, 1000])
def test_a_hundred_thousand_equal_rows_are_mixed_and_packed(spark, monkeypatch, most):
    from popspark.llm import common

    monkeypatch.setattr(common, "COPIES", most)
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("web").alias("source"), F.lit("one two three").alias("text"))
    docs = hot.unionByName(spark.range(50).select("id", F.lit("books"), F.expr("repeat('word ', cast(id as int))")).toDF("doc_id", "source", "text"))
    got = mixing.mix(docs)
    sums = {r["source_size"]: r for r in got.groupBy("source_size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert sums[300_000]["n"] == 100_000 and sums[1225]["n"] == 50
    assert all(abs(r["taken"] - r["target"]) <= 50 for r in sums.values())
    packed = packing.pack(docs)
    assert packed.count() == 100_050 and packed.select("sequence_id", "offset").distinct().count() == 100_050
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.filter("n <> end or n > 2048").isEmpty()


def test_smaller_buckets_change_no_decision(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.expr("substring('abbccc', cast(id % 6 as int) + 1, 1)").alias("source"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"))
    whole, halved = (mixing.mix(docs, **more).toPandas().sort_values("doc_id").reset_index(drop=True) for more in ({}, {"bucket_rows": 1}))
    assert whole.equals(halved) and len(whole) == 10_000 and whole["repeats"].nunique() > 1
    bins = lambda x: x.select("sequence_id").distinct().count()
    assert bins(packing.pack(docs)) == bins(packing.pack(docs, bucket_rows=3))


def test_a_line_end_in_a_column_makes_no_equal_keys(spark):
    rows = spark.createDataFrame([(1, "A\nvB", "C"), (1, "A", "vB\nC")], "doc_id long, source string, text string")
    assert rows.select(corpus_pipeline._row_key(rows, "source").alias("k")).distinct().count() == 2
