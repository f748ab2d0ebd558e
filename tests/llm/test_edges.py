"""Nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest

import corpus_pipeline
from quire.llm import decontamination, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, warc

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, line string, bucket int, _id string, a string, component_id string"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))


def rows():
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "a b c d e f g h i j k l"), (None, None), (7, "é ß 漢字 " * 30)]
    return [(i, t, None, "s", None, 1, "x", 1, "y", "z", "c") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "what is the answer of all. forty two."), (2, None), (None, "x y"), (3, "")], "item_id bigint, text string")


def run(name, docs, bench, labels):
    return {
        "licence": lambda: license_scan.query(docs), "rules": lambda: quality_rules.query(docs), "secrets": lambda: secret_scan.query(docs),
        "substring": lambda: substring_dedup.query(docs), "join": lambda: ngram_join.query(docs), "quality": lambda: quality_classifier.query(docs, labels),
        "packing": lambda: packing.query(docs), "bench": lambda: decontamination.query(docs, bench), "lines": lambda: line_dedup.query(docs),
        "cut": lambda: substring_dedup.apply(docs), "kept": lambda: ngram_join.keep_one(docs),
    }[name]()


NAMES = ("licence", "rules", "secrets", "substring", "join", "quality", "packing", "bench", "lines", "cut", "kept")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, bench, name):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    out = run(name, odd, bench, labels).collect()
    if name in ("licence", "rules", "secrets", "join", "quality", "lines", "cut"):
        assert len(out) == len(rows())
    if name == "join":
        at = {}
        for r in out:
            at.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
        assert at[1] == [(0, 1)] and at[2] == [(0, 2)] and at[4] == [(1, 4)]
        assert {x[1] for x in at[5] + at[6]} == {5}
        assert {x[1] for x in at[None]} == {None}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, bench, name):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert run(name, odd.limit(0), bench.limit(0), labels).collect() == []


def test_warc(spark):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "u", big), (2, None, big), (3, "u", None), (4, "v", "small"), (5, "v", "small")], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.query(pages).collect()}
    assert got == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None)}
    assert warc.query(pages.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    last = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= last and ids
        last = ids
        if i < 4:
            assert docs.columns == columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == last
