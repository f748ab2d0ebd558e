import pytest
from pyspark.sql import functions as F

from quire.operators import dedupe, index, sampling, sync, wordfreq
from quire.schemas import MANUAL_FIXES, PAPER_INDEX
from quire.sources import papers as io


def papers(spark, rows):
    return spark.createDataFrame([(i, 1990, "f", t, 1, w, a, "p") for i, t, w, a in rows], PAPER_INDEX)


def test_ids_and_unreadable_files(spark):
    pages = spark.createDataFrame([("/x/1996/b.pdf", ["T\nx"]), ("/x/1996/a.pdf", None)], "path string, pages array<string>")
    got = {r["filename_original"]: r for r in index.build_index(pages).collect()}
    assert (got["a.pdf"]["id"], got["b.pdf"]["id"]) == ("1996_0001", "1996_0002")
    assert (got["a.pdf"]["title"], got["a.pdf"]["page_count"], got["a.pdf"]["word_count"]) == (None, None, None)


def test_rows_update(spark):
    base = papers(spark, [("1", "t", 5, "a"), ("2", "u", 5, "b")])
    new = spark.createDataFrame([("1", None), ("9", "x")], "id string, title string")
    assert {r["id"]: r["title"] for r in index.rows_update(base, new).collect()} == {"1": None, "2": "u"}
    with pytest.raises(Exception, match="not in target"):
        index.rows_update(base, new, unmatched="error").collect()
    twice = spark.createDataFrame([("1", "x"), ("1", "y")], "id string, title string")
    with pytest.raises(Exception, match="repeated update key"):
        index.rows_update(base, twice).collect()
    fixes = spark.createDataFrame([("1", "no change", "New"), ("2", "  ", None)], MANUAL_FIXES)
    assert {r["id"]: (r["title"], r["first_author"]) for r in index.apply_fixes(base, fixes).collect()} == {"1": ("New", "a"), "2": ("u", "b")}


def test_duplicates_and_resolution(spark):
    base = papers(spark, [("1", "Wheat in dry areas", 9, "Ann"), ("2", "Wheat in dry areas", 9, "Ann"), ("3", "Wheat in dry areas", 8, "Ann"), ("4", None, 9, "Ann"), ("5", "x", None, "Ann")])
    pairs = dedupe.duplicate_pairs(base)
    assert [(r["id_a"], r["id_b"]) for r in pairs.collect()] == [("1", "2")]
    assert dedupe.expand_pairs(pairs, base).count() == 2
    assert {r["id"] for r in dedupe.exact_title_duplicates(base).collect()} == {"1", "2", "3"}
    chain = spark.createDataFrame([("1", "2"), ("2", "1"), ("2", "3")], "id string, matched_id string")
    assert {r["id"] for r in dedupe.resolve_duplicates(base, chain).collect()} == {"1", "4", "5"}
    over = spark.createDataFrame([("2", "1", "2"), ("7", "8", "8"), ("2", "3", "zz")], "id_a string, id_b string, keep_id string")
    got = {(r["id_a"], r["id_b"]): r["drop_id"] for r in dedupe.resolved_pairs(chain, over).collect()}
    assert got == {("1", "2"): "1", ("2", "3"): "2"}


def test_sync(spark):
    base = papers(spark, [("1", "t", 1, "a"), ("2", "t", 1, "a")])
    files = io.flat_files(spark.createDataFrame([("/f/1.pdf",), ("/f/3.pdf",)], "path string"))
    assert [r["id"] for r in sync.sync_plan(files, base).collect()] == ["3"]
    assert tuple(sync.sync_check(files, base).first()) == (2, 2, 1, 1, False)
    with pytest.raises(ValueError):
        sync.delete_files(files)


def test_tokens(spark):
    corpus = spark.createDataFrame([("1", 1990, "Don't e.g. 3.5 co-operate foo_bar 10kg naïve Cropping rates"), ("2", 1990, None)], "id string, year int, text string")
    kept = wordfreq.letters_only(wordfreq.tokens(corpus))
    assert [r["word"] for r in kept.orderBy("pos").collect()] == ["co", "operate", "cropping", "rates"]
    assert sorted(r["word"] for r in wordfreq.tokenize(corpus).collect()) == ["co", "crop", "oper", "rate"]
    three = spark.createDataFrame([("1", i, "cropping", "crop") for i in range(3)], "id string, pos int, word string, stem string")
    assert tuple(wordfreq.stem_examples(three).first()) == ("crop", 3, "cropping, NA, NA")


def test_top_terms(spark):
    counts = spark.createDataFrame([(1985, f"w{i}", max(3, 12 - i)) for i in range(12)], "year int, word string, n bigint")
    assert wordfreq.top_terms(counts).count() == 12
    assert wordfreq.top_terms(counts, ties=False).count() == 10
    themes = spark.createDataFrame([(1984, "x", None)], "year int, theme string, location string")
    top = wordfreq.plot_frame(wordfreq.top_terms(counts, themes=themes)).orderBy("order_in_facet").collect()
    assert top[0]["facet_label"] == "1985\nNA" and top[-1]["word"] == "w0"
    assert wordfreq.svg_bars(top).startswith("<svg")


def test_sampling_and_csv(spark, tmp_path):
    base = papers(spark, [(str(i), 'a "b"\n c', 1, None) for i in range(3)])
    assert sampling.sample_k_per_group(base, 5).count() == 3
    assert sampling.first_k_per_group(base, 2).count() == 2
    io.write_csv(base, f"{tmp_path}/c")
    back = io.read_csv(spark, f"{tmp_path}/c", PAPER_INDEX)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, base.collect()))
    assert base.filter(F.col("first_author").isNull()).count() == 3
