"""Jaro in linear time and similar papers by tiles, against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import similarity
from quire.functions.similarity import Texts, jaro, jaro_pairs, rounded
from quire.operators import dedupe, similar
from quire.schemas import PAPER_INDEX


def texts(r, letters, most, n):
    return list({"".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)})


@pytest.mark.parametrize(("letters", "most"), [("ab", 6), ("abc ", 12), ("abcdefghijklmnopqrstuvwxyz ", 200), ("aé漢\U0001f600z", 40), ("".join(map(chr, range(0x4E00, 0x4F80))), 60)])
@pytest.mark.parametrize("chunk", [1 << 17, 300])
def test_jaro_pairs_are_the_plain_ones(letters, most, chunk, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK_LETTERS", chunk)
    r = random.Random(most)
    some = texts(r, letters, most, 300)
    a, b = (np.array([r.randrange(len(some)) for _ in range(2000)]) for _ in "ab")
    want = [jaro(some[x], some[y]) for x, y in zip(a, b, strict=True)]
    assert jaro_pairs(Texts(some), a, b).tolist() == want
    assert jaro_pairs(Texts(some), b, a).tolist() == want  # either may come first


def test_jaro_of_long_texts_is_linear():
    r = random.Random(3)
    some = ["".join(r.choice("abcdefgh ") for _ in range(60_000)) for _ in range(4)]
    began = time.perf_counter()
    a, b = np.triu_indices(4, 1)
    jaro_pairs(Texts(some), a, b)
    assert time.perf_counter() - began < 20  # the plain version takes minutes


def test_jaro_takes_the_letters_of_the_shorter_text():
    r = random.Random(4)
    some = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in [20_000] * 60 + [20] * 30]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60, 90)))
    began = time.perf_counter()
    jaro_pairs(Texts(some), a, b)
    assert time.perf_counter() - began < 2  # by the letters of the first text 5 s and more


@pytest.mark.parametrize("least", [0.5, 0.6994, 0.9])
def test_jaro_with_a_threshold_loses_no_pair(least):
    r = random.Random(6)
    some = texts(r, "abcd", 30, 80)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(len(some))))
    full, got = jaro_pairs(Texts(some), a, b), jaro_pairs(Texts(some), a, b, least)
    assert ((got == full) | ((got == 0) & (full < least))).all() and (full >= least).sum() > len(some)


def test_rounding_is_sqls(spark):
    import duckdb

    values = [k / 2000 for k in range(2001)] + [0.5075 - 1e-16, 0.8495, 0.84949999999999]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(rounded(F.col("v"))).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]


def papers(spark, rows):
    return spark.createDataFrame([(f"1990_{i:04}", 1990, "f", t, 1, w, a, "p") for i, (t, w, a) in enumerate(rows)], PAPER_INDEX)


def rows(r, n):
    titles = texts(r, "abcdef ", 14, 12) + ["wheat in dry areas", "wheat in dry area", "wheat on dry areas", "a" * 90, None, "", " "]
    authors = texts(r, "abc", 5, 8) + ["martha", "marhta", None, "", "1"]
    return [(r.choice(titles), r.choice([1, 2, 2, None]), r.choice(authors)) for _ in range(n)]


@pytest.mark.parametrize("size", [1024, 7])
@pytest.mark.parametrize("tier", [None, dedupe.DEFAULT, dedupe.STRICT, dedupe.MODERATE, dedupe.Tier("low", 0.3, 0.4)])
@pytest.mark.parametrize("block_on", ["word_count", None])
def test_tiles_find_every_pair(spark, size, tier, block_on):
    if not block_on and not tier:
        pytest.skip("all pairs need a tier")
    base = papers(spark, rows(random.Random(5), 120))
    sides = [tuple(x) for x in dedupe._sides(base, "first_author", "title").collect()]
    plain = [[None if u is None or v is None else jaro(u, v) for u, v in ((x[2], y[2]), (x[3], y[3]))] for x in sides for y in sides]
    sims = [x[0] for x in spark.createDataFrame([(s,) for p in plain for s in p], "v double").coalesce(1).select(rounded(F.col("v"))).collect()]
    want = []
    for k, (x, y) in enumerate((x, y) for x in sides for y in sides):
        au, ti = sims[2 * k : 2 * k + 2]
        blocked = not block_on or x[1] is not None and x[1] == y[1]
        good = not tier or au is not None and ti is not None and au >= tier.author and ti >= tier.title
        if x[0] < y[0] and blocked and good:
            want.append((x[0], y[0], au, ti, x[1]))
    found = dedupe.similar_pairs(base, block_on, tier, tile_rows=size)
    if tier:
        found = found.filter((F.col("author_sim") >= tier.author) & (F.col("title_sim") >= tier.title))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert want


def test_a_tile_is_bounded_and_an_empty_table_passes(spark):
    base = papers(spark, [(f"{'x' * 40}", 5, "a")] * 300)
    sides = dedupe._sides(base, "first_author", "title").withColumn("block", F.lit(5))
    for most in ({"tile_rows": 50}, {"tile_rows": 1000, "tile_chars": 2000}):
        tiles = similar.dealt(sides, **most).groupBy("i", "j").count().collect()
        assert len(tiles) == 21 and max(x["count"] for x in tiles) < 160
    assert dedupe.similar_pairs(base).count() == 300 * 299 // 2
    assert dedupe.similar_pairs(base.limit(0)).count() == dedupe.duplicate_pairs(base.limit(0), block_on=None).count() == 0


def test_an_authors_papers_share_a_tile(spark):
    base = papers(spark, [(f"t{i}", 5, chr(97 + i % 10) + chr(97 + i // 10 % 10) if i < 1000 else "frequent" if i < 1400 else None) for i in range(1500)])
    sides = dedupe._sides(base, "first_author", "title").withColumn("block", F.lit(5))
    own = similar.dealt(sides, 100).filter("i = j").groupBy("au").agg(F.count_distinct("tile").alias("tiles"), F.count("*").alias("n")).collect()
    assert {x["tiles"] for x in own if x["au"] not in ("frequent", None)} == {1} and sum(x["n"] for x in own) == 1500
    assert {x["au"]: x["tiles"] for x in own}["frequent"] > 10  # one that would fill several tiles is dealt out


def test_only_titles_that_meet_are_spelled_out(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(similar, "Texts", lambda texts: seen.append(sorted(texts)) or Texts(texts))
    n, authors = 6, ["smith", "smith", "jones", "brown", "smiht", "miller"]
    table = pa.table({"block": [1] * n, "i": [0] * n, "j": [0] * n, "tile": [0] * n, "own": [True] * n, "id": list("abcdef"), "word_count": [5] * n, "au": authors, "ti": ["wheat", "wheta", "w", "wh", "x" * 90, "y"]})
    got = [tuple(x.values()) for batch in similar._pairs(table, (0.9, 0.9)) for x in batch.to_pylist()]
    assert [(a, b) for a, b, *_ in got] == [("a", "b")] and seen[1:] == [["wheat", "wheta"]]  # all six titles were


def test_a_low_tier_has_no_classes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dedupe, "similar", lambda rows, *a: seen.append(rows) or similar.similar(rows, *a))
    base = papers(spark, [("x" * n, 5, "a") for n in (1, 9, 10, 100, 1000)])
    dedupe.duplicate_pairs(base, dedupe.MODERATE, None)
    assert seen[0].count() == 5 and seen[0].select("block").distinct().count() == 1  # each paper was in two classes


def same_as_sql(spark, name, sf):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, f"/root/testdata/{sf}").collect()), key=str) == sorted(want, key=str)


def test_jaro_scores_at_a_tenth(spark):
    same_as_sql(spark, "jaro_scores", "sf0.1")  # 85307 rows, long titles among them


def test_all_pairs_of_a_tier_at_a_tenth(spark):
    same_as_sql(spark, "duplicate_pairs_strict_all", "sf0.1")


def test_all_pairs_of_a_low_tier_at_a_tenth(spark):
    same_as_sql(spark, "duplicate_pairs_moderate_all", "sf0.1")


@pytest.mark.parametrize("name", ["expand_duplicates", "sync_check", "duplicate_pairs_moderate", "duplicate_pairs_moderate_all"])
def test_queries_on_similar_papers_are_sqls(spark, name):
    same_as_sql(spark, name, "sf0.01")
