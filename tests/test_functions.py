import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions import titles as T
from quire.functions.porter import stemmed
from quire.functions.similarity import jaro, jaro_column


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(column(F.col("x"))).collect()]


def test_transliteration_and_squish(spark):
    assert values(spark, ["’‘“”–—™®°�"], X.transliterate) == ["''\"\"--TM(R) degrees"]
    assert values(spark, [" a \t b\n", None], X.squish) == ["a b", None]
    assert values(spark, [" No Change ", None, "  ", "New title"], X.changed_to) == [None, None, None, "New title"]


def test_paths(spark):
    paths = ["/x/1985/a.pdf", "/x/1985/sub/a.pdf", "/x/papers_flat/a.pdf"]
    assert values(spark, paths, X.year_of) == [1985, None, None]
    assert values(spark, paths, X.in_year_folder) == [True, True, False]


def test_authors(spark):
    names = [
        "1980_A. Axelsen_Improved Plant Management.pdf", "1980_A. D. Doyle and N. W. Forrester_Surface.pdf",
        "1980_Ann Petch_Crop Sequences.pdf", "1996_A CASE STUDY_Poster Papers.pdf",
    ]
    assert values(spark, names, T.author_segment) == ["A. Axelsen", "A. D. Doyle", "Ann Petch", "A CASE STUDY"]
    assert values(spark, ["1980_AnnPetch_x.pdf", "Ann_x.pdf"], T.author_strict) == ["Ann Petch", None]


@pytest.mark.parametrize(
    ("strategy", "page", "title"),
    [
        ("colon", "15\n\nFIELD APPLICATION OF VULPIA:\nA CASE STUDY", "FIELD APPLICATION OF VULPIA: A CASE STUDY"),
        ("continuation", "OFFICIAL\nSoil water:\na review -\nof data", "Soil water: a review - of data"),
        ("continuation", "Wheat growth in\ndry areas", "Wheat growth in dry areas"),
        ("continuation", "Wheat growth in\nJohn Smith1, CSIRO", "Wheat growth in"),
        ("continuation", "Wheat growth in\nyears since 1990", "Wheat growth in"),
        ("continuation", "iv\n12", None),
        ("first_line", "\n 15 \nx", "15"),
        ("first_text_line", "\n 15 \nx", "x"),
    ],
)
def test_titles(spark, strategy, page, title):
    assert values(spark, [page], lambda x: T.title_of(x, strategy)) == [title]


def test_affiliation(spark):
    long = " ".join("w" * 13)
    pages = ["T\n\na\nb\nc\nd\ne", f"T\n{long}\nb", "x\nT", "T\n\n\n", f"T\na\n{long}"]
    assert values(spark, pages, lambda x: T.affiliation(x, F.lit("T"))) == ["a; b; c; d", "", None, None, "a"]


def test_jaro(spark):
    assert round(jaro("martha", "marhta"), 4) == 0.9444
    assert round(jaro("dixon", "dicksonx"), 3) == 0.767
    rows = spark.createDataFrame([("", ""), ("a", ""), (None, "a")], "a string, b string").coalesce(1)
    assert [r[0] for r in rows.select(jaro_column(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


def test_porter(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "operator": "oper",
        "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv",
        "adoption": "adopt", "replacement": "replac", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
        "cropping": "crop", "rates": "rate", "by": "by", "naïve": "naïve",
    }
    out = stemmed(spark.createDataFrame([(w,) for w in known], "word string")).collect()
    assert {r["word"]: r["stem"] for r in out} == known


def test_titles_of_long_pages_read_the_first_lines(spark):
    import random
    import time

    import duckdb

    from quire.functions.text import squish
    from quire.functions.titles import title_of
    from quire.plans import oracle

    r = random.Random(7)
    some = ["Draft", "12", " ", "", "x  y ", "iv", "www.a.b", "drafty", "A title:", "A title -", "more.", "An University", "Jane Doe, x", "J. D. x", "“q” ™\t\r z", "gov.au", "govxau", "-", "a" * 300]
    pages = ["\n".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "\n" * 40 + "late title:\nits end"]
    pages += ["\n".join(["draft"] * 9 + ["a title"])]
    have = spark.createDataFrame([(p,) for p in pages], "text string").coalesce(1).select("text", title_of(F.col("text")), squish(F.col("text"))).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE d (n INT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", list(enumerate(pages)))
    want = con.execute(f"WITH a AS (SELECT n, text, {oracle.USABLE} AS l FROM d) SELECT text, {oracle.CONTINUED}, {oracle.squish('text')} FROM a ORDER BY n").fetchall()
    assert list(map(tuple, have)) == want
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("some words of a line, "), i.cast("string"))), "\n")
    long = spark.range(20000).select(F.concat(F.col("id").cast("string"), F.lit(" is a title.\n"), lines).alias("text")).localCheckpoint()
    began = time.perf_counter()
    assert long.select(title_of(F.col("text")).alias("t")).agg(F.count("t"), F.max(F.length("t"))).first()[0] == 20000
    assert time.perf_counter() - began < 4  # all lines took five times as long and more
