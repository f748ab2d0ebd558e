"""Corpus, tokens, stems and term frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.porter import stemmed
from quire.functions.stopwords import CUSTOM, ENGLISH
from quire.functions.text import or_na

#: Letters, digits and underscores, joined by inner apostrophes and stops, and numbers by commas.
TOKEN = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+|,\p{N}+)*"
#: The same without steps back, which none of its parts needs: faster where the engine knows it.
TOKEN_ONCE = r"[\p{L}\p{N}_]++(?:['’.][\p{L}\p{N}_]++|,\p{N}++)*+"
LETTERS = "^[a-z]+$"
STOPS = tuple(sorted({*ENGLISH, *CUSTOM}))


def build_corpus(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, year, title, first_author, filepath, text); text is null where the pages are."""
    texts = pages.select(F.col("path").alias("path_original"), F.array_join("pages", " ").alias("text"))
    return index.join(texts, "path_original", "left").select("id", "year", "title", "first_author", F.col("path_original").alias("filepath"), "text")


def tokens(corpus: DataFrame) -> DataFrame:
    """(id, year, pos, word): lower-case words in turn; a null text has none."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_ONCE), F.lit(0))
    return corpus.select("id", "year", F.posexplode(found).alias("pos", "word"))


def letters_only(words: DataFrame) -> DataFrame:
    return words.filter(F.col("word").rlike(LETTERS))


def without_stops(words: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Built-in stops are a set inside the expression; a table of stops is an anti join."""
    if stops is None:
        return words.filter(~F.col("word").isin(*STOPS))
    return words.join(stops.select("word").distinct(), "word", "left_anti")


def with_stems(words: DataFrame) -> DataFrame:
    """words with `stem`: the vocabulary is stemmed once and joined back."""
    stems = stemmed(words.select("word").distinct())
    return words.join(stems, "word")


def tokenize(corpus: DataFrame, stops: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """(id, year, word)."""
    kept = without_stops(letters_only(tokens(corpus)), stops)
    if stem:
        kept = with_stems(kept).withColumn("word", F.col("stem"))
    return kept.select("id", "year", "word")


def token_funnel(corpus: DataFrame) -> DataFrame:
    """(stage, n): tokens, those of letters, those that are no stop words, and their distinct words."""
    words = tokens(corpus).groupBy("word").count()
    letters, stop = F.col("word").rlike(LETTERS), F.col("word").isin(*STOPS)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("bigint")

    sums = words.agg(
        total(F.lit(True)).alias("raw"), total(letters).alias("letters"), total(letters & ~stop).alias("kept"), F.count_if(letters & ~stop).alias("vocabulary")
    )
    return sums.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in ("raw", "letters", "kept", "vocabulary")])))


def word_counts(corpus: DataFrame, stem: bool = True, stops: DataFrame | None = None) -> DataFrame:
    """(year, word, n).  Words are counted before they are stemmed, each word once with its years: the
    texts are read once, nothing is joined."""
    counts = without_stops(letters_only(tokens(corpus).select("year", "word")), stops).groupBy("year", "word").agg(F.count("*").alias("n"))
    if not stem:
        return counts
    by_word = counts.groupBy("word").agg(F.collect_list(F.struct("year", "n")).alias("years"))
    return stemmed(by_word).select("stem", F.inline("years")).groupBy("year", F.col("stem").alias("word")).agg(F.sum("n").alias("n"))


def top_terms(counts: DataFrame, k: int = 10, ties: bool = True, themes: DataFrame | None = None) -> DataFrame:
    """The k most frequent words of each year, ties kept; themes are joined on the left."""
    order = W.partitionBy("year").orderBy(F.desc("n"), *([] if ties else [F.asc("word")]))
    rank = F.rank() if ties else F.row_number()
    top = counts.withColumn("_r", rank.over(order)).filter(F.col("_r") <= k).drop("_r")
    return top if themes is None else top.join(themes, "year", "left")


def top_terms_global(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent words over all, ties kept.  Each task keeps its own k and ties before the one
    that ranks them all."""
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return totals.withColumn("_r", F.rank().over(W.orderBy(F.desc("n")))).filter(F.col("_r") <= k).select("word", "n")


def facet_label(year: Column, theme: Column) -> Column:
    return F.concat(or_na(year), F.lit("\n"), or_na(theme))


def plot_frame(top: DataFrame) -> DataFrame:
    """(year, facet_label, word, n, order_in_facet) of top terms with themes."""
    order = W.partitionBy("year").orderBy("n", "word")
    return top.select("year", facet_label(F.col("year"), F.col("theme")).alias("facet_label"), "word", "n", F.row_number().over(order).alias("order_in_facet"))


def svg_bars(frame, width: int = 420, bar: int = 16) -> str:
    """Bars of a collected plot frame (year, facet_label, word, n, order_in_facet) as SVG text."""
    from html import escape

    parts, top = [], 0
    for label, rows in sorted({r["facet_label"]: [x for x in frame if x["facet_label"] == r["facet_label"]] for r in frame}.items()):
        most = max(r["n"] for r in rows)
        parts.append(f'<text x="0" y="{top + 12}">{escape(label)}</text>')
        for i, r in enumerate(sorted(rows, key=lambda x: -x["order_in_facet"])):
            y = top + 18 + i * bar
            parts.append(f'<rect x="120" y="{y}" width="{280 * r["n"] / most:.1f}" height="{bar - 3}"/><text x="0" y="{y + 11}">{escape(r["word"])}</text>')
        top += 30 + len(rows) * bar
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{top}" font-size="11">{"".join(parts)}</svg>'


def stem_examples(words: DataFrame, k: int = 20) -> DataFrame:
    """(stem, n, examples) of (id, pos, word): up to three words by first appearance, padded with NA up to
    the number of rows.  Words are reduced to their first place before they are stemmed and listed."""
    per_word = stemmed(words.groupBy("word").agg(F.count("*").alias("c"), F.min(F.struct("id", "pos")).alias("at")))
    nth = F.row_number().over(W.partitionBy("stem").orderBy("at"))
    first = per_word.withColumn("_r", nth)
    out = first.groupBy("stem").agg(
        F.sum("c").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", "word")))).alias("w")
    )
    names = F.concat(F.transform("w", lambda x: x["word"]), F.array_repeat(F.lit("NA"), 3))
    return out.select("stem", "n", F.array_join(F.slice(names, F.lit(1), F.least(F.lit(3), F.col("n")).cast("int")), ", ").alias("examples")).orderBy(F.desc("n"), "stem").limit(k)
