"""The paper index: metadata, ids, corrections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.functions.text import DIGIT, changed_to, numbered_id, path_file, word_count, year_of
from quire.functions.titles import AUTHORS, affiliation, placeholder_title, title_of

INDEX = ("id", "year", "filename_original", "title", "page_count", "word_count", "first_author", "path_original")


#: Leading characters of a file name that divide a year's papers.
PREFIX = 12


def assign_ids(papers: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Adds id, <year>_<number by file name and path within the year>.  Papers are numbered within their
    year and the first characters of their name; a prefix starts behind the papers of the lesser ones,
    of which there is one row each, so no year is gathered in one task."""
    cut = F.substring("filename_original", 1, prefix)
    own = W.partitionBy("year", "_cut").orderBy(F.asc_nulls_last("filename_original"), F.asc_nulls_last("path_original"))
    before = W.partitionBy("_year").orderBy(F.asc_nulls_last("_prefix")).rowsBetween(W.unboundedPreceding, -1)
    counts = papers.groupBy(F.col("year").alias("_year"), cut.alias("_prefix")).agg(F.count("*").alias("_n"))
    starts = counts.select("_year", "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = papers.withColumn("_cut", cut).withColumn("_own", F.row_number().over(own))
    joined = ranked.join(starts, F.col("year").eqNullSafe(F.col("_year")) & F.col("_cut").eqNullSafe(F.col("_prefix")))
    return joined.withColumn("id", numbered_id(F.col("year"), F.col("_before") + F.col("_own"))).drop("_cut", "_own", "_year", "_prefix", "_before")


def metadata(pages: DataFrame, title: str = "continuation", author: str = "segment", strict: bool = False) -> DataFrame:
    """The index without ids from (path, pages); narrow.  strict: without a title the counts are null too."""
    page = F.get("pages", F.lit(0))
    rows = pages.select(
        year_of(F.col("path")).alias("year"),
        path_file(F.col("path")).alias("filename_original"),
        title_of(page, title).alias("title"),
        F.when(F.col("pages").isNotNull(), F.size("pages")).alias("page_count"),
        word_count(F.array_join("pages", " ")).cast("int").alias("word_count"),
        AUTHORS[author](path_file(F.col("path"))).alias("first_author"),
        F.col("path").alias("path_original"),
    )
    if strict:
        rows = rows.withColumns({c: F.when(F.col("title").isNotNull(), F.col(c)) for c in ("page_count", "word_count")})
    return rows


def build_index(pages: DataFrame, title: str = "continuation", author: str = "segment", strict: bool = False) -> DataFrame:
    return assign_ids(metadata(pages, title, author, strict)).select(*INDEX)


def affiliation_index(pages: DataFrame, title: str = "first_text_line", author: str = "strict_year_prefix") -> DataFrame:
    """The index variant with the affiliation block behind the title."""
    page = F.get("pages", F.lit(0))
    block = pages.select(F.col("path").alias("path_original"), affiliation(page, title_of(page, title)).alias("affiliation_raw"))
    return (
        build_index(pages, title, author)
        .join(block, "path_original")
        .select("id", "year", "filename_original", "title", "affiliation_raw", "page_count", "word_count", F.col("first_author").alias("authors"), "path_original")
    )


def failed_titles(index: DataFrame) -> DataFrame:
    return index.filter(F.col("title").isNull())


def with_placeholders(index: DataFrame) -> DataFrame:
    return index.withColumn("title", F.coalesce("title", placeholder_title(F.col("filename_original"))))


def rows_update(target: DataFrame, updates: DataFrame, key: str = "id", unmatched: str = "ignore", skip_null: bool = False) -> DataFrame:
    """target with the columns of updates set where the key matches, nulls included, unless skip_null.
    Repeated keys in updates (of a column's values, with skip_null), and with unmatched='error' keys that
    target lacks, fail when the result is computed.  One join for all columns."""
    columns = [c for c in updates.columns if c != key]
    if skip_null:
        updates = updates.filter(" OR ".join(f"`{c}` IS NOT NULL" for c in columns))
    times = F.greatest(*[F.count(c) for c in columns], F.lit(0)) if skip_null else F.count("*")
    new = updates.groupBy(F.col(key).alias("_key")).agg(times.alias("_n"), *[F.first(c, ignorenulls=skip_null).alias(f"_new_{c}") for c in columns])
    new = new.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated update key "), F.col("_key"))).cast("bigint")).otherwise(F.col("_n")))
    kind = "full" if unmatched == "error" else "left"
    joined = target.withColumn("_here", F.lit(True)).join(new, F.col(key) == F.col("_key"), kind)
    if unmatched == "error":
        missing = F.raise_error(F.concat(F.lit("update key not in target: "), F.coalesce("_key", F.lit("NA"))))
        joined = joined.filter(F.when(F.col("_here").isNull(), missing.cast("boolean")).otherwise(F.lit(True)))

    def updated(c: str):
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if skip_null else F.col(f"_new_{c}")
        return F.when(F.col("_n") > 0, value).otherwise(F.col(c)).alias(c)

    return joined.select(*[updated(c) if c in columns else F.col(c) for c in target.columns])


def apply_fixes(index: DataFrame, fixes: DataFrame, mode: str = "skip_blank", unmatched: str = "ignore") -> DataFrame:
    """Manual fixes (ID, first_author_new, title_actual).  overwrite sets both columns blindly;
    skip_blank leaves what a fix has blank or as `no change`."""
    skip = mode != "overwrite"
    value = changed_to if skip else (lambda c: c)
    fixed = fixes.select(F.col("ID").alias("id"), value(F.col("first_author_new")).alias("first_author"), value(F.col("title_actual")).alias("title"))
    return rows_update(index, fixed, "id", unmatched, skip_null=skip)


def preview(df: DataFrame, n: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows, in an order if one is given."""
    return (df.orderBy(*[F.asc_nulls_last(c) for c in order]) if order else df).limit(n)


def null_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in index.columns])


def years_covered(index: DataFrame) -> DataFrame:
    return index.agg(F.array_join(F.array_sort(F.collect_set("year")).cast("array<string>"), ", ").alias("years"))


def index_from_flat(files: DataFrame) -> DataFrame:
    """(id, year, paper_num, filename_new) from names in a flat folder; paper_num is the last four digits."""
    return files.select(
        "id",
        F.regexp_substr("id", F.lit(f"^{DIGIT}{{4}}")).try_cast("int").alias("year"),
        F.regexp_substr("id", F.lit(f"{DIGIT}{{4}}$")).try_cast("int").alias("paper_num"),
        F.col("filename").alias("filename_new"),
    )


def copy_plan(index: DataFrame, folder: str) -> DataFrame:
    return index.select("path_original", F.concat(F.lit(f"{folder}/"), "id", F.lit(".pdf")).alias("path_new"))
