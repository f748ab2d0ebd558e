"""The operators' queries over the supplied tables: documents stand for papers, one page each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import titles as T
from quire.functions.text import NWS, changed_to, normalised, or_na, path_file, path_parent, squish, transliterate, word_count, year_of
from quire.operators import dedupe, index, sampling, sync, wordfreq
from quire.schemas import PAPER_INDEX
from quire.sources import papers as io


#: Bytes up to which a table of few files is dealt out after the scan.
FEW_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  A small one in fewer files than there are cores may be one row group, which one task
    reads: it is dealt out; the size that allows it is checked, so a large table is never shuffled here."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= FEW_BYTES and len(df.inputFiles()) < cores else df


def paper_pages(docs: DataFrame) -> DataFrame:
    """(path, pages, doc_id): year from the source, author from the second line."""
    year = (F.lit(1980) + F.expr("substr(source, 4)").try_cast("int")).cast("string")
    second = F.get(F.split("text", "\n", -1), F.lit(1))
    author = F.coalesce(F.regexp_replace(F.regexp_substr(second, F.lit(NWS + "+")), "[/_]", ""), F.lit(""))
    path = F.concat(F.lit("/root/"), or_na(year), F.lit("/"), or_na(year), F.lit("_"), author, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return docs.select(path.alias("path"), F.when(F.col("text").isNotNull(), F.array("text")).alias("pages"), "doc_id")


def pages(s: SparkSession, d: str) -> DataFrame:
    return paper_pages(table(s, d, "documents"))


def built(s: SparkSession, d: str) -> DataFrame:
    return index.build_index(pages(s, d))


def stored(s: SparkSession, d: str) -> DataFrame:
    """The index, written once for a query that reads it several times."""
    return io.save(built(s, d), io.shared_path(s, "index"))


def corpus(s: SparkSession, d: str) -> DataFrame:
    """The corpus without a join: ids are not needed for counts by year."""
    return pages(s, d).select(F.col("doc_id").alias("id"), year_of(F.col("path")).alias("year"), F.array_join("pages", " ").alias("text"))


def fixes(s: SparkSession, d: str, idx: DataFrame | None = None) -> DataFrame:
    """labels as manual fixes: quality 0 gives a title, toxic 1 says no change."""
    own = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    named = (built(s, d) if idx is None else idx).withColumn("doc_id", F.regexp_extract("filename_original", r"_([0-9]+)\.pdf$", 1).cast("bigint")).select("id", "doc_id")
    return named.join(own, "doc_id").select(
        F.col("id").alias("ID"),
        F.when(F.col("t") == 1, " No Change ").alias("first_author_new"),
        F.when(F.col("q") == 0, F.concat(F.lit("FIX-"), F.col("doc_id").cast("string"))).alias("title_actual"),
    )


def pairs(s: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_pairs(stored(s, d))


def duplicates(idx: DataFrame) -> DataFrame:
    """Of a stored index; the pairs are stored too, as both sides read them."""
    found = io.save(dedupe.duplicate_pairs(idx), io.shared_path(idx.sparkSession, "pairs"))
    return dedupe.expand_pairs(found, idx)


def pages_split(s: SparkSession, d: str) -> DataFrame:
    """Papers of several pages: a page for every four lines."""
    lines = F.split("text", "\n", -1)
    count = F.ceil(F.size(lines) / 4).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(lines, i * 4 + 1, 4), "\n"))
    own = table(s, d, "documents").select(F.col("doc_id").alias("_id"), "text")
    return pages(s, d).join(own, F.col("doc_id") == F.col("_id")).select("path", F.when(F.col("text").isNotNull(), cut).alias("pages"), "doc_id")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    found = io.save(pages_split(s, d), io.shared_path(s, "pages"))
    built_ = wordfreq.build_corpus(index.build_index(found), found)
    return built_.join(found.select(F.col("path").alias("filepath"), F.size("pages").alias("page_count")), "filepath").select("id", "year", "title", "first_author", "filepath", F.md5("text").alias("text"), "page_count")


def _resolved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    idx = stored(s, d)
    return idx, dedupe.resolve_duplicates(idx, duplicates(idx))


def _flat_of(idx: DataFrame) -> DataFrame:
    return io.flat_files(idx.select(F.concat(F.lit("/root/papers_flat/"), "id", F.lit(".pdf")).alias("path")))


def overrides(dups: DataFrame) -> DataFrame:
    """Pairs whose second id is even keep the second."""
    own = dedupe.canonical_pairs(dups)
    return own.filter(F.substring("id_b", -1, 1).isin("0", "2", "4", "6", "8")).select("id_a", "id_b", F.col("id_b").alias("keep_id"))


def themes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "region").select((F.lit(1980) + F.col("r_regionkey")).cast("int").alias("year"), F.col("r_name").alias("theme"), F.lit(None).cast("string").alias("location"))


def flat(s: SparkSession, d: str) -> DataFrame:
    return _flat_of(built(s, d))


def _readable(s: SparkSession, d: str) -> DataFrame:
    """Lines whose vowels a, e, i are made replacement characters, by whether they stay readable."""
    lines = _text(s, d, line=lambda t: F.explode(T.lines_of(F.translate(t, "aei", "\ufffd\ufffd\ufffd"))))
    return lines.groupBy(T.readable(F.col("line")).alias("readable")).agg(F.count("*").alias("n"))


def _text(s: SparkSession, d: str, **columns) -> DataFrame:
    return table(s, d, "documents").select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


def _title(f) -> Callable:
    return lambda s, d: _text(s, d, title=lambda t: F.nullif(f(t), F.lit("")))


def _name(f) -> Callable:
    return lambda s, d: pages(s, d).select("doc_id", f(path_file(F.col("path"))).alias("value"))


def _affiliation(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d, affiliation_raw=lambda t: T.affiliation(t, T.title_of(t, "first_text_line")))


def _boilerplate(s: SparkSession, d: str) -> DataFrame:
    lines = _text(s, d, line=lambda t: F.explode(T.lines_of(t)))
    return lines.select(
        F.col("line"), T.is_boilerplate(F.col("line")).alias("boilerplate"), T.is_author_or_institution(F.col("line")).alias("author")
    ).groupBy("boilerplate", "author").agg(F.count("*").alias("n"))


def _jaro(s: SparkSession, d: str) -> DataFrame:
    return dedupe.similar_pairs(stored(s, d))


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = io.shared_path(s, "csv")
    io.write_csv(built(s, d), path)
    return io.read_csv(s, path, PAPER_INDEX)


def _pick(words: DataFrame) -> DataFrame:
    return words.groupBy("year").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_distinct"))


def _facets(s: SparkSession, d: str) -> DataFrame:
    years = built(s, d).select("year").distinct()
    return years.join(themes(s, d), "year", "left").select("year", wordfreq.facet_label(F.col("year"), F.col("theme")).alias("label"))


def _counts(s: SparkSession, d: str, stem: bool = True) -> DataFrame:
    return wordfreq.word_counts(corpus(s, d), stem)


def _letters(s: SparkSession, d: str) -> DataFrame:
    return wordfreq.letters_only(wordfreq.tokens(corpus(s, d)))


def _path(s: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return pages(s, d).select("doc_id", year_of(p).alias("year"), path_parent(p).alias("parent"), path_file(p).alias("file"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def titles(s: SparkSession, d: str) -> DataFrame:
        return dedupe.exact_title_duplicates(stored(s, d)).select("id", "year", "title")

    return {
        "word_count": lambda s, d: _text(s, d, n=word_count),
        "squish_normalise": lambda s, d: _text(s, d, squished=lambda t: F.md5(squish(t)), normal=lambda t: F.md5(normalised(t))),
        "transliterate": lambda s, d: _text(s, d, plain=lambda t: F.md5(transliterate(t))),
        "path_parse": _path,
        "author_segment": _name(T.author_segment),
        "author_camel": _name(T.author_segment_camel),
        "author_strict": _name(T.author_strict),
        "author_all_but_last": _name(T.author_all_but_last),
        "title_first_line": _title(T.first_line),
        "title_first_text_line": _title(T.first_text_line),
        "title_colon": _title(T.colon),
        "title_continuation": _title(T.continuation),
        "title_filename_fallback": _name(T.filename_title),
        "title_placeholder": _name(T.placeholder_title),
        "affiliation_block": _affiliation,
        "boilerplate_filter": _boilerplate,
        "assign_ids": built,
        "failed_titles": lambda s, d: index.failed_titles(built(s, d)).select("id", "year", "filename_original"),
        "rows_update_overwrite": lambda s, d: index.apply_fixes(i := stored(s, d), fixes(s, d, i), "overwrite").select("id", "title", "first_author"),
        "rows_update_skip_blank": lambda s, d: index.apply_fixes(i := stored(s, d), fixes(s, d, i), "skip_blank").select("id", "title", "first_author"),
        "changed_to": lambda s, d: fixes(s, d).select("ID", changed_to(F.col("first_author_new")).alias("author"), changed_to(F.col("title_actual")).alias("title")),
        "exact_title_duplicates": titles,
        "candidate_pairs": lambda s, d: dedupe.candidate_pairs(stored(s, d)).select("id_a", "id_b", "word_count_a"),
        "jaro_scores": _jaro,
        "duplicate_pairs": pairs,
        "duplicate_pairs_strict": lambda s, d: dedupe.duplicate_pairs(stored(s, d), dedupe.STRICT),
        "duplicate_pairs_moderate": lambda s, d: dedupe.duplicate_pairs(stored(s, d), dedupe.MODERATE),
        "expand_duplicates": lambda s, d: dedupe.ordered(duplicates(stored(s, d))),
        "duplicate_pairs_strict_all": lambda s, d: dedupe.duplicate_pairs(stored(s, d), dedupe.STRICT, None),
        "duplicate_pairs_moderate_all": lambda s, d: dedupe.duplicate_pairs(stored(s, d), dedupe.MODERATE, None),
        "pair_count": lambda s, d: dedupe.pair_count(built(s, d)),
        "example_titles": lambda s, d: dedupe.example_titles(stored(s, d)).select("id", "year", "title"),
        "preview": lambda s, d: index.preview(built(s, d), 20, ("id",)),
        "readable_lines": _readable,
        "build_corpus": _corpus,
        "canonical_pairs": lambda s, d: dedupe.canonical_pairs(duplicates(stored(s, d))),
        "resolve_default": lambda s, d: _resolved(s, d)[1].select("id"),
        "resolve_override": lambda s, d: dedupe.resolved_pairs(dups := duplicates(stored(s, d)), overrides(dups)),
        "sync_plan": lambda s, d: sync.sync_plan(_flat_of((r := _resolved(s, d))[0]), r[1]),
        "sync_check": lambda s, d: sync.sync_check(_flat_of((r := _resolved(s, d))[0]), r[1]),
        "copy_plan": lambda s, d: index.copy_plan(built(s, d), "/root/papers_flat"),
        "tokens": lambda s, d: _pick(wordfreq.tokens(corpus(s, d))),
        "tokens_letters": lambda s, d: _pick(_letters(s, d)),
        "tokens_nostop": lambda s, d: _pick(wordfreq.without_stops(_letters(s, d))),
        "tokens_stemmed": lambda s, d: _pick(wordfreq.tokenize(corpus(s, d))),
        "token_funnel": lambda s, d: wordfreq.token_funnel(corpus(s, d)),
        "word_counts": lambda s, d: _counts(s, d, False),
        "stem_counts": _counts,
        "top_terms_ties": lambda s, d: wordfreq.top_terms(_counts(s, d)),
        "top_terms_surface": lambda s, d: wordfreq.top_terms(_counts(s, d, False)),
        "top_terms_global": lambda s, d: wordfreq.top_terms_global(_counts(s, d)),
        "top_terms_themes": lambda s, d: wordfreq.top_terms(_counts(s, d), themes=themes(s, d)),
        "facet_labels": _facets,
        "plot_frame": lambda s, d: wordfreq.plot_frame(wordfreq.top_terms(_counts(s, d), themes=themes(s, d))),
        "stem_examples": lambda s, d: wordfreq.stem_examples(wordfreq.without_stops(_letters(s, d))),
        "first_k_per_year": lambda s, d: sampling.first_k_per_group(built(s, d), 8).select("id", "year"),
        "sample_k_per_year": lambda s, d: sampling.sample_k_per_group(built(s, d), 5).select("id", "year"),
        "years_covered": lambda s, d: index.years_covered(built(s, d)),
        "null_counts": lambda s, d: index.null_counts(built(s, d)),
        "flat_reindex": lambda s, d: index.index_from_flat(flat(s, d)),
        "csv_roundtrip": _csv,
    }
