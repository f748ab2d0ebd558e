"""Duplicate papers: candidate pairs, similarity tiers, expansion and resolution.

Candidates are blocked on equal word counts by an equi-join, with the length bound of the Jaro
similarity as a residual condition, so that most pairs never reach Python.  A block of more than
BLOCK_ROWS papers is dealt over several tasks: one side by a salt, the other to every salt.  Without
blocking, all pairs that the tier's length bound allows meet by classes of title length.  A null word
count, author or title pairs with nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.similarity import jaro_column, length_bound, rounded
from quire.functions.text import normalised
from quire.operators.similar import SLACK, similar


@dataclass(frozen=True)
class Tier:
    name: str
    author: float
    title: float


DEFAULT = Tier("default", 0.85, 0.85)
STRICT = Tier("strict", 0.90, 0.90)
MODERATE = Tier("moderate", 0.70, 0.70)


def _sides(index: DataFrame, author_col: str, title_col: str) -> DataFrame:
    return index.select("id", "word_count", normalised(F.col(author_col)).alias("au"), normalised(F.col(title_col)).alias("ti"))


#: Papers of a block in one task.
BLOCK_ROWS = 4096


def candidate_pairs(index: DataFrame, block_on: str | None = "word_count", tier: Tier | None = None, author_col: str = "first_author", title_col: str = "title") -> DataFrame:
    """(id_a, id_b, word_count_a, au_a, au_b, ti_a, ti_b), id_a < id_b.  Without block_on a tier is
    needed; its pairs are quadratic in the papers, as the semantics ask."""
    if not block_on and not tier:
        raise ValueError("all pairs need a tier")
    sides = _sides(index, author_col, title_col)
    if block_on:
        sides = sides.withColumn("block", F.col(block_on))
        other = sides
    else:
        # titles of similar papers differ in length by a factor of at most 1 / least: one class apart
        least = max(3 * (tier.title - 0.0006) - 2, 0.05)
        sides = sides.withColumn("block", F.floor(F.log(F.greatest(F.length("ti"), F.lit(1)).cast("double")) / -math.log(least)).cast("int"))
        other = sides.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    salts = sides.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("salts")).filter("salts > 1")
    names = ("id", "word_count", "au", "ti", "block")

    def side(rows: DataFrame, x: str, salt) -> DataFrame:
        dealt = rows.join(salts, "block", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        return dealt.select(*[F.col(c).alias(f"{c}_{x}") for c in names], salt.alias(f"salt_{x}"))

    a = side(sides, "a", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    b = side(other, "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    on = (F.col("block_a") == F.col("block_b")) & (F.col("salt_a") == F.col("salt_b")) & (F.col("id_a") < F.col("id_b"))
    if tier:
        on &= length_bound(F.col("au_a"), F.col("au_b"), tier.author) & length_bound(F.col("ti_a"), F.col("ti_b"), tier.title)
    return a.join(b, on).select("id_a", "id_b", "word_count_a", "au_a", "au_b", "ti_a", "ti_b")


def pair_count(index: DataFrame) -> DataFrame:
    """(n, pairs, shown): papers, their pairs, and the pairs with thousands separators."""
    n = F.col("n")
    return index.agg(F.count("*").alias("n")).select("n", F.expr("n * (n - 1) div 2").alias("pairs"), F.format_number((n * (n - 1) / 2).cast("decimal(38,0)"), 0).alias("shown"))


def scored(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "id_a",
        "id_b",
        rounded(jaro_column(F.col("au_a"), F.col("au_b"))).alias("author_sim"),
        rounded(jaro_column(F.col("ti_a"), F.col("ti_b"))).alias("title_sim"),
        "word_count_a",
    )


def similar_pairs(index: DataFrame, block_on: str | None = "word_count", tier: Tier | None = None, author_col: str = "first_author", title_col: str = "title", tile_rows: int | None = None) -> DataFrame:
    """scored(candidate_pairs()), compared by tiles of a block; with a tier a few pairs below it stay in."""
    if not block_on and not tier:
        raise ValueError("all pairs need a tier")
    rows = _sides(index, author_col, title_col).filter("id IS NOT NULL")
    if tier:
        rows = rows.filter("au IS NOT NULL AND ti IS NOT NULL")
    if block_on:
        rows = rows.select(F.col(block_on).alias("block"), F.lit(True).alias("own"), *rows.columns).filter("block IS NOT NULL")
    else:
        # titles of similar papers differ in length by a factor of at most 1 / least: one class apart; where
        # the factor is large, nearly all papers are in two classes, so there is one
        least = 3 * (tier.title - SLACK) - 2
        classes = F.floor(F.log(F.greatest(F.length("ti"), F.lit(1)).cast("double")) / -math.log(least)).cast("int") if least > 0.4 else F.lit(0)
        both = [F.struct(classes.alias("block"), F.lit(True).alias("own")), F.struct((classes + 1).alias("block"), F.lit(False).alias("own"))]
        rows = rows.select(F.inline(F.array(*both[: 2 if least > 0.4 else 1])), *rows.columns)
    found = similar(rows, tier and tier.author, tier and tier.title, tile_rows)
    return found.withColumns({c: rounded(F.col(c)) for c in ("author_sim", "title_sim")})


def duplicate_pairs(index: DataFrame, tier: Tier = DEFAULT, block_on: str | None = "word_count") -> DataFrame:
    """Pairs whose rounded similarities both reach the tier."""
    pairs = similar_pairs(index, block_on, tier)
    return pairs.filter((F.col("author_sim") >= tier.author) & (F.col("title_sim") >= tier.title))


def expand_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Two rows per pair, each with its paper's metadata."""
    sides = [
        pairs.select(F.col(f"id_{x}").alias("id"), F.col(f"id_{y}").alias("matched_id"), "author_sim", "title_sim") for x, y in ("ab", "ba")
    ]
    return sides[0].unionByName(sides[1]).join(index, "id", "left")


def ordered(duplicates: DataFrame) -> DataFrame:
    return duplicates.orderBy(F.desc_nulls_last("author_sim"), F.desc_nulls_last("title_sim"), F.asc_nulls_last("id"), F.asc_nulls_last("matched_id"))


def exact_title_duplicates(index: DataFrame) -> DataFrame:
    """Papers whose title another paper has too; null titles are one group.  Titles are counted
    before the join, so a frequent one is no hot window."""
    many = index.groupBy(F.col("title").alias("_t")).count().filter("count > 1").select("_t")
    return index.join(many, F.col("title").eqNullSafe(F.col("_t")), "left_semi")


def example_titles(index: DataFrame, k: int = 3, order: tuple[str, ...] = ("year", "filename_original", "path_original")) -> DataFrame:
    """The papers of the first k titles, by first appearance, that several papers have, by title and year."""
    dups = exact_title_duplicates(index)
    at = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    first = dups.groupBy(F.col("title").alias("_t")).agg(F.min(at).alias("_at")).orderBy("_at").limit(k).select("_t")
    return index.join(F.broadcast(first), F.col("title").eqNullSafe(F.col("_t")), "left_semi").orderBy(F.asc_nulls_last("title"), F.asc_nulls_last("year"))  # k rows


def canonical_pairs(duplicates: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b) with id_a < id_b; a pair with a null stays out."""
    both = duplicates.filter(F.col("id").isNotNull() & F.col("matched_id").isNotNull())
    return both.select(F.least("id", "matched_id").alias("id_a"), F.greatest("id", "matched_id").alias("id_b")).distinct()


def resolved_pairs(duplicates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, keep_id, drop_id).  The lower id stays; an override names another.  A keep_id that
    is neither of the pair drops id_a, a null one drops nothing; unknown pairs are ignored."""
    pairs = canonical_pairs(duplicates)
    if overrides is None:
        return pairs.select("id_a", "id_b", F.col("id_a").alias("keep_id"), F.col("id_b").alias("drop_id"))
    own = overrides.select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.struct("keep_id").alias("o")
    ).dropDuplicates(["id_a", "id_b"])
    keep = F.when(F.col("o").isNull(), F.col("id_a")).otherwise(F.col("o.keep_id"))
    drop = F.when(keep.isNotNull(), F.when(keep == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a")))
    return pairs.join(own, ["id_a", "id_b"], "left").select("id_a", "id_b", keep.alias("keep_id"), drop.alias("drop_id"))


def resolve_duplicates(index: DataFrame, duplicates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """index without the dropped papers; no transitive closure."""
    gone = resolved_pairs(duplicates, overrides).select(F.col("drop_id").alias("id")).distinct()
    return index.join(gone, "id", "left_anti")
