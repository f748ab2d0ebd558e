r"""Line dedup by winnowing over line hashes.

A text's lines (split at \n) are hashed.  A line weighs its words (up to WORDS), or WORDS for every
`chars` characters where that is more; blank lines weigh nothing.  The grams at a line are the fewest
lines from there on, and back from there, that weigh WORDS, however many blank lines lie between, and
the line with the next one that weighs something where blank lines part them.  A window is one gram:
as nearly every line is a gram by itself, none is left out, and every repeated run that weighs WORDS
has a repeated gram at each of its lines.  Grams meet at their first position, by doc_id, text hash
and line; the lines of all later ones are deleted.  A deleted line always has an equal earlier one,
so one copy of every line stays.  Lines that weigh less than WORDS and whose neighbours differ stay.

Each later position meets one first position, so matches grow with the grams; a frequent gram is
pre-aggregated, and its join's larger side can be split.

Defined cases: a null text has no lines and stays null; a row that occurs several times, with the
same doc_id and text, is one document, kept as often as it occurs; rows with one doc_id but
different texts are different documents, in the order of their text hashes; null doc_ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, staged

CHARS = 50
WORDS = 3
BLANK, TWO, THREE = r"^[\x20\x09-\x0D]*+$", r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]", r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]++){2}[^\x20\x09-\x0D]"


def _key(docs: DataFrame) -> dict[str, Column]:
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_th": F.xxhash64("text")}


def fingerprints(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """(_id, _th, fp, pos, n): every gram, with its first line and number of lines."""

    def weight(x: Column) -> Column:
        by_chars = F.char_length(x) * WORDS / F.lit(chars)
        return (
            F.when(x.rlike(THREE) | (F.char_length(x) >= chars), F.lit(WORDS))
            .when(x.rlike(BLANK), F.lit(0))
            .otherwise(F.greatest(F.when(x.rlike(TWO), F.lit(2)).otherwise(F.lit(1)), F.floor(by_chars).cast("int")))
        )

    def grams(hashes: Column, weights: Column, filled: Column) -> Column:
        def at(i: Column, k: Column) -> Column:
            own, ahead, behind = F.get(weights, i), F.get(filled, k + 1), F.get(filled, k - 1)
            both = own + F.get(weights, ahead)
            enough, enough_back = F.coalesce(both >= WORDS, F.lit(False)), F.coalesce(own + F.get(weights, behind) >= WORDS, F.lit(False))
            single = own >= WORDS
            last = F.when(single, i).when(enough, ahead).otherwise(F.get(filled, k + 2))
            first = F.when(single, F.lit(None)).when(enough_back, behind).otherwise(F.get(filled, k - 2))
            apart = F.when(enough & (ahead > i + 1), ahead)

            def gram(a: Column, b: Column) -> Column:
                n = b - a + 1
                h = F.xxhash64(F.slice(hashes, a + 1, n), n)
                return F.when(n.isNotNull(), F.struct(h.alias("fp"), a.cast("int").alias("pos"), n.cast("int").alias("n")))

            return F.filter(F.array(gram(i, last), gram(first, i), gram(i, apart)), lambda g: g.isNotNull())

        return F.array_distinct(F.flatten(F.transform(filled, at)))

    def of(lines: Column) -> Column:
        return let(
            F.transform(lines, lambda x: F.xxhash64(x)),
            lambda hashes: let(
                F.transform(lines, weight),
                lambda weights: let(
                    F.filter(F.sequence(F.lit(0), F.size(weights) - 1), lambda i: F.get(weights, i) > 0),
                    lambda filled: grams(hashes, weights, filled),
                ),
            ),
        )

    keyed = docs.select("text", *[c.alias(k) for k, c in _key(docs).items()]).filter(F.length("text") > 0)
    return keyed.select("_id", "_th", F.inline(let(F.split("text", "\n", -1), of)))


def later_runs(prints: DataFrame) -> DataFrame:
    """(_id, _th, first, last): lines to delete, by later position and its first position."""
    origin = (
        prints.groupBy("fp")
        .agg(F.min(F.struct("_id", "_th", "pos")).alias("o"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("fp", "o")
    )
    # stored, so that the join deals out both sides anew and a frequent fingerprint's can be split
    origin = staged(origin, "origins")
    later = (F.col("_id") != F.col("o._id")) | (F.col("_th") != F.col("o._th")) | (F.col("pos") != F.col("o.pos"))

    return prints.join(origin, "fp").filter(later).select("_id", "_th", F.col("pos").alias("first"), (F.col("pos") + F.col("n") - 1).alias("last"))


def deduped(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """docs' columns with `text` cleaned, and _deleted: the numbers of the lines that went (null for none)."""
    gone = (
        later_runs(fingerprints(docs, chars))
        .select("_id", "_th", F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy("_id", "_th")
        .agg(F.sort_array(F.collect_set("line")).alias("_deleted"))
    )
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_text"), *[c.alias(k) for k, c in _key(docs).items()])

    def cleaned(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_deleted"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_deleted").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n", -1), cleaned))
    return keyed.join(gone, ["_id", "_th"], "left").select(
        *[(text if c == "text" else F.col("_row")[c]).alias(c) for c in names], "_deleted"
    )


def apply(docs: DataFrame) -> DataFrame:
    """docs without later repeated runs.  n_chars follows the text where lines went; a document whose
    words all went is a copy of earlier lines and goes too."""
    out = deduped(docs)
    changed = F.col("_deleted").isNotNull()
    out = out.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("_deleted")


def query(docs: DataFrame) -> DataFrame:
    return deduped(docs.select("doc_id", "text")).select(
        "doc_id",
        F.coalesce(F.size("_deleted"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("_deleted", F.array().cast("array<int>")).alias("deleted_lines"),
        "text",
    )
