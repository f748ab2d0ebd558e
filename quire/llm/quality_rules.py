"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per
failed rule.  It is stored, without the texts.  A policy is a version name and a mask of the bits that
reject; policies and ablations read the stored bits alone.  The pipeline's stage applies its policy
beside each row instead: joining a stored ledger back would shuffle every text.

Defined cases: null text counts as no words, so every measurement is 0 and the word-count rule
fails; repeated rows get a ledger row each; other columns of the input, whatever their names,
are not read.  Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, staged, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


@dataclass(frozen=True)
class Rule:
    name: str
    #: Condition of failure, over the measurements.
    fails: str


#: The place in this list is the rule's bit; add rules at the end only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("capitals", "100 * n_upper > 60 * word_chars"),
    Rule("exclamations", "100 * n_marks > 30 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_trigrams"]
#: Versioned policies: the bits that reject a document.  A version never changes once used.
POLICIES = {
    "base": BASE,
    "2024-1": BASE | BIT["symbols"] | BIT["capitals"],
    "2024-2": (1 << len(RULES)) - 1,
}
CURRENT = "2024-2"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.  Windows are sorted by hash with
    their place, so the work is n log n also for very long texts."""

    def counted(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    def places(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, i: F.coalesce(x["h"] == F.get(sorted_windows, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(sorted_windows, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
                i.alias("p"),
            ),
        )

    def whole(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            let(F.sort_array(windows(w)), lambda s: let(places(s), counted)),
        ).otherwise(F.lit(0).cast("long"))

    return let(words, whole)


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the measurements, one scan, no shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = base.select("doc_id", "_t", words_of(F.col("_t")).alias("_w"))
    with_word = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(with_word).cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^!]+", "")).cast("long").alias("n_marks"),
    )


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the measurements and fail_bits: bit i set where RULES[i] fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return measured(docs, text, id_col).withColumn("fail_bits", bits)


def verdicts(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Applies a policy to the ledger: base_failed, kept and the policy's name."""
    return led.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(BASE | POLICIES[policy])) == 0,
            "policy": F.lit(policy),
        }
    )


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (they would return if
    it went), and documents kept with and without it.  One pass of bitwise sums over the ledger."""
    mask = POLICIES[policy]
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    used = [(r.name, BIT[r.name]) for r in RULES if BIT[r.name] & mask]
    sums = [F.count_if(bits == 0).alias("kept"), F.bit_or(bits).alias("seen_bits")]
    for name, b in used:
        sums += [F.count_if(bits.bitwiseAND(F.lit(b)) != 0).alias(f"f_{name}"), F.count_if(bits == b).alias(f"a_{name}")]
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"f_{name}").alias("failed"),
            F.col(f"a_{name}").alias("failed_alone"),
            F.col("kept").alias("kept_with"),
            (F.col("kept") + F.col(f"a_{name}")).alias("kept_without"),
        )
        for name, _ in used
    ]
    return led.agg(*sums).select(F.inline(F.array(*rows)))


def apply_policy(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with docs' own columns.  The verdict is computed
    beside each row, so no join is needed and clashing names can't arise."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    kept = verdicts(ledger(packed), policy).filter("kept")
    return kept.select(*[F.col("doc_id")[c].alias(c) for c in names])


def query(docs: DataFrame) -> DataFrame:
    return verdicts(staged(ledger(docs), "ledger")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
g3 AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM g),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM g3) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
m AS (
 SELECT d.r, doc_id, len(w) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_marks,
  coalesce(rep.n, 0) AS n_repeat_words
 FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
n AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
b AS (SELECT *,
  (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END)
  + (CASE WHEN 100 * n_marks > 30 * n_words THEN 64 ELSE 0 END) AS fail_bits FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
 CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""
