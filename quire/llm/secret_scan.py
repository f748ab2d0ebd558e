"""Secret scans by a trigram inverted index.

From each rule's regex, as parsed, a Boolean trigram query is derived: every match must hold one of
a set of strings for each stretch of the regex that has few, and a string's trigrams are an AND.  The
index holds, for each trigram and block of document ids, the posting list of that block; a rule's
postings are intersected and united within a block, and only the candidates are verified.  Rules
whose query says nothing scan every text.

Postings are cut into blocks of BLOCK ids, so a trigram that stands in every document is no hot
key.  Defined cases: null text is empty; rows with a null doc_id are in no posting list and are
scanned by every rule; rows with the same doc_id share its postings (a superset of each one's
candidates) and are verified one by one; offsets count code points.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let

BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length must reach `least`, else the match is dropped.
    group: int = 0
    least: int = 1


#: Fixed patterns of the base kinds, then the kinds the method adds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Most strings that a stretch of a regex may stand for, and most characters of a class among them.
STRINGS, CLASS = 64, 8
#: An AND of ORs of ANDs of trigrams; () says nothing.
Query = tuple[tuple[tuple[str, ...], ...], ...]


def trigrams(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(literal[i : i + 3] for i in range(len(literal) - 2)))


def _any(strings: set[str]) -> Query:
    """That one of the strings occurs."""
    clauses = {frozenset(trigrams(x)) for x in strings}
    least = [c for c in clauses if not any(o < c for o in clauses)]  # what a shorter clause says already is left out
    return (tuple(sorted(tuple(sorted(c)) for c in least)),) if all(least) else ()


def _either(queries: list[Query]) -> Query:
    """Of each alternative its narrowest part."""
    if not all(queries):
        return ()
    return (tuple(sorted({c for q in queries for c in max(q, key=lambda part: min(map(len, part)))})),)


def _class(items) -> set[str] | None:
    """Characters of a class in lower case; None for many."""
    found: set[str] = set()
    for kind, value in items:
        if kind == sre.LITERAL:
            found.add(chr(value).lower())
        elif kind == sre.RANGE and value[1] - value[0] < 2 * CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= CLASS and all(len(c) == 1 for c in found) else None


def _derived(parsed) -> tuple[set[str] | None, Query]:
    """(the strings that a regex stands for, in lower case, or None for many; what each match must hold)."""
    strings: set[str] = {""}
    query: list = []
    whole = True
    for kind, value in parsed:
        own, must = _node(kind, value)
        if own is not None and len(strings) * len(own) <= STRINGS:
            strings = {a + b for a in strings for b in own}
        else:
            whole = False
            query += [*_any(strings), *(must if own is None else _any(own))]
            strings = {""}
    query += _any(strings)
    return (strings if whole else None), tuple(dict.fromkeys(query))


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind == sre.LITERAL:
        return ({chr(value).lower()}, ()) if len(chr(value).lower()) == 1 else (None, ())
    if kind == sre.IN:
        return _class(value), ()
    if kind == sre.SUBPATTERN:
        return _derived(value[-1])
    if kind == sre.BRANCH:
        parts = [_derived(x) for x in value[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= STRINGS:
            return set().union(*(p[0] for p in parts)), ()
        return None, _either([p[1] for p in parts])
    if kind == sre.AT:
        return {""}, ()
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, item = value
        own, must = _derived(item)
        if own is not None and (least, most) == (0, 1):
            return own | {""}, ()
        if own is not None and least == most and len(own) ** least <= STRINGS:
            return {"".join(x) for x in itertools.product(own, repeat=least)}, ()
        return None, (must if least else ())
    return None, ()  # any other construct says nothing


@functools.cache
def trigram_query(rule: Rule) -> Query:
    """What every match of the rule's regex must hold, case aside; () if it must scan every text."""
    return _derived(_parser.parse(rule.pattern))[1]


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for part in trigram_query(r) for clause in part for g in clause})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(block, gram, ids): the posting lists of every trigram that some rule's query names."""
    grams = _grams(rules)
    # lower-casing is ASCII's: a match has ASCII letters only
    low = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.lower(F.col("text")).alias("_t")
    )
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("_t"), F.lit(g)), F.lit(g)) for g in grams]))
    return (
        low.select("doc_id", F.explode(present).alias("gram"))
        .groupBy(F.floor(F.col("doc_id") / BLOCK).alias("block"), "gram")
        .agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    )


def _tagged(ids: Column, bit: int) -> Column:
    return F.transform(ids, lambda d: F.struct(d.alias("doc_id"), F.lit(bit).alias("bit")))


def _named(spans: str, kind: int, name: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(name).alias("name"))
    )


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, mask): bit i set if the document is a candidate of rules[i]."""
    grams = _grams(rules)
    none = F.array().cast("array<bigint>")
    lists = index.groupBy("block").agg(
        *[F.coalesce(F.first(F.when(F.col("gram") == g, F.col("ids")), ignorenulls=True), none).alias(f"g{i}") for i, g in enumerate(grams)]
    )
    at = {g: F.col(f"g{i}") for i, g in enumerate(grams)}
    parts = []
    for bit, rule in enumerate(rules):
        clauses = [[functools.reduce(F.array_intersect, [at[g] for g in clause]) for clause in part] for part in trigram_query(rule)]
        if clauses:
            found = functools.reduce(F.array_intersect, [functools.reduce(F.array_union, part) for part in clauses])
            parts.append(_tagged(found, 1 << bit))
    return (
        lists.select(F.inline(F.concat(*parts)))
        .groupBy("doc_id")
        .agg(F.bit_or("bit").alias("mask"))
    )


def _sums(values: Column) -> Column:
    """Running sums of a short array: each step copies what it has."""
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def running(values: Column) -> Column:
    """Running sums of an int array, in blocks of about the root of its length, so that a text with very
    many matches takes n ** 1.5 steps at most."""
    width = F.ceil(F.sqrt(F.size(values))).cast("int")

    def joined(blocks: Column) -> Column:
        before = _sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(before, lambda s: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(s, i - 1), F.lit(0))))))

    cut = F.transform(F.sequence(F.lit(0), width - 1), lambda i: _sums(F.slice(values, i * width + 1, width)))
    return F.when(F.size(values) > 0, let(F.filter(cut, lambda b: F.size(b) > 0), joined)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,kind_no,end>> of a rule's matches: the pieces between matches give the offsets."""

    def placed(pieces: Column, found: Column, held: Column) -> Column:
        # match i ends behind the pieces 0..i and the matches 0..i
        steps = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)) + F.char_length(m))
        ends = let(steps, running)
        spans = let(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.char_length(m)).alias("start"), F.get(e, i).alias("end"))))
        return F.filter(spans, lambda x, i: F.char_length(F.get(held, i)) >= rule.least)

    pattern = F.lit(rule.pattern)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    body = let(
        F.split(text, rule.pattern, -1),
        lambda pieces: let(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda found: let(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda held: placed(pieces, found, held)),
        ),
    )
    return F.when(text.rlike(rule.pattern), body).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans array<struct<start,kind,name,end>> in order of start and kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(postings(rows, rules), rules)
    joined = rows.join(found, "doc_id", "left")
    known = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("mask", F.lit(0)))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    columns = []
    for bit, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule)
        if trigram_query(rule):
            spans = F.when(known.bitwiseAND(F.lit(1 << bit)) != 0, spans).otherwise(empty)
        columns.append(spans.alias(f"s{bit}"))
    apart = joined.select("doc_id", *columns)
    merged = F.concat(*[_named(f"s{b}", b, r.kind) for b, r in enumerate(rules)])
    return apart.select("doc_id", F.sort_array(merged).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def query(docs: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same by RE2: pieces between matches give the offsets; every text is scanned by every rule."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = []
    for k, r in enumerate(RULES):
        p = quoted(r.pattern)
        kinds.append(
            f"SELECT r, {k} AS k, {quoted(r.kind)} AS name, regexp_split_to_array(t, {p}) AS ps, regexp_extract_all(t, {p}, 0) AS ms, "
            f"regexp_extract_all(t, {p}, {r.group}) AS gs, {r.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
e AS (SELECT r, k, name, least, unnest(range(1, len(ms) + 1)) AS i, ps, ms, gs FROM m WHERE len(ms) > 0),
l AS (SELECT r, k, name, least, length(gs[i]) AS g, length(ms[i]) AS w,
  sum(length(ps[i]) + length(ms[i])) OVER (PARTITION BY r, k ORDER BY i) AS z FROM e),
f AS (SELECT r, k, name || ':' || CAST(z - w AS BIGINT) || ':' || CAST(z AS BIGINT) AS s, z - w AS a FROM l WHERE g >= least),
g AS (SELECT r, count(*) FILTER (k = 0) AS na, count(*) FILTER (k = 1) AS nc, count(*) FILTER (k = 2) AS nh,
  string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
