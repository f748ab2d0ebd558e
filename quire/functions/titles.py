"""Titles, first authors and affiliations as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import DIGIT, NWS, WS, let, squish, transliterate

#: Lines (lower case) that are no title.
BOILERPLATE = (
    "^official$",
    "^confidential$",
    "^draft$",
    "^restricted$",
    "^protected$",
    "^summary$",
    "^abstract$",
    "^introduction$",
    f"^{DIGIT}+$",
    "^[ivxlcdm]+$",
    "^https?://",
    r"^www\.",
    f"^{WS}*$",
    r"^\.$",
    "^,$",
    "^;$",
    "^-$",
    r"^\?$",
)
#: Parts of author or institution lines, in lower case, and the shapes of names.
INSTITUTION = r"university|department|institute|csiro|division|college|centre|center|research|school|faculty|laboratory|ltd|pty|inc|gov\.au|email|@"
NAMED = rf"^[A-Z][a-z]+{WS}[A-Z][a-z]+{DIGIT}*(?:,|{WS})"
INITIALS = rf"^[A-Z]\.[A-Z A-Z.]*(?:,|{DIGIT}|{WS})"


def is_boilerplate(line: Column) -> Column:
    # every pattern begins with ^: said once for all, the others are not tried behind the first letter
    return F.lower(line).rlike(f"^(?:{'|'.join(p.removeprefix('^') for p in BOILERPLATE)})")


def is_author_or_institution(line: Column) -> Column:
    # INSTITUTION lists plain words: each is searched for as it is, which long lines need
    named = line.rlike(NAMED) | line.rlike(INITIALS)
    return let(F.lower(line), lambda x: reduce(or_, [x.contains(w.replace("\\", "")) for w in INSTITUTION.split("|")])) | named


def readable(line: Column, most: float = 0.3) -> Column:
    """Fewer replacement characters than a share.  Where lines are transliterated first, none are left to count."""
    bad = F.length(line) - F.length(F.replace(line, F.lit("\ufffd"), F.lit("")))
    return bad / F.greatest(F.length(line), F.lit(1)) < most


def lines_of(page: Column) -> Column:
    return F.transform(F.split(page, "\n", -1), squish)


def _text_lines(page: Column) -> Column:
    return F.filter(lines_of(page), lambda x: (x != "") & ~x.rlike(f"^{DIGIT}{{1,4}}$"))


def first_line(page: Column) -> Column:
    """First line that isn't blank."""
    return F.get(F.filter(lines_of(page), lambda x: x != ""), F.lit(0))


def first_text_line(page: Column) -> Column:
    """First line that is neither blank nor a number of up to four digits."""
    return F.get(_text_lines(page), F.lit(0))


def colon(page: Column) -> Column:
    """first_text_line, and the line behind it after a colon."""
    return let(
        _text_lines(page),
        lambda ls: F.concat_ws(" ", F.get(ls, F.lit(0)), F.when(F.get(ls, F.lit(0)).endswith(":"), F.get(ls, F.lit(1)))),
    )


def _usable(page: Column) -> Column:
    return F.filter(lines_of(transliterate(page)), lambda x: (x != "") & ~is_boilerplate(x))


#: Lines of a page that are looked at first.
FIRST = 4


def _first_usable(page: Column, most: int) -> Column:
    """The first lines that are no boilerplate, `most` at least if the page has them: of the page's first FIRST lines, or
    of all where these have too few."""
    head = F.substring_index(page, "\n", FIRST)
    return let(_usable(head), lambda ls: F.when((F.size(ls) >= most) | (F.octet_length(head) == F.octet_length(page)), ls).otherwise(_usable(page)))


def continuation(page: Column) -> Column:
    """First line that is no boilerplate, with the lines that its ending calls for."""

    def joined(ls: Column) -> Column:
        a, b, c = (F.get(ls, F.lit(i)) for i in range(3))
        ended = r"[:;\-]$"
        more = F.when(a.rlike(ended), F.concat_ws(" ", b, F.when(b.rlike(ended), c))).when(
            ~a.rlike("[.!?]$") & ~is_author_or_institution(b), b
        )
        return squish(F.concat_ws(" ", a, more))

    return let(_first_usable(page, 3), joined)


def filename_title(filename: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(filename, r"\.pdf$", ""), f"^{DIGIT}{{4}}_[^_]+_", "")
    return squish(F.replace(bare, F.lit("_"), F.lit(" ")))


def placeholder_title(filename: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(filename, r"\.pdf$", ""), f"^{DIGIT}{{4}}_", "")
    return F.concat(F.lit("TITLE NEEDED — "), bare)


TITLES = {"first_line": first_line, "first_text_line": first_text_line, "colon": colon, "continuation": continuation}


def title_of(page: Column, strategy: str = "continuation") -> Column:
    """Null for a page without a usable line."""
    return let(TITLES[strategy](page), lambda x: F.nullif(x, F.lit("")))  # nullif computes its value twice


def affiliation(page: Column, title: Column, most: int = 4, seen: int = 6, words: int = 12) -> Column:
    """Lines behind the title: of the first `seen` that aren't blank those before one of over
    `words` words, `most` at the most.  Null where the title or anything behind it is missing."""

    def block(post: Column) -> Column:
        near = F.slice(post, 1, seen)
        cut = F.array_position(F.transform(near, lambda x: F.regexp_count(x, F.lit(NWS + "+")) > words), True)
        n = F.when(cut == 0, F.lit(most)).otherwise(F.least(cut - 1, F.lit(most))).cast("int")
        return F.when(F.size(post) > 0, F.array_join(F.slice(near, F.lit(1), n), "; "))

    def behind(ls: Column) -> Column:
        at = F.array_position(ls, title).cast("int")
        return F.when(at > 0, let(F.filter(F.slice(ls, at + 1, F.size(ls)), lambda x: x != ""), block))

    return let(lines_of(page), behind)


def _bare(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.pdf$", "")


def _camel(x: Column) -> Column:
    return F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")


def _no_year(x: Column) -> Column:
    return F.regexp_replace(x, f"^{DIGIT}{{4}}_", "")


def author_segment(filename: Column) -> Column:
    own = squish(F.regexp_substr(_no_year(_bare(filename)), F.lit("^[^_]+")))
    return F.regexp_replace(own, " and .*$", "")


def author_segment_camel(filename: Column) -> Column:
    return squish(_camel(F.regexp_substr(_no_year(_bare(filename)), F.lit("^[^_]+"))))


def author_strict(filename: Column) -> Column:
    """Null without a year in front."""
    return _camel(_no_year(F.regexp_substr(filename, F.lit(f"^{DIGIT}{{4}}_[^_]+"))))


def author_all_but_last(filename: Column) -> Column:
    return squish(_camel(F.regexp_replace(_no_year(_bare(filename)), "_[^_]+$", "")))


AUTHORS = {
    "segment": author_segment,
    "segment_camel": author_segment_camel,
    "strict_year_prefix": author_strict,
    "all_but_last": author_all_but_last,
}
