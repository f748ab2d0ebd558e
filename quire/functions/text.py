"""Text expressions over columns: white space, counts, transliteration, paths, missing values.

White space and digits follow one portable dialect, WS and DIGIT, which no-break spaces are part of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\f\r\p{Z}]"
NWS = r"[^\t\n\f\r\p{Z}]"
DIGIT = r"\p{Nd}"

#: Characters and what stands for them in a title.
TRANSLITERATED = (
    ("’", "'"),
    ("‘", "'"),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", "-"),
    ("™", "TM"),
    ("®", "(R)"),
    ("°", " degrees"),
    ("�", ""),
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space other than one blank between words.
LOOSE = rf"[\t\n\f\r\p{{Z}}&&[^ ]]{WS}*| {WS}+"


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, LOOSE, " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(NWS + "+"))


def transliterate(x: Column) -> Column:
    one = [(a, b) for a, b in TRANSLITERATED if len(b) == 1]
    y = F.translate(x, "".join(a for a, _ in one), "".join(b for _, b in one))
    for a, b in TRANSLITERATED:
        if len(b) != 1:
            y = F.replace(y, F.lit(a), F.lit(b))
    # all of them are beyond ASCII
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(y)


def repaired(x: Column, mark: str = "-") -> Column:
    """Invalid UTF-8 replaced, one mark for each bad byte."""
    return F.replace(F.make_valid_utf8(x), F.lit("�"), F.lit(mark))


def normalised(x: Column) -> Column:
    """Lower case, letters a-z and white space only, squished: what similarities compare."""
    return squish(F.regexp_replace(F.lower(x), r"[^a-z\t\n\f\r\p{Z}]", ""))


def or_na(x: Column) -> Column:
    """Text of a value, `NA` for null, as when values are pasted."""
    return F.coalesce(x.cast("string"), F.lit("NA"))


def numbered_id(year: Column, number: Column) -> Column:
    """<year>_<number, four digits at least>."""
    digits = number.cast("string")
    return F.concat(or_na(year), F.lit("_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def path_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_parent(path: Column) -> Column:
    """Name of the folder that holds the file; null without one."""
    return F.nullif(F.regexp_extract(path, "([^/]+)/[^/]*$", 1), F.lit(""))


def year_of(path: Column) -> Column:
    return path_parent(path).try_cast("int")


def in_year_folder(path: Column) -> Column:
    return path.rlike(f"/{DIGIT}{{4}}/")


def changed_to(x: Column) -> Column:
    """A correction: null where blank or `no change`, else squished."""
    own = squish(x)
    return F.when(own.isNull() | (own == "") | (F.lower(own) == "no change"), None).otherwise(own)
