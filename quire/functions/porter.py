"""The Porter (1980) stemmer as SQL expressions over a column of lower-case words.

Each step is one expression over the column `w`; `Y` stands for a y that counts as consonant.
Words of one or two letters and words with other characters than a-z stay as they are.  Stem a
vocabulary, not a token stream: `stemmed` takes the distinct words and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C, V = "[^aeiouy]", "[aeiouy]"
M0, M1, M2 = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}*", f"^{C}*{V}+{C}+{V}+{C}"
SHORT = f"{C}{V}[^aeiouywxY]$"
#: Suffixes of steps 2 and 3 and what follows them, suffixes of step 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(n: int, more: str = "") -> str:
    own = f"left(w, length(w) - {n})"
    return f"concat({own}, '{more}')" if more else own


def _suffixes(table: dict[str, str], measure: str, like: str) -> str:
    cases = []
    for suffix in sorted(table, key=lambda s: (-len(s), s)):
        mark = "(?:s|t)" if suffix == "ion" else ""
        cases.append(
            f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {like}(w, '{measure}.*{suffix}$')"
            + (f" AND {like}(w, '{mark}{suffix}$')" if mark else "")
            + f" THEN {_cut(len(suffix), table[suffix])} ELSE w END"
        )
    return f"CASE {' '.join(cases)} ELSE w END"


def steps(like: str = "regexp_like", ref: str = "$1", flag: str = "") -> list[str]:
    """The steps in order; `like`, `ref` and `flag` are the engine's names for a search, a group and all matches."""
    twice = "right(w, 1) = substr(w, length(w) - 1, 1)"
    return [
        f"regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '{ref}Y'{flag})",
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END",
        # a trailing 1 marks a word that lost -ed or -ing
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {like}(w, '{M0}.*eed$') THEN {_cut(1)} ELSE w END"
        f" WHEN {like}(w, '{V}.*ed$') THEN {_cut(2, '1')} WHEN {like}(w, '{V}.*ing$') THEN {_cut(3, '1')} ELSE w END",
        f"CASE WHEN w LIKE '%1' THEN CASE WHEN {like}(w, '(?:at|bl|iz)1$') THEN {_cut(1, 'e')}"
        f" WHEN substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND {like}(w, '[^aeiouylsz]1$') THEN {_cut(2)}"
        f" WHEN {like}(w, '{M1}1$') AND {like}(w, '{SHORT[:-1]}1$') THEN {_cut(1, 'e')} ELSE {_cut(1)} END ELSE w END",
        f"CASE WHEN {like}(w, '{V}.*[yY]$') THEN {_cut(1, 'i')} ELSE w END",
        _suffixes(STEP2, M0, like),
        _suffixes(STEP3, M0, like),
        _suffixes(dict.fromkeys(STEP4, ""), M2, like),
        f"CASE WHEN w LIKE '%e' AND ({like}(w, '{M2}.*e$') OR {like}(w, '{M1}e$') AND NOT {like}(w, '{SHORT[:-1]}e$')) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {twice} AND {like}(w, '{M2}') THEN {_cut(1)} ELSE w END",
        "lower(w)",
    ]


def stemmed(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """words with a column `stem`; narrow.  Give it distinct words."""
    names = [F.col(f"`{c}`") for c in words.columns if c != stem]
    out = words.select(*names, F.col(word).alias("w"))
    for step in steps():
        out = out.select(*names, F.expr(step).alias("w"))
    plain = F.col(word).rlike("^[a-z]{3,}$")
    return out.select(*names, F.when(plain, F.col("w")).otherwise(F.col(word)).alias(stem))
