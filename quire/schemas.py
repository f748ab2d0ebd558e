"""Schemas of the stored relations and the CSV dialect."""

from __future__ import annotations

PAPER_INDEX = (
    "id string, year int, filename_original string, title string, page_count int, word_count int, first_author string, path_original string"
)
DUPLICATES = (
    "id string, matched_id string, author_sim double, title_sim double, year int, filename_original string, title string, "
    "page_count int, word_count int, first_author string, path_original string"
)
DUPLICATES_KEEP = "id_a string, id_b string, keep_id string"
MANUAL_FIXES = "ID string, first_author_new string, title_actual string"
CORPUS = "id string, year int, title string, first_author string, filepath string, text string"
TOKENS = "id string, year int, word string"
THEMES = "year int, theme string, location string"

#: Reader: `NA` and empty fields are null, fields are trimmed.  Writer: null is `NA`, nothing is trimmed.
CSV_READ = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "NA", "emptyValue": "NA",
    "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
}
CSV_WRITE = {
    "header": "true", "quote": '"', "escape": '"', "nullValue": "NA", "emptyValue": "NA",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
