"""The queries of workload.py as SQL for DuckDB over the same tables."""

from __future__ import annotations

from quire.functions.porter import steps
from quire.functions.text import NWS, TRANSLITERATED, WS
from quire.functions.titles import BOILERPLATE, INITIALS, INSTITUTION, NAMED
from quire.operators.wordfreq import STOPS, TOKEN


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normal(x: str) -> str:
    return squish(rf"regexp_replace(lower({x}), '[^a-z\t\n\f\r\p{{Z}}]', '', 'g')")


def plain(x: str) -> str:
    for a, b in TRANSLITERATED:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def camel(x: str) -> str:
    return rf"regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g')"


BARE = r"regexp_replace(fn, '\.pdf$', '')"
NO_YEAR = rf"regexp_replace({BARE}, '^\p{{Nd}}{{4}}_', '')"
SEGMENT = f"nullif(regexp_extract({NO_YEAR}, '^[^_]+'), '')"
AUTHOR = f"regexp_replace({squish(SEGMENT)}, ' and .*$', '')"
BOILER = q("|".join(f"(?:{p})" for p in BOILERPLATE))


def author_line(x: str) -> str:
    return f"(regexp_matches(lower({x}), {q(INSTITUTION)}) OR regexp_matches({x}, {q(NAMED)}) OR regexp_matches({x}, {q(INITIALS)}))"


def lines(x: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda x: {squish('x')})"


USABLE = f"list_filter({lines(plain('text'))}, lambda x: x <> '' AND NOT regexp_matches(lower(x), {BOILER}))"
NUMBERLESS = rf"list_filter({lines('text')}, lambda x: x <> '' AND NOT regexp_matches(x, '^\p{{Nd}}{{1,4}}$'))"
CONTINUED = rf"""nullif({squish(rf'''concat_ws(' ', l[1], CASE WHEN regexp_matches(l[1], '[:;\-]$')
 THEN concat_ws(' ', l[2], CASE WHEN regexp_matches(l[2], '[:;\-]$') THEN l[3] END)
 WHEN NOT regexp_matches(l[1], '[.!?]$') AND NOT {author_line("l[2]")} THEN l[2] END)''')}, '')"""

P = rf"""p AS (SELECT doc_id, text, CAST(1980 + TRY_CAST(substr(source, 4) AS INT) AS INT) AS year,
 coalesce(regexp_replace(regexp_extract(string_split(text, chr(10))[2], '{NWS}+'), '[/_]', '', 'g'), '') AS au FROM documents),
f AS (SELECT *, coalesce(CAST(year AS VARCHAR), 'NA') || '_' || au || '_' || doc_id || '.pdf' AS fn FROM p),
g AS (SELECT *, '/root/' || coalesce(CAST(year AS VARCHAR), 'NA') || '/' || fn AS path FROM f)"""
IDX = rf"""{P}, h AS (SELECT *, {USABLE} AS l FROM g),
idx AS (SELECT coalesce(CAST(year AS VARCHAR), 'NA') || '_' || printf('%04d', row_number() OVER (PARTITION BY year ORDER BY fn, path)) AS id,
 year, fn AS filename_original, {CONTINUED} AS title, CAST(CASE WHEN text IS NOT NULL THEN 1 END AS INT) AS page_count,
 CAST(len(regexp_extract_all(text, '{NWS}+')) AS INT) AS word_count, {AUTHOR} AS first_author, path AS path_original, doc_id FROM h)"""
COLUMNS = "id, year, filename_original, title, page_count, word_count, first_author, path_original"


def sim(a: str, b: str) -> str:
    return f"round(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 ELSE jaro_similarity({a}, {b}) END, 3)"


CAND = f"""{IDX}, n AS (SELECT id, word_count AS wc, {normal('first_author')} AS au, {normal('title')} AS ti FROM idx),
cand AS (SELECT a.id AS id_a, b.id AS id_b, a.wc AS word_count_a, a.au AS au_a, b.au AS au_b, a.ti AS ti_a, b.ti AS ti_b
 FROM n a JOIN n b ON a.wc = b.wc AND a.id < b.id),
sc AS (SELECT id_a, id_b, {sim('au_a', 'au_b')} AS author_sim, {sim('ti_a', 'ti_b')} AS title_sim, word_count_a FROM cand)"""


def tier(a: float, t: float) -> str:
    return f"WITH {CAND} SELECT * FROM sc WHERE author_sim >= {a} AND title_sim >= {t}"


DUP = f"""{CAND}, pr AS (SELECT * FROM sc WHERE author_sim >= 0.85 AND title_sim >= 0.85),
dup AS (SELECT id_a AS id, id_b AS matched_id, author_sim, title_sim FROM pr UNION ALL SELECT id_b, id_a, author_sim, title_sim FROM pr),
can AS (SELECT DISTINCT least(id, matched_id) AS id_a, greatest(id, matched_id) AS id_b FROM dup),
kept AS (SELECT * FROM idx WHERE id NOT IN (SELECT id_b FROM can))"""
FIX = f"""{IDX}, lb AS (SELECT doc_id, max(quality) AS qu, max(toxic) AS tx FROM labels GROUP BY doc_id),
fx AS (SELECT id, CASE WHEN tx = 1 THEN ' No Change ' END AS fa, CASE WHEN qu = 0 THEN 'FIX-' || doc_id END AS ft FROM idx JOIN lb USING (doc_id))"""
TOK = f"""{P}, tk AS (SELECT doc_id, year, unnest(regexp_extract_all(lower(text), {q(TOKEN)})) AS word FROM g),
lt AS (SELECT * FROM tk WHERE regexp_matches(word, '^[a-z]+$')),
ns AS (SELECT * FROM lt WHERE word NOT IN ({', '.join(map(q, STOPS))}))"""


def _stems() -> str:
    parts = ["s0 AS (SELECT DISTINCT word, word AS w FROM ns)"]
    for i, step in enumerate(steps("regexp_matches", r"\1", ", 'g'")):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT word, {step} AS w FROM s{i})")
    last = f"s{len(parts) - 1}"
    parts.append(f"st AS (SELECT ns.*, CASE WHEN length(ns.word) > 2 THEN w ELSE ns.word END AS stem FROM ns JOIN {last} USING (word))")
    return ", ".join(parts)


STEM = f"{TOK}, {_stems()}"
WORDS = f"{TOK}, cn AS (SELECT year, word, count(*) AS n FROM ns GROUP BY ALL)"
STEMS = f"{STEM}, cn AS (SELECT year, stem AS word, count(*) AS n FROM st GROUP BY ALL)"
TOP = "tp AS (SELECT year, word, n FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS r FROM cn) WHERE r <= 10)"
THEMES = "th AS (SELECT CAST(1980 + r_regionkey AS INT) AS year, r_name AS theme, CAST(NULL AS VARCHAR) AS location FROM region)"
LABEL = "coalesce(CAST(year AS VARCHAR), 'NA') || chr(10) || coalesce(theme, 'NA') "


def _by_year(cte: str, source: str, word: str = "word") -> str:
    return f"WITH {cte} SELECT year, count(*) AS n, count(DISTINCT {word}) AS n_distinct FROM {source} GROUP BY year"


def _file(value: str) -> str:
    return f"WITH {P} SELECT doc_id, {value} AS value FROM g"


def _changed(x: str) -> str:
    return f"CASE WHEN {squish(x)} = '' OR lower({squish(x)}) = 'no change' THEN NULL ELSE {squish(x)} END"


BAD = "chr(65533)"
MARKED = f"translate(text, 'aei', {BAD} || {BAD} || {BAD})"
SPLIT = f"""{P}, z AS (SELECT *, CASE WHEN text IS NOT NULL THEN list_transform(range(0, CAST(ceil(len(string_split(text, chr(10))) / 4) AS INT)),
 lambda i: array_to_string(string_split(text, chr(10))[i * 4 + 1:i * 4 + 4], chr(10))) END AS pages FROM g)"""


def _all(t: float) -> str:
    return f"""WITH {IDX}, n AS (SELECT id, word_count AS wc, {normal('first_author')} AS au, {normal('title')} AS ti FROM idx),
 sc AS (SELECT a.id AS id_a, b.id AS id_b, {sim('a.au', 'b.au')} AS author_sim, {sim('a.ti', 'b.ti')} AS title_sim, a.wc AS word_count_a FROM n a JOIN n b ON a.id < b.id)
 SELECT * FROM sc WHERE author_sim >= {t} AND title_sim >= {t}"""


def oracle_sql() -> dict[str, str]:
    behind = "list_filter(l[list_position(l, t) + 1:], lambda x: x <> '')[1:6]"
    found = {
        "word_count": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{NWS}+')) AS INT) AS n FROM documents",
        "squish_normalise": f"SELECT doc_id, md5({squish('text')}) AS squished, md5({normal('text')}) AS normal FROM documents",
        "transliterate": f"SELECT doc_id, md5({plain('text')}) AS plain FROM documents",
        "path_parse": f"WITH {P} SELECT doc_id, year, coalesce(CAST(year AS VARCHAR), 'NA') AS parent, fn AS file FROM g",
        "author_segment": _file(AUTHOR),
        "author_camel": _file(squish(camel(SEGMENT))),
        "author_strict": _file(camel(r"regexp_replace(nullif(regexp_extract(fn, '^\p{Nd}{4}_[^_]+'), ''), '^\p{Nd}{4}_', '')")),
        "author_all_but_last": _file(squish(camel(f"regexp_replace({NO_YEAR}, '_[^_]+$', '')"))),
        "title_first_line": f"SELECT doc_id, list_filter({lines('text')}, lambda x: x <> '')[1] AS title FROM documents",
        "title_first_text_line": f"SELECT doc_id, {NUMBERLESS}[1] AS title FROM documents",
        "title_colon": f"WITH a AS (SELECT doc_id, {NUMBERLESS} AS l FROM documents) SELECT doc_id, nullif(concat_ws(' ', l[1], CASE WHEN l[1] LIKE '%:' THEN l[2] END), '') AS title FROM a",
        "title_continuation": f"WITH a AS (SELECT doc_id, {USABLE} AS l FROM documents) SELECT doc_id, {CONTINUED} AS title FROM a",
        "title_filename_fallback": _file(squish(rf"replace(regexp_replace({BARE}, '^\p{{Nd}}{{4}}_[^_]+_', ''), '_', ' ')")),
        "title_placeholder": _file(f"'TITLE NEEDED — ' || {NO_YEAR}"),
        "affiliation_block": f"""WITH a AS (SELECT doc_id, {lines('text')} AS l, {NUMBERLESS}[1] AS t FROM documents),
 b AS (SELECT doc_id, CASE WHEN t IS NOT NULL THEN {behind} END AS near FROM a),
 c AS (SELECT doc_id, near, list_position(list_transform(near, lambda x: len(regexp_extract_all(x, '{NWS}+')) > 12), true) AS cut FROM b)
 SELECT doc_id, CASE WHEN len(near) > 0 THEN coalesce(array_to_string(near[1:CASE WHEN coalesce(cut, 0) = 0 THEN 4 ELSE least(cut - 1, 4) END], '; '), '') END AS affiliation_raw FROM c""",
        "boilerplate_filter": f"""WITH a AS (SELECT unnest({lines('text')}) AS line FROM documents)
 SELECT regexp_matches(lower(line), {BOILER}) AS boilerplate, {author_line('line')} AS author, count(*) AS n FROM a GROUP BY ALL""",
        "assign_ids": f"WITH {IDX} SELECT {COLUMNS} FROM idx",
        "failed_titles": f"WITH {IDX} SELECT id, year, filename_original FROM idx WHERE title IS NULL",
        "rows_update_overwrite": f"WITH {FIX} SELECT i.id, CASE WHEN fx.id IS NOT NULL THEN ft ELSE title END AS title, CASE WHEN fx.id IS NOT NULL THEN fa ELSE first_author END AS first_author FROM idx i LEFT JOIN fx ON i.id = fx.id",
        "rows_update_skip_blank": f"WITH {FIX} SELECT i.id, coalesce({_changed('ft')}, title) AS title, coalesce({_changed('fa')}, first_author) AS first_author FROM idx i LEFT JOIN fx ON i.id = fx.id",
        "changed_to": f'WITH {FIX} SELECT id AS "ID", {_changed("fa")} AS author, {_changed("ft")} AS title FROM fx',
        "exact_title_duplicates": f"WITH {IDX} SELECT id, year, title FROM (SELECT *, count(*) OVER (PARTITION BY title) AS c FROM idx) WHERE c > 1",
        "candidate_pairs": f"WITH {CAND} SELECT id_a, id_b, word_count_a FROM cand",
        "jaro_scores": f"WITH {CAND} SELECT * FROM sc",
        "duplicate_pairs": tier(0.85, 0.85),
        "duplicate_pairs_strict": tier(0.90, 0.90),
        "duplicate_pairs_moderate": tier(0.70, 0.70),
        "expand_duplicates": f"WITH {DUP} SELECT d.id, matched_id, author_sim, title_sim, {COLUMNS[4:]} FROM dup d LEFT JOIN idx i ON d.id = i.id",
        "duplicate_pairs_strict_all": _all(0.90),
        "duplicate_pairs_moderate_all": _all(0.70),
        "pair_count": "SELECT n, n * (n - 1) // 2 AS pairs, format('{:,}', n * (n - 1) // 2) AS shown FROM (SELECT count(*) AS n FROM documents)",
        "example_titles": f"WITH {IDX}, t AS (SELECT title FROM idx GROUP BY title HAVING count(*) > 1 ORDER BY min((year IS NULL, year, filename_original, path_original)) LIMIT 3) SELECT id, year, idx.title FROM idx JOIN t ON idx.title IS NOT DISTINCT FROM t.title",
        "preview": f"WITH {IDX} SELECT {COLUMNS} FROM idx ORDER BY id LIMIT 20",
        "readable_lines": f"WITH a AS (SELECT unnest({lines(MARKED)}) AS x FROM documents) SELECT (length(x) - length(replace(x, {BAD}, ''))) / greatest(length(x), 1) < 0.3 AS readable, count(*) AS n FROM a GROUP BY ALL",
        "build_corpus": f"""WITH {SPLIT}, h AS (SELECT *, {USABLE.replace('text', 'pages[1]')} AS l FROM z),
 i AS (SELECT coalesce(CAST(year AS VARCHAR), 'NA') || '_' || printf('%04d', row_number() OVER (PARTITION BY year ORDER BY fn, path)) AS id,
  year, {CONTINUED} AS title, {AUTHOR} AS first_author, path AS filepath, md5(array_to_string(pages, ' ')) AS text, coalesce(len(pages), -1) AS page_count FROM h)
 SELECT id, year, title, first_author, filepath, text, CAST(page_count AS INT) AS page_count FROM i""",
        "canonical_pairs": f"WITH {DUP} SELECT * FROM can",
        "resolve_default": f"WITH {DUP} SELECT id FROM kept",
        "resolve_override": f"WITH {DUP} SELECT id_a, id_b, CASE WHEN e THEN id_b ELSE id_a END AS keep_id, CASE WHEN e THEN id_a ELSE id_b END AS drop_id FROM (SELECT *, CAST(right(id_b, 1) AS INT) % 2 = 0 AS e FROM can)",
        "sync_plan": f"WITH {DUP} SELECT id, '/root/papers_flat/' || id || '.pdf' AS path, id || '.pdf' AS filename FROM idx WHERE id NOT IN (SELECT id FROM kept)",
        "sync_check": f"WITH {DUP}, c AS (SELECT (SELECT count(*) FROM idx) AS n_files, (SELECT count(*) FROM kept) AS n_index) SELECT n_files, n_index, n_files - n_index AS extra, 0 AS missing, n_files = n_index AS in_sync FROM c",
        "copy_plan": f"WITH {IDX} SELECT path_original, '/root/papers_flat/' || id || '.pdf' AS path_new FROM idx",
        "tokens": _by_year(TOK, "tk"),
        "tokens_letters": _by_year(TOK, "lt"),
        "tokens_nostop": _by_year(TOK, "ns"),
        "tokens_stemmed": _by_year(STEM, "st", "stem"),
        "token_funnel": f"WITH {TOK} SELECT 'raw' AS stage, count(*) AS n FROM tk UNION ALL SELECT 'letters', count(*) FROM lt UNION ALL SELECT 'kept', count(*) FROM ns UNION ALL SELECT 'vocabulary', count(DISTINCT word) FROM ns",
        "word_counts": f"WITH {WORDS} SELECT * FROM cn",
        "stem_counts": f"WITH {STEMS} SELECT * FROM cn",
        "top_terms_ties": f"WITH {STEMS}, {TOP} SELECT * FROM tp",
        "top_terms_surface": f"WITH {WORDS}, {TOP} SELECT * FROM tp",
        "top_terms_global": f"WITH {STEMS}, t AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cn GROUP BY word) SELECT word, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM t) WHERE r <= 20",
        "top_terms_themes": f"WITH {STEMS}, {TOP}, {THEMES} SELECT year, word, n, theme, location FROM tp LEFT JOIN th USING (year)",
        "facet_labels": f"WITH {IDX}, {THEMES}, y AS (SELECT DISTINCT year FROM idx) SELECT year, {LABEL} AS label FROM y LEFT JOIN th USING (year)",
        "plot_frame": f"WITH {STEMS}, {TOP}, {THEMES} SELECT year, {LABEL} AS facet_label, word, n, CAST(row_number() OVER (PARTITION BY year ORDER BY n, word) AS INT) AS order_in_facet FROM tp LEFT JOIN th USING (year)",
        "first_k_per_year": f"WITH {IDX} SELECT id, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY path_original) AS r FROM idx) WHERE r <= 8",
        "sample_k_per_year": f"WITH {IDX} SELECT id, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5(id || ':42'), id) AS r FROM idx) WHERE r <= 5",
        "years_covered": f"WITH {IDX} SELECT string_agg(year, ', ' ORDER BY year) AS years FROM (SELECT DISTINCT year FROM idx WHERE year IS NOT NULL)",
        "null_counts": f"WITH {IDX} SELECT count(*) AS n, {', '.join(f'count(*) - count({c}) AS null_{c}' for c in COLUMNS.split(', '))} FROM idx",
        "flat_reindex": rf"WITH {IDX} SELECT id, TRY_CAST(regexp_extract(id, '^\p{{Nd}}{{4}}') AS INT) AS year, TRY_CAST(regexp_extract(id, '\p{{Nd}}{{4}}$') AS INT) AS paper_num, id || '.pdf' AS filename_new FROM idx",
        "csv_roundtrip": f"WITH {IDX} SELECT {COLUMNS} FROM idx",
    }
    # positions in the text order the examples
    placed = STEM.replace("SELECT doc_id, year, unnest(", "SELECT doc_id, year, generate_subscripts(regexp_extract_all(lower(text), " + q(TOKEN) + "), 1) AS pos, unnest(", 1)
    found["stem_examples"] = f"""WITH {placed}, w1 AS (SELECT stem, word, count(*) AS c, min((doc_id, pos)) AS a FROM st GROUP BY ALL),
 w2 AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY a) AS r FROM w1),
 w3 AS (SELECT stem, CAST(sum(c) AS BIGINT) AS n, list(word ORDER BY r) FILTER (r <= 3) AS ws FROM w2 GROUP BY stem)
 SELECT stem, n, array_to_string(list_concat(ws, ['NA', 'NA', 'NA'])[1:least(3, n)], ', ') AS examples FROM w3 ORDER BY n DESC, stem LIMIT 20"""
    return found
