"""The results of this package's queries as SQL, where SQL can express them."""

from __future__ import annotations

import re

from staylight.llm.license_scan import PHRASES, TEMPLATES, TOKEN, marks_of
from staylight.llm.line_rules import BOILERPLATE, LINE_ENDS, WINDOW, LineRules

OP1_WARC = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
    SELECT payload_digest, payload_bytes, max(page_id) AS newest
    FROM d WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM d LEFT JOIN g USING (payload_digest, payload_bytes)
"""

#: Every pair that shares a shingle is counted: brute force, for small tables.
OP5_NEAR_DUP = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE
            WHEN len(words) = 0 THEN []
            WHEN len(words) < 4 THEN [words]
            ELSE list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]) END) AS shingle
        FROM w)
), n AS (
    SELECT doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)
), edge AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n
    UNION
    SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), component AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN component USING (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _line_rules() -> str:
    rules = LineRules()
    word = r"[^\x20\x09-\x0D]"
    found = lambda pattern: f"len(regexp_extract_all(line, {_text(pattern)}))"
    return rf"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
    FROM documents
), grams AS (
    SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), twice AS (
    SELECT doc_id, i FROM grams JOIN (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, gram)
), covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM twice) GROUP BY doc_id
), judged AS (
    SELECT doc_id, line,
           regexp_matches(line, {_text(LINE_ENDS)})
           AND {found('[#*$%&|<>{}~^]')} <= length(line) * {rules.symbol_share}::DOUBLE
           AND {found('[!?]{2,}')} <= {found(word + '+')} * {rules.shout_share}::DOUBLE
           AND {found('[|»›•·]')} < {rules.separators}
           AND NOT regexp_matches(line, {_text(BOILERPLATE)}) AS good
    FROM (SELECT doc_id, unnest(lines) AS line FROM w)
), kept_lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT good) AS n_removed_lines,
           CAST(coalesce(sum(length(line)) FILTER (WHERE good), 0) AS BIGINT) AS kept_chars,
           CAST(sum(length(line)) AS BIGINT) AS all_chars
    FROM judged GROUP BY doc_id
), figures AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(kept_chars, 0) AS kept_chars,
           coalesce(all_chars, 0) AS all_chars
    FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN kept_lines USING (doc_id)
), verdict AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures
)
SELECT * EXCLUDE (all_chars), NOT base_failed AND kept_chars >= all_chars * {rules.keep_share}::DOUBLE AS kept FROM verdict
"""


def _license_scan() -> str:
    places = []
    for phrase in PHRASES.values():
        parts = phrase.split(" ")
        places.append(
            f"list_filter(range(0, greatest(0, len(words) - {len(parts) - 1})), "
            f"lambda i: words[i + 1:i + {len(parts)}] = {_list(parts)})"
        )
    labels = " || ".join(f"CASE WHEN len(at{n}) > 0 THEN [{_text(k)}] ELSE [] END" for n, k in enumerate(PHRASES))
    rows = ", ".join(
        f"({_text(label)}, {_text(text.lower())}, {_list(marks_of(label, re.findall(TOKEN, text.lower())))})"
        for label, text in TEMPLATES
    )
    return rf"""
WITH w AS (
    SELECT doc_id, {_LOWER} AS low, regexp_extract_all({_LOWER}, '{TOKEN}') AS words FROM documents
), placed AS (
    SELECT doc_id, words, {", ".join(f"{p} AS at{n}" for n, p in enumerate(places))} FROM w
), base AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, at0 || at1 || at2 AS starts, {labels} AS named FROM placed
), template AS (
    SELECT label, marks, list_distinct(regexp_extract_all(text, '{TOKEN}')) AS want FROM (VALUES {rows}) AS t(label, text, marks)
), block AS (
    SELECT doc_id, list_distinct(words) AS have, ' ' || array_to_string(words, ' ') || ' ' AS in_a_row
    FROM (SELECT doc_id, regexp_extract_all(unnest(string_split(low, chr(10))), '{TOKEN}') AS words FROM w)
), met AS (
    SELECT doc_id, label, len(list_intersect(have, want)) AS n, len(want) AS size FROM block, template
    WHERE len(list_filter(marks, lambda m: NOT contains(in_a_row, ' ' || m || ' '))) = 0
), found AS (
    SELECT doc_id, list(DISTINCT label) AS more, max(n::DOUBLE / size) AS best
    FROM met WHERE n >= ceil(round(0.8::DOUBLE * size, 9)) GROUP BY doc_id
)
SELECT doc_id, n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
       array_to_string(list_sort(list_distinct(named)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(named || coalesce(more, []))), ',') AS labels,
       coalesce(best, 0.0::DOUBLE) AS score
FROM base LEFT JOIN found USING (doc_id)
"""


OP11_COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS words
    FROM documents
), grams AS (
    SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM pieces, range(1, 5) AS sizes(m))
), f AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), known AS MATERIALIZED (
    SELECT * FROM f WHERE f >= 30
), candidate AS MATERIALIZED (
    SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM known WHERE m > 1
), sides AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate)
), cut AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
    FROM sides c
    JOIN known l ON l.lang = c.lang AND l.phrase = c.head
    JOIN known r ON r.lang = c.lang AND r.phrase = c.tail
), lowest AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT lang, words, a, s, unnest(range(1, m - s + 2)) AS i
          FROM (SELECT *, unnest(range(2, m)) AS s FROM candidate))
    GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM lowest LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
"""

OP12_FILL_IN_MIDDLE = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn
    FROM documents
), h AS (
    SELECT doc_id, text, lines, CAST(len(lines) AS BIGINT) AS n,
           CAST('0x' || drawn[1:8] AS BIGINT) AS h1, CAST('0x' || drawn[9:16] AS BIGINT) AS h2,
           CAST('0x' || drawn[17:24] AS BIGINT) AS h3, CAST('0x' || drawn[25:32] AS BIGINT) AS h4
    FROM t
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), parts AS (
    SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
           array_to_string(lines[b + 1:], '') AS suffix
    FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_WARC,
        "op5_near_dup": OP5_NEAR_DUP,
        "op7_line_rules": _line_rules(),
        "op10_license_scan": _license_scan(),
        "op11_collocations": OP11_COLLOCATIONS,
        "op12_fill_in_middle": OP12_FILL_IN_MIDDLE,
    }
