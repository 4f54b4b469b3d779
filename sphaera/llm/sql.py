"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

from .licenses import BASE, COVERAGE, SLACK, TEMPLATES, postings
from .neardup import PERCENT, WORDS
from .warc import _HEAD, DATE, FANOUT, LEVELS, SHARD_RECORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS ws FROM documents"


def near_duplicates() -> str:
    n = WORDS
    return f"""
    WITH RECURSIVE w AS ({_words('[^ \\x09-\\x0D]+')}),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {n - 2}))) AS k FROM w WHERE len(ws) > 0)),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ways b ON r.other = b.a),
    m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)"""


def license_scan() -> str:
    value = ", ".join(f"('{w}', {k}, {at}, CAST({weight!r} AS DOUBLE))" for w, k, at, weight in postings())
    templates = ", ".join(f"({k}, '{label}', '{phrase}')" for k, (label, phrase, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{p.split()[0]}', '{label}')" for p, label in BASE)
    starts = ", ".join(f"i - place + {d}" for d in range(-SLACK, SLACK + 1))
    return f"""
    WITH w AS ({_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')}),
    u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
    base AS (SELECT doc_id, i, label FROM u JOIN (VALUES {phrases}) AS p(phrase, n, word, label) USING (word) JOIN w USING (doc_id) WHERE array_to_string(ws[i + 1 : i + n], ' ') = phrase),
    b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
    ok AS (SELECT doc_id, template, label FROM w, (VALUES {templates}) AS t(template, label, phrase) WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')),
    h AS (SELECT doc_id, template, label, place, weight, unnest([{starts}]) AS start FROM u JOIN (VALUES {value}) AS v(word, template, place, weight) USING (word) JOIN ok USING (doc_id, template)),
    o AS (SELECT doc_id, template, label, start, place, max(weight) AS weight FROM h GROUP BY ALL),
    a AS (SELECT doc_id, label, sum(weight) AS coverage FROM o GROUP BY doc_id, template, label, start HAVING sum(weight) >= {COVERAGE}),
    f AS (SELECT doc_id, list(DISTINCT label) AS labels, least(max(coverage), 1.0) AS coverage FROM a GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(b.labels, []), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
        CAST(CASE WHEN b.doc_id IS NOT NULL THEN 1 ELSE coalesce(round(f.coverage, 6), 0) END AS DOUBLE) AS score
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)"""


def warc_fixity() -> str:
    """Status by comparing the records of both sides one by one, without trees; the trees give the roots only."""
    text = lambda s: " || ".join(f"'{part}'" for part in s.replace("\r\n", "\n").split("\n")).replace("' || '", "' || chr(13) || chr(10) || '")
    parts = ("CAST(page_id AS VARCHAR)", "coalesce(url, '')", f"'{DATE}'", "CAST(octet_length(encode(html)) AS VARCHAR)", "html")
    record = " || ".join(x for pair in zip(map(text, _HEAD), parts) for x in pair) + " || " + text(_HEAD[-1])
    levels = "".join(f", l{k + 1} AS (SELECT shard, idx // {FANOUT} AS idx, CAST(min(start) AS BIGINT) AS start, CAST(sum(length) AS BIGINT) AS length, sha256(string_agg(concat_ws(':', idx, start, length, digest), ',' ORDER BY idx)) AS digest FROM l{k} GROUP BY shard, idx // {FANOUT})" for k in range(LEVELS))
    leaves = lambda rows: f"""SELECT page_id, shard, idx, CAST(sum(length) OVER (PARTITION BY shard ORDER BY idx) - length AS BIGINT) AS start, length, digest FROM
        (SELECT page_id, CAST(floor(page_id / {SHARD_RECORDS}) AS BIGINT) AS shard, page_id - {SHARD_RECORDS} * CAST(floor(page_id / {SHARD_RECORDS}) AS BIGINT) AS idx, octet_length(encode({record})) AS length, sha256({record}) AS digest FROM {rows})"""  # noqa: E731
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, url, CASE WHEN page_id % 97 = 7 THEN left(html, greatest(0, CAST(length(html) AS BIGINT) - 1)) || '~' WHEN page_id % 2003 = 13 THEN html || '+' ELSE html END AS html FROM p WHERE page_id % 4001 <> 11
        UNION ALL SELECT -1 - page_id, url, html FROM p WHERE page_id % 389 = 5),
    l0 AS ({leaves("p")}), r0 AS ({leaves("d")}){levels}
    SELECT coalesce(l0.page_id, r0.page_id) AS page_id, coalesce(l0.shard, r0.shard) AS shard, coalesce(l0.start, r0.start) AS warc_offset, coalesce(l0.length, r0.length) AS length, coalesce(l0.digest, r0.digest) AS sha256, t.digest AS shard_root,
        CASE WHEN r0.page_id IS NULL THEN 'missing' WHEN l0.page_id IS NULL THEN 'extra' WHEN l0.digest <> r0.digest THEN 'corrupt' WHEN l0.start <> r0.start THEN 'moved' ELSE 'intact' END AS status,
        r0.start AS replica_offset, l0.digest IS NOT DISTINCT FROM r0.digest AND l0.start IS NOT DISTINCT FROM r0.start AS intact
    FROM l0 FULL JOIN r0 ON l0.page_id = r0.page_id LEFT JOIN l{LEVELS} t ON t.shard = coalesce(l0.shard, r0.shard)"""


ORACLE_SQL = {"op2_near_duplicates": near_duplicates(), "op5_license_scan": license_scan(), "op9_warc_fixity": warc_fixity()}
