"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

from sorrel.llm.quality import COVER, TOP, Limits

SPACE = r"[^ \t\n\x0B\x0C\r]+"


def quality_rules(limits: Limits, docs: str = "documents") -> str:
    lengths = [*TOP, *COVER]
    grams = " UNION ALL ".join(f"SELECT {n} AS n, * FROM unnested WHERE pos + {n} - 1 <= n_words" for n in lengths)
    top = ", ".join(f"least(coalesce(max(mass) FILTER (n = {n}), 0) / greatest(any_value(total), 1), 1.0) AS top_{n}gram" for n in TOP)
    marked = ", ".join(f"max(CASE WHEN n = {n} THEN last END) AS end{n}" for n in COVER)
    reach = ", ".join(f"coalesce(max(end{n}) OVER (PARTITION BY r ORDER BY pos), 0) >= pos AS in{n}" for n in COVER)
    cover = ", ".join(f"coalesce(sum(width) FILTER (in{n}), 0) / greatest(sum(width), 1) AS dup_{n}gram" for n in COVER)
    rules = " AND ".join([f"coalesce(top_{n}gram, 0) <= {x}" for n, x in zip(TOP, limits.top)] + [f"coalesce(dup_{n}gram, 0) <= {x}" for n, x in zip(COVER, limits.cover)])
    zero = ", ".join([f"coalesce(top_{n}gram, 0)::DOUBLE AS top_{n}gram" for n in TOP] + [f"coalesce(dup_{n}gram, 0)::DOUBLE AS dup_{n}gram" for n in COVER])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT r, regexp_extract_all(text, '{SPACE}') AS words FROM d),
unnested AS (SELECT r, words, len(words) AS n_words, unnest(range(1, len(words) + 1)) AS pos FROM w),
width AS (SELECT r, pos, length(words[pos]) AS width, sum(length(words[pos])) OVER (PARTITION BY r) AS total FROM unnested),
grams AS ({grams}),
named AS (SELECT n, r, pos, pos + n - 1 AS last, array_to_string(words[pos:pos + n - 1], ' ') AS gram FROM grams),
counted AS (SELECT *, count(*) OVER (PARTITION BY n, r, gram) AS times FROM named),
again AS (SELECT * FROM counted WHERE times > 1),
tops AS (SELECT r, {top} FROM (SELECT a.r, a.n, a.times * (length(a.gram) - a.n + 1) AS mass, s.total FROM again a JOIN (SELECT r, any_value(total) AS total FROM width GROUP BY r) s USING (r) WHERE a.n <= {max(TOP)}) GROUP BY r),
ends AS (SELECT r, pos, {marked} FROM again WHERE n >= {min(COVER)} GROUP BY r, pos),
reach AS (SELECT r, pos, width, {reach} FROM width LEFT JOIN ends USING (r, pos)),
covers AS (SELECT r, {cover} FROM reach GROUP BY r),
l AS (SELECT r, trim(x, E' \t\n\x0B\x0C\r') AS line FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d)),
lc AS (SELECT r, line, count(*) AS times FROM l WHERE line <> '' GROUP BY r, line),
lines AS (SELECT r, sum(times) AS n_lines, coalesce(sum(times) FILTER (times > 1), 0) / sum(times) AS dup_line, coalesce(sum(times * length(line)) FILTER (times > 1), 0) / sum(times * length(line)) AS dup_line_chars FROM lc GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, {zero}, coalesce(dup_line, 0)::DOUBLE AS dup_line, coalesce(dup_line_chars, 0)::DOUBLE AS dup_line_chars,
  (len(words) < {limits.min_words} OR ({rules})) AND (coalesce(n_lines, 0) < {limits.min_lines} OR (coalesce(dup_line, 0) <= {limits.line} AND coalesce(dup_line_chars, 0) <= {limits.line_chars})) AS keep
FROM d JOIN w USING (r) LEFT JOIN tops USING (r) LEFT JOIN covers USING (r) LEFT JOIN lines USING (r)"""


def mixing_plan(alpha: float, budget_ratio: float, max_epochs: float, docs: str) -> str:
    """Water-filling in closed form: with the sources in order of cap / weight, those at their cap come first."""
    return f"""
sizes AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS n_chars FROM {docs} GROUP BY source),
ranked AS (SELECT source, n_chars, pow(n_chars, {alpha}) AS weight, row_number() OVER (ORDER BY n_chars / pow(n_chars, {alpha}), source) AS k FROM sizes WHERE n_chars > 0),
tried AS (SELECT *, {budget_ratio} * sum(n_chars) OVER () - coalesce(sum({max_epochs} * n_chars) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY k DESC) AS open FROM ranked),
level AS (SELECT min(k) AS k FROM tried WHERE rest * weight / open < {max_epochs} * n_chars),
plan AS (SELECT t.source, CASE WHEN l.k IS NULL OR t.k < l.k THEN {max_epochs} ELSE b.rest * t.weight / b.open / t.n_chars END AS epochs
  FROM tried t CROSS JOIN level l LEFT JOIN tried b ON b.k = l.k
  UNION ALL SELECT source, 1.0 FROM sizes WHERE n_chars = 0)"""


def times(seed: int) -> str:
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / pow(2, 48)"
    return f"(floor(epochs) + ({draw} < epochs - floor(epochs))::INT)::INT"


def source_mixing(alpha: float, budget_ratio: float, max_epochs: float, seed: int, docs: str = "documents") -> str:
    return f"""
WITH {mixing_plan(alpha, budget_ratio, max_epochs, docs)}
SELECT doc_id, source, unnest(range(1, times + 1))::INT AS repetition
FROM (SELECT d.doc_id, d.source, {times(seed)} AS times FROM {docs} d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)"""


BEFORE = r"coalesce(try_cast(nullif(regexp_extract(source, '^src(\d{1,9})$', 1), '') AS BIGINT) % 2 = 0, false)"


def exact_dedup(docs: str = "documents") -> str:
    return f"""
SELECT doc_id, CASE WHEN in_history THEN old ELSE least_id END AS winner, in_history FROM (
  SELECT doc_id, min(doc_id) FILTER ({BEFORE}) OVER t AS old, min(doc_id) OVER t AS least_id, bool_or({BEFORE}) OVER t AS in_history FROM {docs} WHERE text IS NOT NULL WINDOW t AS (PARTITION BY text))
UNION ALL SELECT doc_id, doc_id, {BEFORE} FROM {docs} WHERE text IS NULL"""


def ngram_join(threshold: float = 0.8, docs: str = "documents") -> str:
    """Links between word sets, for 1-grams, counted by document, and the classes that they connect."""
    return rf"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+')) AS word FROM {docs} WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list(word)) AS words FROM w GROUP BY doc_id),
names AS (SELECT words, min(doc_id) AS doc, len(words) AS n, count(*) AS copies FROM sets GROUP BY words),
u AS (SELECT doc, n, unnest(words) AS word FROM names),
common AS (SELECT a.doc AS a, b.doc AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.word = b.word AND a.doc < b.doc AND a.n >= {threshold} * b.n AND b.n >= {threshold} * a.n GROUP BY a.doc, b.doc),
pairs AS (SELECT a, b FROM common WHERE c / (na + nb - c) >= {threshold}),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
met(a, b) AS (SELECT doc, doc FROM names UNION SELECT met.a, links.b FROM met JOIN links ON met.b = links.a),
class AS (SELECT a AS doc, min(b) AS class_id FROM met GROUP BY a),
degree AS (SELECT l.a AS doc, sum(n.copies) AS linked FROM links l JOIN names n ON n.doc = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id)::BIGINT AS class_id, (coalesce(n.copies - 1, 0) + coalesce(g.linked, 0))::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM {docs} WHERE doc_id IS NOT NULL) d LEFT JOIN sets USING (doc_id) LEFT JOIN names n USING (words) LEFT JOIN class c ON c.doc = n.doc LEFT JOIN degree g ON g.doc = n.doc"""


def substring_dedup(min_words: int = 50, docs: str = "documents") -> str:
    """Windows of min_words words that several documents have, then islands of their intervals."""
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+') AS words FROM {docs} WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {min_words} + 2)) AS pos FROM w WHERE len(words) >= {min_words}),
g AS (SELECT doc_id, pos - 1 AS lo, md5(array_to_string(words[pos:pos + {min_words} - 1], ' ')) AS gram FROM p),
s AS (SELECT gram FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
i AS (SELECT DISTINCT doc_id, lo FROM g JOIN s USING (gram)),
b AS (SELECT *, CASE WHEN lo <= lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) + {min_words} THEN 0 ELSE 1 END AS new FROM i),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo) AS island FROM b)
SELECT doc_id, min(lo)::INT AS start_word, (max(lo) + {min_words})::INT AS end_word FROM n GROUP BY doc_id, island"""


def warc_fixity(per_file: int = 1000, often: int = 50, seldom: int = 1500, pages: str = "pages") -> str:
    """Both replicas' records with their offsets, without trees, matched one by one."""
    nl = "chr(13) || chr(10)"
    record = f"'WARC/1.0' || {nl} || 'WARC-Type: resource' || {nl} || 'WARC-Record-ID: <' || record_id || '>' || {nl} || 'WARC-Target-URI: ' || url || {nl} || 'Content-Type: text/html' || {nl} || 'Content-Length: ' || strlen(html) || {nl} || {nl} || html || {nl} || {nl}"
    laid = lambda t: f"SELECT *, sum(strlen(record)) OVER (PARTITION BY file ORDER BY position, record_id, digest ROWS UNBOUNDED PRECEDING) AS stop, row_number() OVER (PARTITION BY file, record_id ORDER BY digest) AS copy FROM (SELECT *, sha256(record) AS digest FROM (SELECT *, {record} AS record FROM {t}))"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(floor(page_id / {per_file}), -1)::BIGINT AS file, 'urn:page:' || coalesce(page_id::VARCHAR, 'none') AS record_id, coalesce(page_id, -1) AS position, ('0x' || substr(md5('fault:' || coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT AS draw FROM {pages}),
q AS (SELECT * REPLACE (CASE WHEN draw % {often} = 0 THEN '~' || substr(html, 2) WHEN draw % {seldom} = 1 THEN left(html, greatest(length(html) - 1, 0)) ELSE html END AS html) FROM p WHERE draw % {seldom} <> 2),
a AS ({laid("p")}), b AS ({laid("q")})
SELECT coalesce(a.file, b.file) AS file, coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.copy, b.copy)::INT AS copy,
  CASE WHEN b.file IS NULL THEN 'missing' WHEN a.file IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt' ELSE 'moved' END AS status,
  (a.stop - strlen(a.record))::BIGINT AS "begin", a.stop::BIGINT AS "end", (b.stop - strlen(b.record))::BIGINT AS replica_begin, b.stop::BIGINT AS replica_end
FROM a FULL JOIN b ON a.file = b.file AND a.record_id = b.record_id AND a.copy = b.copy
WHERE b.file IS NULL OR a.file IS NULL OR a.digest <> b.digest OR a.stop - strlen(a.record) <> b.stop - strlen(b.record)"""
