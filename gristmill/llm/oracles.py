"""DuckDB SQL that gives the rows of the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= 5
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (trim(line, ' ') IN (SELECT line FROM spread)) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (trim(line, ' ') NOT IN (SELECT line FROM spread)), '')) AS clean_sha256
FROM lines GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op5_benchmark_decontamination"] = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM items, unnest(range(1, len(w) - k + 2)) t(i)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), found AS (
  SELECT doc_id, item, i, d.k FROM (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM docs, (SELECT DISTINCT k FROM grams) s, unnest(range(1, len(w) - k + 2)) t(i)
  ) d JOIN grams USING (k, g)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + k)) t(p) GROUP BY 1
), owners AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


def _number(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


ORACLES["op7_source_mixing"] = f"""
WITH own AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS id, coalesce('s' || source, 'n') AS key, CAST(greatest(1, ceil(coalesce(strlen(text), 0) / 4.0)) AS BIGINT) AS tokens FROM documents
), totals AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens FROM own GROUP BY 1),
a AS (SELECT CASE WHEN max(tokens) <= 2 * min(tokens) THEN 0.0::DOUBLE ELSE ceil((1 - ln(2) / ln(max(tokens) / min(tokens))) * 1e6 - 1e-4) / 1e6 END AS a FROM totals),
z AS (SELECT a, sum(pow(tokens, a)) AS z, max(pow(tokens, 1 - a)) AS m FROM totals, a GROUP BY a),
w AS (SELECT key, tokens, pow(tokens, a) / z AS weight, CAST(round(m * z * (pow(tokens, a) / z)) AS BIGINT) AS budget FROM totals, z),
b AS (SELECT *, budget // tokens AS passes, budget % tokens AS rest, CAST(least(65536, greatest(1, ceil(tokens / 65536.0))) AS BIGINT) AS blocks FROM w),
d AS (SELECT own.doc_id, own.source, own.id, own.tokens, b.*EXCLUDE (tokens, key), own.key, {_number('id')} % blocks AS block FROM own JOIN b USING (key)),
p AS (SELECT key, block, rest, sum(tokens) AS tokens, {_number("'block'", 'key', 'CAST(block AS VARCHAR)', 'CAST(passes AS VARCHAR)')} AS place FROM d WHERE rest > 0 GROUP BY key, block, passes, rest),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY place, block) AS upto FROM p),
l AS (SELECT key, block AS last_block, place AS last_place, rest - upto + tokens AS room FROM u WHERE upto > rest AND upto - tokens <= rest),
i AS (SELECT d.key, room, tokens, {_number("'document'", 'id', 'CAST(passes AS VARCHAR)')} AS spot, id FROM d JOIN l ON d.key = l.key AND d.block = l.last_block),
s AS (SELECT key, min(spot) AS last_spot FROM (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY spot, id ROWS UNBOUNDED PRECEDING) AS upto FROM i) WHERE upto > room GROUP BY key)
SELECT doc_id, source, tokens AS n_tokens, round(weight, 6) AS weight, block,
  passes + CASE WHEN last_place IS NOT NULL AND ({_number("'block'", 'd.key', 'CAST(block AS VARCHAR)', 'CAST(passes AS VARCHAR)')} < last_place
    OR ({_number("'block'", 'd.key', 'CAST(block AS VARCHAR)', 'CAST(passes AS VARCHAR)')} = last_place AND block < last_block)
    OR (block = last_block AND {_number("'document'", 'id', 'CAST(passes AS VARCHAR)')} < last_spot)) THEN 1 ELSE 0 END AS copies
FROM d LEFT JOIN l ON d.key = l.key LEFT JOIN s ON d.key = s.key
"""

# Kinds with pattern, group and least length.
_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {number} AS rule, '{kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(hits[i]) AS size
FROM (SELECT doc_id, string_split_regex(text, {quoted}) AS gaps, regexp_extract_all(text, {quoted}, 0) AS hits, regexp_extract_all(text, {quoted}, {group}) AS kept FROM t), unnest(range(1, len(hits) + 1)) r(i) WHERE length(kept[i]) >= {least}"""


ORACLES["op9_secret_scans"] = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ("
    + "\nUNION ALL\n".join(_spans(i, *r) for i, r in enumerate(_RULES))
    + """)
SELECT t.doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rule) FILTER (rule < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rule), '') AS spans
FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""
)
