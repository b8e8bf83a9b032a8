r"""The queries that SQL can express, for DuckDB. They read whole tables and share nothing with the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_PLAIN = r"regexp_extract_all(" + _LOW + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"


def _words(source: str, words: str, key: str = "doc_id") -> str:
    """w: a text's words as a list; u: a row per word."""
    return f"w AS (SELECT {key}, {words} AS words FROM {source}), u AS (SELECT {key}, words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)"


QUALITY = (
    "WITH "
    + _words("documents", _WORDS)
    + r""",
v AS (SELECT *, CASE WHEN i + 7 <= len(words) THEN array_to_string(words[i:i + 7], ' ') END AS win, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM u),
x AS (SELECT *, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS twice FROM v),
y AS (SELECT *, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM x),
f AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(covered) AS BIGINT) AS n_repeat_words,
 count(*) FILTER (WHERE regexp_matches(word, '[A-Z][^A-Z]*[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS n_shouted,
 count(*) FILTER (WHERE NOT regexp_matches(word, '[0-9A-Za-z\x{80}-\x{10FFFF}]')) AS n_marks,
 count(*) FILTER (WHERE word = before) AS n_echoes FROM y GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_shouted, 0) AS n_shouted, coalesce(n_marks, 0) AS n_marks, coalesce(n_echoes, 0) AS n_echoes
 FROM documents AS d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
 OR 100 * n_shouted > 30 * n_words OR 100 * n_echoes > 30 * n_words OR 100 * n_marks > 20 * n_words) AS kept FROM b"""
)

NEAR_DUPLICATES = (
    "WITH RECURSIVE "
    + _words("documents", _WORDS.replace("coalesce(text, '')", _LOW))
    + """,
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM u WHERE i + 4 <= len(words) UNION SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM p JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b WHERE 100 * both_have >= 80 * (m.size + o.size - both_have)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, d.component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) AS d LEFT JOIN n ON n.doc_id = d.doc_id"""
)

DECONTAMINATION = (
    "WITH "
    + _words("documents", _PLAIN)
    + f""",
bw AS (SELECT item_id, {_PLAIN} AS words FROM benchmark),
bu AS (SELECT item_id, words, generate_subscripts(words, 1) AS i FROM bw),
wins AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 12], ' ') AS win, least(13, len(words)) AS size FROM bu WHERE i + 12 <= len(words) OR (i = 1 AND len(words) < 13)),
sizes AS (SELECT DISTINCT size FROM wins),
dw AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM u, sizes WHERE i + size - 1 <= len(words)),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN wins ON wins.win = dw.win AND wins.size = dw.size),
ends AS (SELECT doc_id, i, max(i + size) AS past FROM hits GROUP BY doc_id, i),
c AS (SELECT u.doc_id, coalesce(max(past) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) > u.i AS hit FROM u LEFT JOIN ends ON ends.doc_id = u.doc_id AND ends.i = u.i),
t AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_hit FROM c GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS z GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id"""
)

REPEATS = (
    "WITH "
    + _words("documents", _WORDS)
    + """,
v AS (SELECT doc_id, word, i, CASE WHEN i + 34 <= len(words) THEN array_to_string(words[i:i + 34], ' ') END AS win FROM u),
x AS (SELECT doc_id, word, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS twice FROM v),
y AS (SELECT doc_id, word, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM x),
z AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN z ON z.doc_id = w.doc_id"""
)

_KIND_NAMES = "['assign', 'access', 'hex', 'login', 'opaque', 'endpoint']"


def _either_case(words: str) -> str:
    """A pattern whose ASCII letters match in either case, and no others as (?i) would."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _matches(kind: int, pattern: str, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT row, {kind} AS kind, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS g FROM d"


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_PLACED = " UNION ALL ".join(
    [
        _matches(0, f"(?:{_either_case('password|passwd|secret|token|api_?key')}){_VALUE}([A-Za-z0-9+/_.=-]+)", 1),
        _matches(1, "AKIA[A-Z0-9]+"),
        _matches(2, "[0-9a-f]+"),
        _matches(3, f"(?:{_either_case('user(name)?|login|account|client_?id')}){_VALUE}[A-Za-z0-9_.@-]{{3,}}"),
        _matches(4, "[A-Za-z0-9+/]{32,}"),
        _matches(5, "(?:https?|ftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+"),
        _matches(6, r"\n[ \t\r]*\n"),
    ]
)

SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({_PLACED}),
e AS (SELECT row, kind, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM h WHERE len(m) > 0),
c AS (SELECT row, kind, m, v, sum(length(g) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM e),
s AS (SELECT row, kind, stop - length(m) AS start, stop FROM c WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 2 THEN length(m) >= 24
 WHEN 4 THEN length(m) <= 128 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END),
w AS (SELECT *, count(*) FILTER (WHERE kind = 6) OVER o AS scope, coalesce(max(stop) FILTER (WHERE kind < 3) OVER o, -1) >= stop AS inside FROM s WINDOW o AS (PARTITION BY row ORDER BY start)),
p AS (SELECT row, kind, start, stop, scope, CASE WHEN kind IN (1, 3) THEN 'identifier' WHEN kind = 5 THEN 'endpoint' ELSE 'secret' END AS role FROM w WHERE kind < 3 OR (kind < 6 AND NOT inside)),
l AS (SELECT DISTINCT x.* FROM p AS x JOIN p AS y ON x.row = y.row AND x.scope = y.scope AND x.role <> y.role AND (y.start - x.stop BETWEEN 0 AND 200 OR x.start - y.stop BETWEEN 0 AND 200) WHERE x.role <> 'endpoint' AND y.role <> 'endpoint'),
t AS (SELECT row, kind, start, stop FROM l WHERE kind >= 3 UNION SELECT x.row, x.kind, x.start, x.stop FROM p AS x JOIN l AS y ON x.row = y.row AND x.scope = y.scope AND (y.start - x.stop BETWEEN 0 AND 200 OR x.start - y.stop BETWEEN 0 AND 200) WHERE x.role = 'endpoint'),
a AS (SELECT row, kind, start, stop FROM s WHERE kind < 3 UNION ALL SELECT * FROM t),
r AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans
 FROM (SELECT *, {_KIND_NAMES}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS name FROM a) AS z GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r ON r.row = d.row"""

# crc32: a table of the 256 bytes' remainders, then one step for each byte of a text.
_CRC_TABLE = """crc_steps(i, c, s) AS (SELECT i, i, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM crc_steps WHERE s < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE s = 8)"""


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text, where crc_table is in the FROM clause."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, len({_WORDS}) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, md5(said) AS said, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(said)) AS i FROM x),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM n, crc_table),
r AS (SELECT c.conv_id, i AS depth, said, words FROM c JOIN t ON t.conv_id = c.head AND i <= h UNION ALL
 SELECT c.conv_id, i - h + least(h, coalesce(n.n, 0)), said, words FROM c JOIN t ON t.conv_id = c.conv_id AND i > h LEFT JOIN n ON n.conv_id = c.head),
p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM c UNION ALL SELECT conv_id, depth, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM r),
z AS (SELECT conv_id, max(depth) AS size FROM p GROUP BY conv_id),
g AS (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n, max(words) AS words, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = size) AS ends FROM p JOIN z ON z.conv_id = p.conv_id GROUP BY path, depth),
k AS (SELECT path[1:32 * (depth - 1)] AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
a AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.path = g.path),
u AS (SELECT path, depth, n, words, n_children, unnest(range(depth + 1)) AS above FROM a),
s AS (SELECT path[1:32 * above] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n - 1) * words) AS BIGINT) AS saved_tokens FROM u GROUP BY 1)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves, saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN s ON s.path = a.path LEFT JOIN a AS o ON a.depth > 0 AND o.path = a.path[1:32 * (a.depth - 1)]"""

RESAMPLING = f"""WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT 0 AS corpus, row_number() OVER () AS row, doc_id, {_PLAIN} AS words FROM documents UNION ALL SELECT 1, 0, NULL, {_PLAIN} FROM benchmark),
u AS (SELECT corpus, row, words, generate_subscripts(words, 1) AS i FROM w),
f AS (SELECT corpus, row, words[i] AS feature FROM u UNION ALL SELECT corpus, row, words[i] || ' ' || words[i + 1] FROM u WHERE i < len(words)),
q AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f) AS y, crc_table),
b AS (SELECT corpus, row, bucket, count(*) AS n FROM f JOIN q ON q.feature = f.feature GROUP BY corpus, row, bucket),
t AS (SELECT coalesce(sum(n) FILTER (WHERE corpus = 0), 0) AS big_s, coalesce(sum(n) FILTER (WHERE corpus = 1), 0) AS big_t FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (WHERE corpus = 1), 0) + 1)::DOUBLE * (any_value(big_s) + 10000)::DOUBLE / ((coalesce(sum(n) FILTER (WHERE corpus = 0), 0) + 1)::DOUBLE * (any_value(big_t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b, t GROUP BY bucket),
s AS (SELECT row, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM b JOIN g ON g.bucket = b.bucket WHERE corpus = 0 GROUP BY row),
d AS (SELECT w.row, doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - (total % n + n) % n) // n ELSE 0 END AS weight,
 CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN s ON s.row = w.row WHERE corpus = 0),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS fit FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM o"""
