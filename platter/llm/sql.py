"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from platter.llm.mixing import ROUNDS, SWEEPS
from platter.llm.queries import MIX_SHARE, MIX_TARGETS
from platter.llm.secrets import BASE_KINDS, RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT word, count(*) AS c FROM q GROUP BY word),
a AS (SELECT n, k, o, ts[o] AS word FROM (SELECT n, k, string_split(k, ' ') AS ts, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT n, k FROM bw))),
r AS (SELECT n, k, o, word FROM a JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY n, k ORDER BY c, o) = 1),
c AS (SELECT DISTINCT doc_id, n, k, p - o + 1 + x AS place FROM q JOIN r USING (word), (SELECT unnest(range(-2, 3)) AS x)),
v AS (SELECT doc_id, n, k FROM (SELECT c.*, w, string_split(k, ' ') AS ts FROM c JOIN d USING (doc_id))
      WHERE len(list_filter(range(1, n + 1), lambda o: list_contains(w[greatest(1, place + o - 3):greatest(0, place + o + 1)], ts[o]))) = n),
z AS (SELECT DISTINCT doc_id, item_id FROM v JOIN bw USING (n, k) EXCEPT SELECT doc_id, item_id FROM m),
y AS (SELECT doc_id, count(*) AS n_near_items, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM z GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0)::BIGINT AS n_near_items, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN y USING (doc_id)
"""



def _secrets() -> str:
    """Matches are placed by the lengths of matches and of the gaps between them."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        least = f"length(regexp_extract(h[i], '{pattern}', 2)) >= {rule.least}" if rule.least else "true"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, p AS b, p + length(h[i]) AS e FROM (
  SELECT doc_id, h, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS p
  FROM (SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM d))) WHERE {least}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    shown = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
t AS (SELECT doc_id, {counts}, {shown} FILTER (kind IN ({base})) AS base, {shown} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)"""


#: Pairs are looked for among the rarest words of each line, as many as any match must share one of.
LINE_DEDUP = """
WITH l AS (SELECT doc_id, i - 1 AS line_no, s[i] AS line, trim(lower(s[i]), ' ') AS low
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
e AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY doc_id, line_no) AS nth FROM l WHERE regexp_matches(low, '[^ \t-\r]')),
f AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, list_distinct(list_filter(string_split_regex(low, '[ \t-\r]+'), lambda w: w <> '')) AS ws
      FROM e WHERE nth = 1),
t AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM f),
q AS (SELECT w, count(*) AS c FROM t GROUP BY w),
p AS (SELECT id, n, w FROM (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM t JOIN q USING (w)) WHERE r <= n - (n * 80 + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80),
v AS (SELECT DISTINCT c.a FROM c JOIN f x ON x.id = c.a JOIN f y ON y.id = c.b
      WHERE len(list_intersect(x.ws, y.ws)) * 180 >= (len(x.ws) + len(y.ws)) * 80),
r AS (SELECT doc_id, line_no FROM e WHERE nth > 1 UNION ALL SELECT doc_id, line_no FROM f JOIN v ON v.a = f.id),
g AS (SELECT l.doc_id, count(*) AS n_lines, count(r.line_no) AS n_removed,
             string_agg(r.line_no::VARCHAR, ',' ORDER BY l.line_no) AS removed, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (r.line_no IS NULL) AS kept
      FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed_lines,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""


_DAY = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (day) DAY"

URL_FILTER = f"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ((page_id * 7919) % 8760) HOUR AS fetched,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                  string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1), '/') AS parts FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
n AS (SELECT host AS entry FROM h UNION SELECT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM h UNION SELECT host || '/en' FROM h UNION SELECT host || '/fr' FROM h),
e AS (SELECT list, entry, md5(list || ':' || entry) AS digest FROM n, (VALUES ('blocked'), ('exempt')) l(list) WHERE entry <> ''),
x AS (SELECT list, entry, ('0x' || digest[1])::INT AS pick, ('0x' || digest[2:3])::INT % 180 AS a, ('0x' || digest[4:5])::INT AS b, ('0x' || digest[6:7])::INT AS c FROM e),
y AS (SELECT * FROM x WHERE pick < 6 OR list = 'blocked' AND pick < 12),
log AS (SELECT list, entry, action, {_DAY} AS fetched FROM (
  SELECT list, entry, 'add' AS action, a AS day FROM y UNION ALL SELECT list, entry, 'remove', a + b FROM y UNION ALL SELECT list, entry, 'add', a + b + c FROM y WHERE c < 128)),
k AS (SELECT page_id, fetched, -i AS rank, host || '/' || array_to_string(parts[1:i], '/') AS key FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c) WHERE host <> '' AND parts[i] <> ''
      UNION ALL
      SELECT page_id, fetched, i, array_to_string(labels[i + 1:], '.') FROM (SELECT *, unnest(range(0, len(labels))) AS i FROM (SELECT *, string_split(host, '.') AS labels FROM c)) WHERE host <> '' AND len(labels) - i >= 2),
s AS (SELECT page_id, rank, list, entry, max((log.fetched, action)) AS last FROM k JOIN log ON log.entry = k.key AND log.fetched <= k.fetched GROUP BY ALL),
turns AS (SELECT *, lag(action) OVER (PARTITION BY list, entry ORDER BY fetched, action) AS before FROM log),
active AS (SELECT page_id, rank, s.list, s.entry, (SELECT max(t.fetched) FROM turns t WHERE t.list = s.list AND t.entry = s.entry AND t.action = 'add' AND t.before IS DISTINCT FROM 'add' AND t.fetched <= s.last[1]) AS since
           FROM s WHERE s.last[2] = 'add'),
best AS (SELECT page_id, list, entry, since FROM active QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, list) = 1)
SELECT c.page_id, c.url, c.fetched AS fetched_at, coalesce(best.list = 'blocked', false) AS blocked, best.list, best.entry, best.since FROM c LEFT JOIN best USING (page_id)
"""


def _mixing() -> str:
    """Every sweep and round written out, each over the one before."""
    total = "sum(tokens) OVER ()"
    cells = f"SELECT *, tokens / {total} AS weight FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)"
    goal = {x: f"SELECT {x}, raw / sum(raw) OVER () AS goal_{x} FROM (SELECT {x}, CASE WHEN sum(tokens) > 0 THEN sum(tokens) ** {power} ELSE 0 END AS raw FROM cells GROUP BY {x})" for x, power in MIX_TARGETS.items()}
    raked = "SELECT cells.*, " + ", ".join(f"goal_{x}" for x in MIX_TARGETS) + " FROM cells " + " ".join(f"JOIN g_{x} ON g_{x}.{x} IS NOT DISTINCT FROM cells.{x}" for x in MIX_TARGETS)
    for _ in range(SWEEPS):
        for x in MIX_TARGETS:
            raked = f"SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {x}) > 0 THEN weight * goal_{x} / sum(weight) OVER (PARTITION BY {x}) ELSE 0 END AS weight) FROM ({raked})"
    solved = f"SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio, {MIX_SHARE} * {total} AS factor FROM raked"
    for _ in range(ROUNDS):
        rest = "sum(ratio * tokens) FILTER (ratio * factor < 1) OVER ()"
        solved = f"SELECT * REPLACE (CASE WHEN {rest} > 0 THEN ({MIX_SHARE} * {total} - coalesce(sum(tokens) FILTER (ratio * factor >= 1) OVER (), 0)) / ({rest}) ELSE factor END AS factor) FROM ({solved})"
    goals = ", ".join(f"g_{x} AS MATERIALIZED ({g})" for x, g in goal.items())
    return f"""WITH t AS (SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')) AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, text, source, lang, n_tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'prose' ELSE 'long' END AS topic FROM t),
cells AS MATERIALIZED ({cells}), {goals}, raked AS MATERIALIZED ({raked}), p AS MATERIALIZED (SELECT source, lang, topic, least(1.0, ratio * factor) AS p FROM ({solved}))
SELECT d.doc_id, d.source, d.lang, d.topic, n_tokens::BIGINT AS n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, d.text, '')), 1, 12))::BIGINT / (2.0 ** 48) < p AS kept
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic"""


ORACLES: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op6_url_filter": URL_FILTER,
    "op7_decontamination": DECONTAMINATION,
    "op9_mixing": _mixing(),
    "op10_secrets": _secrets(),
}
