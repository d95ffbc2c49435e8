"""DuckDB SQL for the registered queries, computed from the tables' rows alone."""

from __future__ import annotations

from platter import layout as L


def cells(size: int) -> str:
    """Sectors of all documents: doc_id, lba and hexadecimal digits, the last filled up with zeros."""
    digits = 2 * size
    piece = f"substr(h, CAST(lba * {digits} + 1 AS BIGINT), {digits})"
    return f"""docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    numbered AS (SELECT doc_id, h, unnest(range(CAST(ceil(length(h) / {digits}.0) AS BIGINT))) AS lba FROM docs),
    sectors AS (SELECT doc_id, lba, rpad({piece}, {digits}, '0') AS s FROM numbered)"""


def _runs(column: str, runs, result: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} BETWEEN {r[0]} AND {r[1]} THEN {result.format(*r)}" for r in runs) + f" ELSE {other} END"


def _reflected(column: str, poly: int, seed: int, final: int, digits: int) -> str:
    """A bitwise CRC of a string's bytes as a fold over lists."""
    bits = "list_reduce(list_prepend(xor(acc, byte), CAST(range(8) AS UBIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST({p} AS UBIGINT)) ELSE c >> 1 END)".replace("{p}", str(poly))
    found = f"list_transform(range(CAST(strlen({column}) AS BIGINT)), lambda k: CAST(concat('0x', substr(hex(encode({column})), CAST(2 * k + 1 AS BIGINT), 2)) AS UBIGINT))"
    return f"upper(lpad(to_hex(xor(list_reduce(list_prepend(CAST({seed} AS UBIGINT), {found}), lambda acc, byte: {bits}), CAST({final} AS UBIGINT))), {digits}, '0'))"


ONES = 0xFFFFFFFFFFFFFFFF
SHA = "sha256(unhex(s))"
TEXT = "coalesce(text, '')"
PIECES = "CAST(ceil(strlen(coalesce(text, '')) / 512.0) AS BIGINT)"
TURNS = "turns AS (SELECT conv_id, turn, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 2048.0) AS BIGINT)) AS n, rpad(substr(hex(encode(coalesce(text, ''))), 1, 4096), 4096, '0') AS first FROM conversations)"
EXTENTS = """extents AS (SELECT c_custkey, 0 AS position, CAST(c_custkey % 7 + x AS BIGINT) AS first_lba, CAST(c_custkey % 7 + x + 10 AS BIGINT) AS last_lba FROM customer, (VALUES (0), (20)) AS v(x)
    UNION ALL SELECT c_custkey, 1, 100, 200 FROM customer)"""
ROUND_TRIP = f"SELECT doc_id, sha256({TEXT}) AS sha256 FROM documents"
MSF = "lpad(CAST((lba + 150) // 4500 AS VARCHAR), 2, '0') || lpad(CAST((lba + 150) // 75 % 60 AS VARCHAR), 2, '0') || lpad(CAST((lba + 150) % 75 AS VARCHAR), 2, '0')"

ORACLES: dict[str, str] = {
    "identify": "SELECT 'image' AS kind, doc_id AS id, 100 AS confidence FROM documents UNION ALL SELECT 'page', page_id, 0 FROM pages",
    "image_info": f"SELECT doc_id, 0 AS status, 'platter' AS application, CAST(2 AS BIGINT) AS media_type, 'block media' AS media_class, {PIECES} AS sectors, CAST(CASE WHEN {TEXT} = '' THEN 0 ELSE 512 END AS BIGINT) AS sector_size, {PIECES} // 16 // 63 AS cylinders, CAST(16 AS BIGINT) AS heads, CAST(63 AS BIGINT) AS sectors_per_track FROM documents",
    "image_index": f"WITH {cells(512)} SELECT doc_id, CAST(ceil(count(DISTINCT s) / 32.0) AS BIGINT) AS data_blocks, CAST(1 AS BIGINT) AS tables FROM documents LEFT JOIN sectors USING (doc_id) GROUP BY doc_id",
    "blocks": f"WITH {cells(512)} SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS compression, CAST(ceil(count(DISTINCT s) / 32.0) AS BIGINT) AS blocks, CAST(512 * count(DISTINCT s) AS BIGINT) AS bytes, true AS intact FROM sectors GROUP BY doc_id",
    "ddt_dedup": f"WITH {cells(512)} SELECT doc_id, count(*) AS sectors, count(DISTINCT s) AS distinct_sectors FROM sectors GROUP BY doc_id",
    "read_sector": f"WITH {cells(512)} SELECT doc_id, lba, 0 AS status, {SHA} AS sha256 FROM sectors",
    "read_sector_point": f"WITH {cells(512)} SELECT doc_id, a.lba, CASE WHEN s IS NULL THEN -5 ELSE 0 END AS status, s AS data FROM (SELECT doc_id, CAST(x AS BIGINT) AS lba FROM documents, (VALUES (0), (1000000000)) AS v(x)) a LEFT JOIN sectors USING (doc_id, lba)",
    "not_dumped": f"WITH {cells(512)}, held AS (SELECT doc_id, lba, CASE WHEN lba % 3 = 2 THEN repeat('0', 1024) ELSE s END AS s FROM sectors) SELECT doc_id, lba, CAST(lba % 3 = 2 AS INTEGER) AS status, {SHA} AS sha256 FROM held",
    "read_track_sector": f"WITH {TURNS} SELECT conv_id, CAST(turn + 1 AS INTEGER) AS track, 0 AS status, sha256(unhex(first)) AS sha256 FROM turns UNION ALL SELECT DISTINCT conv_id, 99, -13, NULL FROM conversations",
    "track_range_join": f"WITH {TURNS} SELECT conv_id, CAST(turn + 1 AS INTEGER) AS track, n AS sectors FROM turns",
    "read_sector_long_tags": f"WITH {cells(512)} SELECT doc_id, lba, 0 AS status, sha256(unhex(s || hex(encode(lpad(CAST(lba AS VARCHAR), 12, '0'))))) AS sha256 FROM sectors",
    "read_sector_long_cd": f"WITH {cells(2048)} SELECT doc_id, lba, 0 AS status, CAST(2352 AS BIGINT) AS bytes, '00' || repeat('FF', 10) || '00' || {MSF} || '01' AS prefix, {SHA} AS user_sha256 FROM sectors",
    "read_media_tag": f"SELECT doc_id, CAST(t AS INTEGER) AS tag_type, CASE WHEN t = 30 THEN -11 ELSE 0 END AS status, CASE t WHEN 0 THEN sha256({TEXT}) WHEN 68 THEN sha256('end') END AS sha256, CASE t WHEN 30 THEN NULL WHEN 68 THEN CAST(3 AS BIGINT) ELSE CAST(strlen({TEXT}) AS BIGINT) END AS bytes FROM documents, (VALUES (0), (7), (68), (30)) AS v(t)",
    "metadata_strings": "SELECT s_suppkey, s_name AS creator, s_name || ' / title' AS media_title, 'model' AS drive_model, CAST(NULL AS VARCHAR) AS comments FROM supplier",
    "sidecars": "SELECT s_suppkey, s_name AS name FROM supplier",
    "stored_checksums": "SELECT s_suppkey, a AS algorithm, d AS digest FROM supplier, (VALUES ('md5', repeat('0', 32)), ('spamsum', '3:a:b')) AS v(a, d)",
    "dump_hardware": "SELECT c_custkey, 0 AS position, 'maker' AS manufacturer, c_name AS model, CAST(c_custkey AS VARCHAR) AS serial, CAST(2 AS BIGINT) AS extents FROM customer UNION ALL SELECT c_custkey, 1, 'other', c_mktsegment, NULL, 1 FROM customer",
    "extents_explode": f"WITH {EXTENTS} SELECT c_custkey, position, first_lba, last_lba FROM extents",
    "extent_gaps": f"WITH {EXTENTS}, g AS (SELECT c_custkey, first_lba, first_lba - coalesce(max(last_lba) OVER (PARTITION BY c_custkey ORDER BY first_lba, last_lba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS gap FROM extents) SELECT * FROM g WHERE gap > 0",
    "crc64": f"SELECT p_partkey, {_reflected('p_name', 0xC96C5795D7870F42, ONES, ONES, 16)} AS crc64 FROM part",
    "edc": f"SELECT p_partkey, {_reflected('p_name', 0xD8018001, 0, 0, 8)} AS edc FROM part",
    "cst_transform": "WITH p AS (SELECT p_partkey, hex(encode(substr(rpad(p_name, 32, ' '), 1, 32))) AS h FROM part) SELECT p_partkey, upper(lpad(to_hex(CAST(list_sum(list_transform(range(32), lambda k: CASE WHEN substr(h, CAST(2 * k + 1 AS BIGINT), 1) >= '8' THEN CAST(1 AS BIGINT) << (31 - k) ELSE 0 END)) AS BIGINT)), 8, '0')) AS plane FROM p",
    "cst_roundtrip": ROUND_TRIP,
    "lzma_roundtrip": ROUND_TRIP,
    "flac_roundtrip": ROUND_TRIP,
    "digests": f"SELECT doc_id, md5({TEXT}) AS md5, sha1({TEXT}) AS sha1, sha256({TEXT}) AS sha256 FROM documents",
    "crc32": f"SELECT p_partkey, CAST(concat('0x', {_reflected('p_name', 0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF, 8)}) AS BIGINT) AS crc32 FROM part",
    "msf": "SELECT o_orderkey, (o_orderkey + 150) // 4500 AS minute, (o_orderkey + 150) // 75 % 60 AS second, (o_orderkey + 150) % 75 AS frame, (o_orderkey + 150) % 75 // 10 * 16 + (o_orderkey + 150) % 75 % 10 AS frame_bcd FROM orders",
    "filetime": "SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 116444736000000000 AS ticks, epoch_us(o_orderdate) AS micros FROM orders",
    "media_type_map": f"SELECT p_partkey, {_runs('p_partkey % 760', L.OPTICAL_RUNS, repr('optical disc'), repr('block media'))} AS media_class FROM part",
    "data_type_map": f"SELECT p_partkey, CAST({_runs('p_partkey % 85', L.TAG_RUNS, 'p_partkey % 85 - {0} + {2}', '-1')} AS INTEGER) AS tag_type FROM part",
    "hexdump": "WITH p AS (SELECT p_partkey, p_name, unnest(range(0, CAST(strlen(p_name) AS BIGINT), 16)) AS k FROM part) SELECT p_partkey, lower(lpad(to_hex(k), 8, '0')) AS \"offset\", trim(regexp_replace(hex(encode(substr(p_name, k + 1, 16))), '(..)', '\\1 ', 'g')) AS bytes, substr(p_name, k + 1, 16) AS shown FROM p",
    "verify_image": f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND {TEXT} <> '' THEN -18 ELSE 0 END AS status, CAST(doc_id % 10 = 0 AND {TEXT} <> '' AS BIGINT) AS failed, CAST(0 AS BIGINT) AS hardware_failed FROM documents",
    "verify_sectors": f"SELECT doc_id, CAST(ceil(strlen({TEXT}) / 2048.0) AS BIGINT) AS sectors, CAST(doc_id % 10 = 0 AND {TEXT} <> '' AS BIGINT) AS errors, CAST(0 AS BIGINT) AS unknown, CAST(0 AS BIGINT) AS unreadable FROM documents",
    "duplicate_sectors": f"WITH {cells(512)} SELECT {SHA} AS sha256, count(*) AS copies, count(DISTINCT doc_id) AS images FROM sectors GROUP BY s HAVING count(*) > 1",
    "size_rollup": f"SELECT lang, source, CAST(sum({PIECES}) AS BIGINT) AS sectors, max({PIECES}) AS largest FROM documents GROUP BY ROLLUP (lang, source)",
    "size_rank": f"SELECT doc_id, source, {PIECES} AS sectors, CAST(rank() OVER (PARTITION BY source ORDER BY {PIECES} DESC, doc_id) AS INTEGER) AS rank FROM documents",
    "uncovered_sectors": f"WITH {TURNS}, ranked AS (SELECT conv_id, n, turn FROM turns WHERE turn > 0) SELECT conv_id, CAST(sum(n) AS BIGINT) AS beyond_first_track FROM ranked GROUP BY conv_id",
    "tag_pivot": f"SELECT doc_id, CAST(strlen({TEXT}) AS BIGINT) AS tag_0, CAST(strlen({TEXT}) AS BIGINT) AS tag_7, CAST(3 AS BIGINT) AS tag_68 FROM documents",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS INTEGER) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
}
