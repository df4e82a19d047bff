"""The queries again, as SQL that DuckDB runs over the same tables.

DuckDB's arg_max passes null values over, so newest versions come from row_number()."""

from __future__ import annotations

from .fixtures import BLOCK, EXACT_BYTES, SEGMENT_BYTES, SPLIT

LOG = """SELECT event_id AS seq, 'user:' || user_id AS key,
  CASE WHEN event_type <> 'error' THEN event_type || '|' || CAST(round(value * 100) AS BIGINT) END AS value FROM events"""
SIZE = "strlen(key) + coalesce(strlen(value), 0)"
SEGMENTS = f"""SELECT *, CAST(floor((sum(bytes) OVER (ORDER BY seq) - bytes) / {SEGMENT_BYTES}) AS BIGINT) AS segment
  FROM (SELECT *, CAST({SIZE} AS BIGINT) AS bytes FROM log)"""


def newest(table: str, by: str, order: str = "seq", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order} DESC) AS rn FROM {table}) WHERE rn = 1"


RUNS = newest("segments", "segment, key", columns="segment AS run, key, seq, value")
BASE = f"WITH RECURSIVE log AS ({LOG}), segments AS ({SEGMENTS}), runs AS ({RUNS})"
STATE = f"SELECT key, value FROM ({newest('log', 'key')}) WHERE value IS NOT NULL"
PROBES = "SELECT DISTINCT key FROM (SELECT key FROM log UNION ALL SELECT 'none:' || key FROM log)"


def packing(source: str, limit: int) -> str:
    """Greedy blocks: a recursive walk over the records of each run in key order."""
    return f"""sized AS (SELECT run, key, value, {SIZE} + 8 AS size, row_number() OVER (PARTITION BY run ORDER BY key) AS pos FROM ({source})),
 walk AS (SELECT run, key, size, pos, 0 AS block, size AS used FROM sized WHERE pos = 1
  UNION ALL SELECT s.run, s.key, s.size, s.pos, CASE WHEN w.used + s.size > {limit} THEN w.block + 1 ELSE w.block END,
   CASE WHEN w.used + s.size > {limit} THEN s.size ELSE w.used + s.size END FROM walk w JOIN sized s ON s.run = w.run AND s.pos = w.pos + 1)"""


def left_runs(groups: str) -> str:
    """What compaction leaves: ``groups`` says which run each one is merged into; deletes of the first one go.  Fewer
    than four runs stay as they are."""
    return f"""merged AS ({newest(f"(SELECT key, value, run AS old, CASE WHEN {DUE} THEN {groups} ELSE run END AS run FROM runs)", "run, key", "old", "run, key, value")})
 SELECT run, key, value FROM merged WHERE value IS NOT NULL OR NOT {DUE} OR run > (SELECT min(run) FROM merged)"""


DUE = "(SELECT count(DISTINCT run) >= 4 FROM runs)"
#: Runs that oldest-first rounds of four merge into one: all but the last (n - 1) mod 3.
MERGED = "(SELECT count(DISTINCT run) - (count(DISTINCT run) - 1) % 3 FROM runs)"
#: Segments by the size of the memtable: a walk over the log that keeps each table's lengths.
EXACT = f"""places AS (SELECT seq, key, strlen(key) AS k, coalesce(strlen(value), 0) AS v, row_number() OVER (ORDER BY seq) AS pos FROM log),
 walk AS (SELECT pos, CAST(0 AS BIGINT) AS segment, k + v >= {EXACT_BYTES} AS full, k + v AS size, CASE WHEN k + v >= {EXACT_BYTES} THEN MAP {{}}::MAP(VARCHAR, BIGINT) ELSE MAP([key], [v]) END AS held FROM places WHERE pos = 1
  UNION ALL SELECT pos, segment, size >= {EXACT_BYTES}, CASE WHEN size >= {EXACT_BYTES} THEN 0 ELSE size END, CASE WHEN size >= {EXACT_BYTES} THEN MAP {{}}::MAP(VARCHAR, BIGINT) ELSE held END FROM
   (SELECT p.pos, w.segment + CASE WHEN w.full THEN 1 ELSE 0 END AS segment, w.size * CASE WHEN w.full THEN 0 ELSE 1 END + p.v + coalesce(-w.held[p.key], p.k) AS size,
     map_concat(w.held, MAP([p.key], [CAST(p.v AS BIGINT)])) AS held FROM walk w JOIN places p ON p.pos = w.pos + 1))"""
FILED = f"filed AS (SELECT *, CAST(sum(size) OVER (ORDER BY key) - size AS BIGINT) // ({SPLIT} - (SELECT max(size) FROM sized)) AS file FROM sized)"
INDEX = "SELECT run, CAST(block AS BIGINT) AS block, max(key) AS last_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM walk GROUP BY run, block"


def crc_of(values: str) -> str:
    """CRC-32 of a list of byte values."""
    step = "lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(x AS BIGINT) FOR x IN range(8)]), {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), {byte}), 4294967295)"


def ascii_bytes(text: str) -> str:
    return f"[CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '') IF x <> '']"


FNV = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {ascii_bytes('key')}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
CUSTOMERS = "SELECT 'cust:' || c_custkey AS key FROM customer"
HASHES = f"SELECT key, {FNV} AS h1, {crc_of(ascii_bytes('key'))} | 1 AS h2 FROM"
BITS = "CAST(ceil(floor(-greatest(n, 1) * ln(0.01) / (ln(2) * ln(2))) / 8) * 8 AS BIGINT)"
PARAMS = f"SELECT n, {BITS} AS bits, CAST(least(greatest(floor({BITS} / n * ln(2)), 1), 10) AS INTEGER) AS hashes FROM"
FILTER = f"""WITH keys AS ({CUSTOMERS}), p AS ({PARAMS} (SELECT count(*) AS n FROM keys)),
 asked AS (SELECT key FROM keys UNION ALL SELECT 'miss:' || range FROM range(20000)),
 bits AS (SELECT key, unnest([((h1 + i * h2) & 4294967295) % p.bits FOR i IN range(p.hashes)]) AS bit FROM ({HASHES} asked), p),
 filter AS (SELECT DISTINCT bit FROM bits WHERE key LIKE 'cust:%'),
 probed AS (SELECT b.key, min(CASE WHEN f.bit IS NULL THEN 0 ELSE 1 END) = 1 AS may_contain FROM bits b LEFT JOIN filter f ON f.bit = b.bit GROUP BY b.key)"""
LE = "[({0}) & 255, (({0}) >> 8) & 255, (({0}) >> 16) & 255, (({0}) >> 24) & 255]"
BODY = f"list_concat(list_concat({LE.format('CAST(strlen(key) AS BIGINT)')}, {LE.format('CAST(coalesce(strlen(value), 0) AS BIGINT)')}), list_concat({ascii_bytes('key')}, {ascii_bytes("coalesce(value, '')")}))"
HEX = "array_to_string([printf('%02X', x) FOR x IN {0}], '')"
SEGMENT_FILE = "CASE WHEN segment = 0 THEN 'active.wal' ELSE 'active-' || segment || '.wal' END"

SQL: dict[str, str] = {
    "live_state": f"WITH log AS ({LOG}) {STATE}",
    "live_orders": f"""WITH log AS (SELECT o_orderkey AS seq, 'cust:' || o_custkey AS key,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS value FROM orders) {STATE}""",
    "put_log": LOG,
    "validate_records": """WITH rows AS (SELECT 'doc:' || doc_id AS key, text AS value FROM documents
  UNION ALL SELECT repeat(url, 3), CASE WHEN page_id % 5 = 0 THEN '' ELSE 'x' END FROM pages)
 SELECT CASE WHEN strlen(key) > 128 THEN 'key_too_large' WHEN strlen(value) > 4096 THEN 'value_too_large' WHEN strlen(value) = 0 THEN 'empty_value' ELSE 'ok' END AS status,
  count(*) AS n FROM rows GROUP BY 1""",
    "get_point": f"WITH log AS ({LOG}) SELECT * FROM ({STATE}) WHERE key = 'user:7'",
    "get_miss": f"WITH log AS ({LOG}) SELECT * FROM ({STATE}) WHERE key = 'user:none'",
    "multi_get": f"WITH log AS ({LOG}) SELECT p.key, s.value, s.value IS NOT NULL AS found FROM ({PROBES}) p LEFT JOIN ({STATE}) s ON s.key = p.key",
    "deleted_keys": f"WITH log AS ({LOG}) SELECT key FROM ({newest('log', 'key')}) WHERE value IS NULL",
    "live_count": f"{BASE} SELECT run AS segment, count(value) AS live, count(*) - count(value) AS tombstones FROM runs GROUP BY run",
    "memtable_size": f"{BASE} SELECT run AS segment, CAST(sum({SIZE}) AS BIGINT) AS bytes, count(*) AS keys FROM runs GROUP BY run",
    "rotate_segments": f"{BASE} SELECT seq, segment, bytes FROM segments",
    "rotate_exact": f"WITH RECURSIVE log AS ({LOG}), {EXACT} SELECT w.segment, count(*) AS n, min(p.seq) AS first_seq, max(p.seq) AS last_seq FROM walk w JOIN places p USING (pos) GROUP BY w.segment",
    "memtable_state": f"{BASE} SELECT run AS segment, key, seq, value FROM runs",
    "flush_runs": f"{BASE} SELECT run, key, seq, value FROM runs",
    "run_stats": f"{BASE} SELECT run, count(*) AS n, count(*) - count(value) AS n_tombstones, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq FROM runs GROUP BY run",
    "manifest_order": f"{BASE} SELECT row_number() OVER (ORDER BY max_seq) - 1 AS ord, run, max_seq FROM (SELECT run, max(seq) AS max_seq FROM runs GROUP BY run)",
    "layered_get": f"{BASE} SELECT s.key, s.value, CAST(r.run AS BIGINT) AS run FROM ({STATE}) s JOIN (SELECT key, max(run) AS run FROM runs GROUP BY key) r USING (key)",
    "run_get": f"{BASE} SELECT key, value FROM runs WHERE run = 1 AND key = 'user:7'",
    "merge_runs": f"{BASE} {newest('runs', 'key', 'run', 'key, run, value')}",
    "compact_oldest4": f"{BASE} SELECT key, run, value FROM ({newest('(SELECT * FROM runs WHERE run < 4)', 'key', 'run')}) WHERE value IS NOT NULL",
    "compact_after_state": f"{BASE}, {left_runs('CASE WHEN run < 4 THEN 3 ELSE run END')}",
    "compact_fixpoint": f"{BASE}, {left_runs(f'CASE WHEN run < {MERGED} THEN {MERGED} - 1 ELSE run END')}",
    "block_index": f"{BASE}, {packing('SELECT * FROM runs', BLOCK)} {INDEX}",
    "compact_split": f"""{BASE}, sized AS (SELECT key, {SIZE} + 8 AS size FROM ({newest('(SELECT * FROM runs WHERE run < 4)', 'key', 'run')}) WHERE value IS NOT NULL), {FILED}
 SELECT file, min(key) AS min_key, max(key) AS max_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM filed GROUP BY file""",
    "split_files": f"""WITH log AS ({LOG}), sized AS (SELECT key, {SIZE} + 8 AS size FROM ({STATE})), {FILED}
 SELECT file, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS min_key FROM filed GROUP BY file""",
    "find_block": f"""{BASE}, {packing('SELECT * FROM runs', BLOCK)}, idx AS ({INDEX})
 SELECT r.run, p.key, coalesce((SELECT min(i.block) FROM idx i WHERE i.run = r.run AND i.last_key >= p.key), -1) AS block FROM ({PROBES}) p, (SELECT DISTINCT run FROM runs) r""",
    "bloom_params": f"{BASE} {PARAMS} (SELECT count(*) AS n FROM customer UNION ALL SELECT count(*) FROM runs GROUP BY run)",
    "bloom_hashes": f"{HASHES} ({CUSTOMERS})",
    "bloom_build": f"{FILTER} SELECT bit FROM filter",
    "bloom_probe": f"{FILTER} SELECT key, may_contain FROM probed",
    "bloom_fpr": f"""{FILTER} SELECT count(*) FILTER (key LIKE 'cust:%' AND NOT may_contain) AS false_negatives,
  count(*) FILTER (key LIKE 'miss:%' AND may_contain) AS false_positives, count(*) FILTER (key LIKE 'miss:%') AS absent FROM probed""",
    "ordered_scan": f"WITH log AS ({LOG}) SELECT key, value, row_number() OVER (ORDER BY key) AS rank FROM ({STATE})",
    "wal_segment_order": f"{BASE} SELECT DISTINCT {SEGMENT_FILE} AS name, segment AS ts FROM segments",
    "recover_segments": f"""{BASE} SELECT {SEGMENT_FILE} AS name, s.key, s.value FROM ({newest('segments', 'key')}) s WHERE s.value IS NOT NULL""",
    "wal_encode": f"WITH log AS ({LOG}) SELECT seq, {HEX.format(LE.format(crc_of('body')))} || {HEX.format('body')} AS record FROM (SELECT seq, {BODY} AS body FROM log)",
    "wal_replay": f"{BASE} SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY seq) - 1 AS pos, key, value FROM segments",
    "wal_replay_stats": f"{BASE} SELECT segment, count(*) - 1 AS recovered, CAST(1 AS BIGINT) AS skipped FROM segments GROUP BY segment",
    "block_crc": f"""{BASE}, {packing('SELECT * FROM runs', BLOCK)}, parts AS (SELECT w.run, w.block, w.pos, {BODY} AS body FROM walk w JOIN sized USING (run, key))
 SELECT run, CAST(block AS BIGINT) AS block, {crc_of('flatten(list(body ORDER BY pos))')} AS crc, count(*) AS n FROM parts GROUP BY run, block""",
    "sst_codec": f"{BASE} SELECT run, key, value FROM runs",
}
