"""Corpus queries again, as SQL that DuckDB runs over the same tables.

Whole: the near-duplicate components (op4), the repeated bytes (op3) and the quality rules (op10), by plain joins and
counts over all windows.  Of the others the part that SQL can express has a query of its own in ``queries.PARTS``, which
takes it from the operator's result."""

from __future__ import annotations

from ..plans.oracles import crc_of
from .licenses import PHRASES
from .url_rules import LIST_RULES

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"

QUALITY = rf"""WITH {DOCS},
 listed AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
 words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM listed),
 triples AS (SELECT rid, pos, w, lead(w) OVER here AS w2, lead(w, 2) OVER here AS w3 FROM words WINDOW here AS (PARTITION BY rid ORDER BY pos)),
 counted AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL),
 repeated AS (SELECT rid, count(DISTINCT pos + k) AS n FROM counted, range(3) AS x(k) WHERE n > 1 GROUP BY rid),
 stats AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM listed LEFT JOIN repeated r USING (rid)),
 judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
   OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters) AS kept FROM judged"""

COMPONENTS = rf"""WITH RECURSIVE listed AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
 shingles AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] FOR i IN range(1, len(ws) - 3)]) END AS held FROM listed),
 members AS MATERIALIZED (SELECT doc_id, hash(s) AS h, s FROM (SELECT doc_id, unnest(held) AS s FROM shingles)),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.h = b.h AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM common JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.held) + len(y.held) - n)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b)
 SELECT s.doc_id, len(s.held) AS n_shingles, min(r.b) AS component_id FROM shingles s JOIN reach r ON r.a = s.doc_id GROUP BY ALL"""

REPEATS = """WITH texts AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
 windows AS MATERIALIZED (SELECT doc_id, CAST(p AS INTEGER) AS p, hash(substr(h, 2 * p + 1, 100)) AS k FROM texts, unnest(range(greatest(CAST(length(h) // 2 - 49 AS BIGINT), 0))) AS x(p)),
 several AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k) JOIN texts USING (doc_id)),
 gone AS (SELECT doc_id, p FROM several JOIN (SELECT w, min(doc_id) AS least FROM several GROUP BY w) USING (w) WHERE least < doc_id),
 opened AS (SELECT *, CASE WHEN p <= lag(p) OVER here + 50 THEN 0 ELSE 1 END AS opens FROM gone WINDOW here AS (PARTITION BY doc_id ORDER BY p)),
 spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opened) GROUP BY doc_id, run),
 kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
   FROM (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans) JOIN texts USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
   sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)"""

URLS = f"""WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 named AS (SELECT row_number() OVER () AS rid, page_id, {LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split),
 rules(h, p, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in LIST_RULES)}),
 fits AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h || p DESC) AS place
   FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
 SELECT page_id, host, path, rule, verdict AS listed FROM named LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (rid)"""

PAYLOADS = f"""WITH texts AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS h FROM documents),
 padded AS (SELECT doc_id, n, CAST(greatest(1, (n + 575) // 576) * 576 AS BIGINT) AS m, h || repeat('FF', CAST(greatest(1, (n + 575) // 576) * 576 - n AS BIGINT)) AS p FROM texts)
 SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
   {crc_of("[16 * (instr('0123456789ABCDEF', substr(p, 2 * (m - 32 + i) + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(p, 2 * (m - 32 + i) + 2, 1)) - 1 FOR i IN range(32)]")} AS tail_crc32 FROM padded"""

_AHEAD = max(len(p.split()) for p, _ in PHRASES)
PHRASE_PLACES = rf"""WITH {DOCS}, listed AS (SELECT rid, doc_id, regexp_extract_all({LOWER.format("text")}, '{ALNUM}') AS ws FROM docs),
 words AS (SELECT rid, unnest(ws) AS w0, generate_subscripts(ws, 1) - 1 AS pos FROM listed),
 runs AS (SELECT *, {", ".join(f"lead(w0, {k}) OVER here AS w{k}" for k in range(1, _AHEAD))} FROM words WINDOW here AS (PARTITION BY rid ORDER BY pos)),
 found AS ({" UNION ALL ".join(f"SELECT rid, pos, '{label}' AS label FROM runs WHERE " + " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(p.split())) for p, label in PHRASES)}),
 summed AS (SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY rid)
 SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM listed LEFT JOIN summed USING (rid)"""

TURNS = """WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learnt FROM turns GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256 FROM said"""

SQL: dict[str, str] = {
    "op3_suffix_array_dedup": REPEATS,
    "op4_ngram_jaccard_join": COMPONENTS,
    "op10_quality_rules": QUALITY,
    "url_list_rules": URLS,
    "media_payloads": PAYLOADS,
    "license_phrases": PHRASE_PLACES,
    "chat_turns_read_back": TURNS,
}
