"""DuckDB SQL for the document queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from flowlens.llm.filter_audit import FILTERS, Filters
from flowlens.llm.quality import BOILERPLATE, CLOSERS, MARKS, UNMARKED, WIDE_MARKS, Rules
from flowlens.llm.resample import Resampling
from flowlens.llm.sharding import JUMP_FACTOR, SHARDS
from flowlens.llm.vecdup import Vectors

WORD = r"[^\x20\x09-\x0D]+"


def _escaped(char: str) -> str:
    return rf"\x{{{ord(char):X}}}"


def _one_of(chars: str) -> str:
    return f"[{''.join(map(_escaped, chars))}]"


def quality() -> str:
    rules = Rules()
    boilerplate = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
    marks, wide, closers = (_one_of(chars) for chars in (MARKS + WIDE_MARKS, WIDE_MARKS, CLOSERS))
    running = rf"{marks}{closers}*([\x20\x09-\x0D]|$)|{wide}|[{'-'.join(map(_escaped, UNMARKED))}]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
often AS (SELECT r, i FROM grams WHERE i >= 1 QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM often, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
held AS (SELECT r, line, regexp_extract_all(line, '{WORD}') AS ws FROM lines WHERE regexp_matches(line, '{WORD}')),
sized AS (SELECT *, list_sum(list_transform(ws, lambda x: length(x))) AS chars,
  len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '!')) AS shouts,
  len(regexp_extract_all(line, '[A-Z]')) AS capitals, len(regexp_extract_all(line, '[a-z]')) AS smalls FROM held),
judged AS (SELECT *, NOT regexp_matches(line, '{running}') OR 100 * symbols > {rules.symbol_percent} * chars
  OR (shouts >= 3 AND capitals > smalls) OR len(list_filter(ws, lambda x: x IN ('|', '>', '<'))) >= 2
  OR {boilerplate} AS bad FROM sized),
per_doc AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) AS n_lines, count_if(bad) AS n_bad,
  coalesce(sum(chars) FILTER (bad), 0) AS lost FROM judged GROUP BY r),
counts AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM w),
joined AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM counts LEFT JOIN per_doc USING (r) LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM joined)
SELECT *, NOT base_failed AND 100 * lost_chars <= {rules.lost_percent} * word_chars AS kept FROM failed"""


def sharding() -> str:
    """Jumps by recursion; CRC-32 byte by byte, from a table of eight shifts a value."""
    bits = "list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, e: xor(a >> 1, 3988292384 * (a & 1)))"
    table = f"[{bits} for i in range(256)]"
    raw = "list_concat([4294967295], [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(length(h) // 2)])"
    step = "lambda a, e: xor(a >> 8, t[xor(a, e) % 256 + 1])"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::HUGEINT AS key FROM documents),
jumps(doc_id, n, key, b, j) AS (
  SELECT DISTINCT doc_id, n, key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d, (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS n)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, (key * {JUMP_FACTOR} + 1) % 18446744073709551616 AS k FROM jumps WHERE j < n)),
shards AS (SELECT doc_id, max(b) FILTER (n = {SHARDS}) AS shard, max(b) FILTER (n = {SHARDS + 1}) AS grown FROM jumps WHERE j >= n GROUP BY doc_id),
crc AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce({raw}, {step}), 4294967295) AS text_crc32 FROM d, (SELECT {table} AS t))
SELECT c.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard
FROM crc c JOIN shards s ON c.doc_id IS NOT DISTINCT FROM s.doc_id"""


def filter_audit() -> str:
    rules = Filters()
    steps = ", ".join(f"('{''.join(p)}', {i + 1}, '{p[i]}', '{''.join(p[:i])}')" for p in permutations(FILTERS) for i in range(5))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < {rules.min_words} THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(ws)) < {rules.distinct_percent} * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {rules.capital_percent} * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN flags USING (doc_id)),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
steps(filter_order, step, filter, before) AS (VALUES {steps}),
made AS (SELECT part, filter_order, step, filter,
  coalesce(sum(n) FILTER (translate(before || filter, f, '') = before || filter), 0) AS kept,
  coalesce(sum(n) FILTER (contains(f, filter) AND translate(before, f, '') = before), 0) AS removed,
  coalesce(sum(n) FILTER (contains(f, filter) AND translate(before, f, '') <> before), 0) AS redundant,
  coalesce(sum(n) FILTER (f = filter), 0) AS unique_fails,
  coalesce(sum(good) FILTER (contains(f, filter) AND translate(before, f, '') = before), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (contains(f, filter) AND translate(before, f, '') = before), 0) AS toxic_lost
  FROM counts CROSS JOIN steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM made"""


def resampling() -> str:
    """CRC-32 of each distinct word byte by byte, as in sharding()."""
    rules = Resampling()
    b = rules.buckets
    bits = "list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, e: xor(a >> 1, 3988292384 * (a & 1)))"
    raw = "list_concat([4294967295], [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(length(h) // 2)])"
    step = "lambda a, e: xor(a >> 8, t[xor(a, e) % 256 + 1])"
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
found AS (SELECT r, unnest(ws) AS w FROM d),
target AS (SELECT unnest({words}) AS w FROM benchmark),
names AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM found UNION ALL SELECT w FROM target)),
codes AS (SELECT w, xor(list_reduce({raw}, {step}), 4294967295) % {b} AS bucket FROM names, (SELECT [{bits} for i in range(256)] AS t)),
s AS (SELECT bucket, count(*) AS n FROM found JOIN codes USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN codes USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM found) + {b})::DOUBLE)
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + {b})::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN codes USING (w) JOIN gains USING (bucket) GROUP BY r),
noise AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('{rules.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT doc_id, n_features, weight, n_features >= {rules.min_words} AS able,
  weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noise),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= (SELECT count(*) FROM scored WHERE able) * {rules.percent} // 100 THEN place END AS rank FROM ranked"""


def vectors() -> str:
    """All pairs; groups by closure."""
    rules = Vectors()
    norm = "sqrt(list_sum(list_transform(e, lambda y: y * y)))"
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, list_transform(e, lambda x: x / {norm}) AS u FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {norm} > 0),
links AS (SELECT a.r AS r, b.r AS other FROM ok a JOIN ok b ON a.r <> b.r AND len(a.u) = len(b.u)
  WHERE list_inner_product(a.u, b.u) >= {rules.cosine}),
reach(r, other) AS (SELECT r, r FROM v UNION SELECT reach.r, links.other FROM reach JOIN links ON reach.other = links.r),
named AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.other = v.r GROUP BY reach.r),
counts AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN named USING (r) LEFT JOIN counts USING (r)"""


def build() -> dict[str, str]:
    return {
        "op5_quality_rules": quality(),
        "op6_sharding": sharding(),
        "op11_filter_audit": filter_audit(),
        "op12_vector_duplicates": vectors(),
        "op13_resampling": resampling(),
    }
