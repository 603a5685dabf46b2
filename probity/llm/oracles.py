"""SQL of the operators' queries that SQL can state, for DuckDB over the same tables.

Operators 1, 2, 3, 5, 9 and 10 have none: a network, a fitted classifier, passages of a whole corpus by
automata, a scheduler's simulation, transitive classes of set similarities and a smoothed trie
either can't be stated or take too long there; tests hold them against brute force.
"""

from __future__ import annotations

from probity.llm import quality, sharding

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op4() -> str:
    seeds = ", ".join(str(sharding.shard_seed(k)) for k in range(sharding.SHARDS + 1))
    step = f"((xor(x, x >> 16) * {sharding.MULTIPLIER}) & {sharding.MASK})"
    chunks = sharding.chunks_for(sharding.SHARDS)
    return f"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, hex(encode(coalesce(text, ''))) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
summed AS (SELECT doc_id, size, h, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(bytes, '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM sized, steps),
one AS (SELECT *, list_transform([{seeds}], lambda s: xor(h, CAST(s AS BIGINT))) AS x0 FROM summed),
two AS (SELECT *, list_transform(x0, lambda x: {step}) AS x1 FROM one),
three AS (SELECT *, list_transform(x1, lambda x: {step}) AS x2 FROM two),
drawn AS (SELECT *, list_transform(x2, lambda x: xor(x, x >> 16)) AS d FROM three),
placed AS (SELECT *, list_max(d[:{sharding.SHARDS}]) AS top, CAST(list_position(d[:{sharding.SHARDS}], list_max(d[:{sharding.SHARDS}])) - 1 AS INT) AS shard FROM drawn)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h % {chunks}, doc_id, crc, size) - 1 AS slot,
    CASE WHEN d[{sharding.SHARDS + 1}] > top THEN {sharding.SHARDS} ELSE shard END AS grown_shard
FROM placed"""


def op6() -> str:
    count = lambda x, p: f"len(regexp_extract_all({x}, {_quoted(p)}))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i : i + {quality.WINDOW - 1}], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM v) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, {WORD}) AS w, regexp_matches(text, '[#*$%&|<>»›•]|!!') AS marked FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT *, CASE WHEN len(w) = 0 THEN false
    WHEN marked AND {count("line", quality.DIVIDER)} >= 2 AND {count("line", quality.DIVIDER)} * 6 >= len(w) THEN true
    WHEN {count("line", quality.BOILERPLATE)} > 0 AND {count("line", quality.BOILERPLATE)} * {quality.WORDS_A_PHRASE} >= len(w) THEN true
    WHEN marked AND {count("line", quality.SYMBOL)} * 10 > length(line) THEN true
    WHEN marked AND contains(line, '!!') AND {count("line", chr(92) + "p{Lu}")} > 4 * {count("line", chr(92) + "p{Ll}")} THEN true
    WHEN length(line) >= 60 AND NOT regexp_matches(line, {_quoted(quality.STOP_MARK)}) THEN true ELSE false END AS failed FROM l),
s AS (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) - count(DISTINCT line) FILTER (WHERE len(w) > 0) AS dup, coalesce(sum(length(array_to_string(w, ''))) FILTER (WHERE failed), 0) AS lost FROM j GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {count("text", quality.SYMBOL)} AS n_symbols, dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, lost FROM d JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {quality.MAX_LOST_PERCENT} * word_chars AS kept FROM f"""


def op7() -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, {WHITE}), {UPPER}, {LOWER}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.keeper IS NULL OR f.keeper = k.doc_id AS keep FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256,
    string_agg(CASE WHEN keep THEN '1' ELSE '0' END, '' ORDER BY pos) AS keep_bits FROM m GROUP BY doc_id"""


def op8() -> str:
    words = lambda x: f"regexp_extract_all(translate(coalesce({x}, ''), {UPPER}, {LOWER}), {TERM})"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {words("text")} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
v AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
h AS (SELECT doc_id, item_id, n, i FROM v JOIN t USING (n, t)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""
