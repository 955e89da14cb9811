"""DuckDB SQL for the operators that SQL can express, written apart from the operators themselves."""

from __future__ import annotations


def _located(kind: str, rank: int, pattern: str, keep: str, table: str = "documents") -> str:
    """The matches of one kind: doc_id, rank, kind, start, stop (exclusive), hit, the text before and after."""
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop
FROM (
  SELECT doc_id, hit, before, after,
         sum(length(before)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (
    SELECT row_id, doc_id, hits[i] AS hit, gaps[i] AS before, gaps[i + 1] AS after, i
    FROM (
      SELECT row_id, doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps FROM {table})
    )
  )
  WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
WHERE {keep}"""


def _near(words: str) -> str:
    return f"regexp_matches(lower(right(before, 40) || ' ' || left(after, 20)), '{words}')"


_ALONE = "NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')"
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER)
       ELSE CAST(reverse({_DIGITS})[i] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_SMALL = "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
_ACCOUNT = "replace(hit, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(({_ACCOUNT})[5:] || ({_ACCOUNT})[:4], ''), lambda c: CAST(CASE WHEN c >= '0' AND c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
  lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"""

_PII_PARTS = " UNION ALL ".join([
    _located("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _located("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _SMALL),
    _located("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    _located("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    _located("iban", 4, r"[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", f"{_ALONE} AND length({_ACCOUNT}) BETWEEN 15 AND 34 AND {_MOD97}"),
    _located("ssn", 5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{_ALONE} AND NOT regexp_matches(hit, '^(000|666|9)|-00-|0000$') AND {_near('ssn|social security|tax id')}"),
    _located("local_phone", 6, r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", f"{_ALONE} AND NOT regexp_matches(right(before, 8), '[+0-9][-0-9 .()]*$') AND {_near('phone|tel|call|mobile|fax|contact|anruf')}"),
])

PII = f"""
WITH found AS ({_PII_PARTS}),
spans AS (
  SELECT doc_id,
         CAST(count(*) FILTER (WHERE rank = 0) AS BIGINT) AS n_email, CAST(count(*) FILTER (WHERE rank = 1) AS BIGINT) AS n_ip,
         CAST(count(*) FILTER (WHERE rank = 2) AS BIGINT) AS n_card, CAST(count(*) FILTER (WHERE rank = 3) AS BIGINT) AS n_phone,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id)
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.ints) = len(c.ints)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

_CAPITALS = "".join(chr(c) for c in [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)])
_SMALLS = "".join(chr(ord(c) + 32) for c in _CAPITALS)


def _shingled(table: str, key: str) -> str:
    """The distinct runs of five words (all words, if fewer: no item of the given tables is that short) of each text."""
    return f"""
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALLS}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table})"""


LEAKS = f"""
WITH items AS ({_shingled("benchmark", "item_id")}),
docs AS ({_shingled("documents", "doc_id")}),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n FROM docs JOIN items USING (s) GROUP BY doc_id, item_id),
leaks AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(shared.n / sizes.n) AS overlap
  FROM shared JOIN sizes USING (item_id) WHERE 10 * shared.n >= 8 * sizes.n GROUP BY doc_id
)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(overlap, 0.0) AS overlap
FROM documents d LEFT JOIN leaks USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY digest) AS rep
  FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM sets GROUP BY doc_id)
),
reps AS (SELECT sets.* FROM sets JOIN classes USING (doc_id) WHERE doc_id = rep),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM edges
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root <= e.b
),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, c.rep, d.doc_id) AS component_id, coalesce(r.root, c.rep, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN classes c USING (doc_id) LEFT JOIN roots r ON r.node = c.rep
"""

#: Jump consistent hashing with 24 and 25 shards: each step is a row, the last below the number of shards counts. Checksums go byte by byte through a table made by rule.
SHARDS = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n::BIGINT) ORDER BY n) AS steps FROM range(256) AS t(n)
), bytes AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
        xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c // 256, steps[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) AS text_crc32
    FROM documents, crc_table
), jumps(doc_id, state, shard, ahead, step) AS (
    SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END::UHUGEINT, -1::BIGINT, 0::BIGINT, 0 FROM documents
    UNION ALL
    SELECT doc_id, state, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((state // 8589934592)::DOUBLE + 1)))::BIGINT, step + 1
    FROM (SELECT doc_id, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS state, ahead, step FROM jumps WHERE ahead < 25)
), placed AS (
    SELECT doc_id, max(shard) FILTER (shard < 24) AS shard, max(shard) FILTER (shard < 25) AS grown_shard FROM jumps GROUP BY doc_id
)
SELECT b.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY b.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM bytes b JOIN placed p ON b.doc_id IS NOT DISTINCT FROM p.doc_id
"""

#: Every two equal words of a document at a distance of a fourth of it at most; stretches of them with one distance are runs.
RUNS = r"""
WITH crc_table AS (
    SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n::BIGINT) ORDER BY n) AS steps FROM range(256) AS t(n)
), hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, steps[(xor(c, b) % 256) + 1]), 4294967295), 4294967295) AS h
    FROM documents, crc_table
), tails AS (
    SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), periods AS (
    SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM tails
), texts AS MATERIALIZED (
    SELECT doc_id, len(w) AS n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM periods
), places AS MATERIALIZED (
    SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), same AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
), runs AS MATERIALIZED (
    SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), best AS (
    SELECT doc_id, count(*) AS n_runs, min(struct_pack(a := -length, b := start, c := period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM places
    WHERE (doc_id, i) NOT IN (SELECT doc_id, unnest(range(start + period, start + length)) FROM runs) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, top.b AS start, -top.a AS length, top.c AS period, (1000 * -top.a) // top.c AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
