"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: Fixed pattern of the word rule shared by all operators: no space and no \\t to \\r.
WORD = r"[^\x20\x09-\x0D]+"

_SHINGLES = """
 {name}_w AS (SELECT {id} AS id, {row} AS row_key, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM {table}),
 {name}_s AS (
  SELECT DISTINCT id, row_key, least(len(w), 5) AS k, list_aggregate(w[i:i + least(len(w), 5) - 1], 'string_agg', ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM {name}_w WHERE len(w) > 0))"""

#: Items by whole-word containment; a document is also cut to the width of each short item.
OP7 = f"""
WITH {_SHINGLES.format(name='item', id='item_id', row="''", table='(SELECT * FROM benchmark WHERE item_id IS NOT NULL)', word=WORD)},
 item_n AS (SELECT id, count(*) AS n FROM item_s GROUP BY id),
 doc_w AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS row_key, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
 widths AS (SELECT DISTINCT k FROM item_s UNION SELECT 5),
 doc_s AS (
  SELECT DISTINCT id, row_key, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc_w, widths WHERE len(w) >= k))
SELECT d.id AS doc_id, i.id AS item_id, any_value(n) AS n_item, count(DISTINCT i.s) AS n_shared, count(DISTINCT i.s) / any_value(n)::DOUBLE AS containment
FROM doc_s d JOIN item_s i ON d.s = i.s AND d.k = i.k JOIN item_n n ON n.id = i.id
GROUP BY d.id, d.row_key, i.id HAVING count(DISTINCT i.s) / any_value(n)::DOUBLE >= 0.8 - 1e-9"""

#: The turn-taking fill itself: one row per claim, with the flags of the slots still free.
OP8 = """
WITH RECURSIVE prefs AS (
  SELECT k, ('0x' || md5('offset:shard-' || lpad(k::VARCHAR, 5, '0'))[1:15])::BIGINT % 6421 AS place,
   ('0x' || md5('skip:shard-' || lpad(k::VARCHAR, 5, '0'))[1:15])::BIGINT % 6420 + 1 AS skip
  FROM range(0, 64) r(k)),
 fill AS (
  SELECT 0::BIGINT AS t, list_transform(range(0, 6421), lambda x: true) AS free, NULL::BIGINT AS slot
  UNION ALL
  SELECT t + 1, list_transform(free, lambda v, i: v AND i <> s + 1), s FROM (
   SELECT f.t, f.free, (place + skip * (list_position(list_transform(range(0, 6421), lambda j: f.free[(place + skip * j) % 6421 + 1]), true) - 1)) % 6421 AS s
   FROM fill f JOIN prefs l ON l.k = f.t % 64 WHERE f.t < 6421)),
 owners AS (SELECT slot, (t - 1) % 64 AS k FROM fill WHERE slot IS NOT NULL)
SELECT doc_id, slot::INTEGER AS slot, owners.k::INTEGER AS shard FROM (
 SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:15])::BIGINT % 6421 AS s FROM documents) d JOIN owners ON owners.slot = d.s"""

#: Unsigned crc32 of a number's decimal text: the reflected polynomial, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, b: xor(v >> 1, 3988292384 * (v & 1)))))"""

#: A node's key is the digests of its turns one after another, 64 characters each, so a prefix of the key is an ancestor's.
OP13 = f"""
WITH turns AS (
  SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS dig, strlen(coalesce(text, '')) AS bytes,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
 convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format(value='conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
 rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.r, t.dig, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.r <= c.h
  UNION ALL SELECT t.conv_id, 1, t.r, t.dig, t.bytes FROM turns t JOIN convs c ON c.conv_id = t.conv_id WHERE t.r > c.h),
 prefixes AS (
  SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(dig, '') OVER w AS k FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, r)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
 whole AS (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM prefixes GROUP BY conv_id),
 lists AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS listed FROM whole GROUP BY k),
 nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY k, depth),
 children AS (SELECT left(k, 64 * (depth - 1)::BIGINT) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
 below AS (
  SELECT left(n.k, 64 * j) AS k, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE c.k IS NULL) AS leaves
  FROM (SELECT *, unnest(generate_series(0, depth::BIGINT)) AS j FROM nodes) n LEFT JOIN children c ON c.k = n.k GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
 b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(l.listed, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.k = n.k LEFT JOIN children c ON c.k = n.k LEFT JOIN lists l ON l.k = n.k
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = left(n.k, 64 * (n.depth - 1)::BIGINT)"""

ORACLE: dict[str, str] = {
    "op7_contained_items": OP7,
    "op8_shard_lookup": OP8,
    "op13_prefix_trie": OP13,
}
