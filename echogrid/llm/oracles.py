"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

# Table of the CRC-32 of one byte, and its use over a list ``{bytes}`` of byte values.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
)"""


def _crc(values: str) -> str:
    return (
        f"xor(list_reduce({values}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"
    )


def _crc_of_digits(text: str) -> str:
    return _crc(f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field(text)})"


def _up(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves(tree, pos, n, digest)`` and the siblings of every node."""
    return f"""
{name} AS (
  SELECT tree, 0 AS lvl, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 16
),
{name}_sib AS (
  SELECT tree, lvl, pos,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM {name} WHERE n > 1 WINDOW r AS (PARTITION BY tree, lvl, pos // 16 ORDER BY pos)
)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
hit AS (
  SELECT documents.*, {_crc_of_digits('doc_id::VARCHAR')} % 5 = 0 AS bad FROM documents, crc_table
),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    {_leaf('text')} AS digest, CASE WHEN bad THEN {_leaf(_LOWER.format('text'))} ELSE {_leaf('text')} END AS changed
  FROM hit
),
{_up('doc_level', 'leaves')},
subroots AS (
  SELECT '' AS tree, tree AS source_tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest
  FROM doc_level WHERE n = 1
),
{_up('top_level', 'subroots')},
path AS (
  SELECT leaves.tree, leaves.pos, lvl, a, b
  FROM leaves JOIN doc_level_sib AS s ON s.tree = leaves.tree AND s.pos = leaves.pos >> (4 * lvl)
  UNION ALL
  SELECT leaves.tree, leaves.pos, 1000 + lvl, a, b
  FROM leaves JOIN subroots ON subroots.source_tree = leaves.tree JOIN top_level_sib AS s ON s.pos = subroots.pos >> (4 * lvl)
),
walk AS (
  SELECT tree, pos, string_agg(a || b, '' ORDER BY lvl) AS sib, list(struct_pack(a := a, b := b) ORDER BY lvl) AS steps
  FROM path GROUP BY tree, pos
),
folded AS (
  SELECT leaves.doc_id, leaves.digest AS leaf, subroots.digest AS subroot,
    (SELECT digest FROM top_level WHERE n = 1) AS root, sha256(coalesce(sib, '')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda acc, x: struct_pack(a := sha256(x.a || acc.a || x.b), b := ''),
      struct_pack(a := changed, b := '')).a AS folded_root
  FROM leaves JOIN subroots ON subroots.source_tree = leaves.tree 
  LEFT JOIN walk ON walk.tree = leaves.tree AND walk.pos = leaves.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""

_UTF8 = "list_transform(range(0, octet_length(encode({0})) * 2, 2), lambda i: ('0x' || substr(hex(encode({0})), i + 1, 2))::BIGINT)"


def _features(table: str, key: str) -> str:
    """``w``: each row's words; ``f``: every run of 1 to 3 of them."""
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
{table}_words AS (SELECT {key} AS key, {words} AS w FROM {table}),
{table}_grams AS (
  SELECT key, array_to_string(w[i + 1:i + k], ' ') AS f
  FROM (SELECT key, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM {table}_words, range(1, 4) AS r(k))
)"""


IMPORTANCE = f"""
WITH {_CRC_TABLE},
{_features('documents', 'doc_id')},
{_features('benchmark', 'item_id')},
hashed AS (
  SELECT f, {_crc(_UTF8.format('f'))} % 10000 AS b
  FROM (SELECT f FROM documents_grams UNION SELECT f FROM benchmark_grams), crc_table
),
raw AS (SELECT b, count(*) AS s FROM documents_grams JOIN hashed USING (f) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM benchmark_grams JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw)::DOUBLE AS total_s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS total_t),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (total_s + 10000) / ((s + 1) * (total_t + 10000))))::BIGINT AS g
  FROM raw LEFT JOIN target USING (b), totals
),
summed AS (
  SELECT key, count(*) AS n_features, sum(g)::BIGINT AS weight
  FROM documents_grams JOIN hashed USING (f) JOIN gain USING (b) GROUP BY key
),
scored AS (
  SELECT key AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || key), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents_words LEFT JOIN summed USING (key)
),
placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM placed
"""
