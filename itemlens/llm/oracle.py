"""DuckDB SQL for the operators that SQL can express."""

DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS t(i)
), lens AS (SELECT DISTINCT k FROM win), g AS (
  SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), hit AS (SELECT g.rid, g.i, g.k, win.item_id FROM g JOIN win USING (s, k)),
spots AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
names AS (
  SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item_id FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(spots.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(spots.n, 0) > 0 AND 20 * coalesce(spots.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN names USING (rid)
"""

ORACLE = {
    "op10_decontaminate": DECONTAMINATE,
}
