"""The operators' registered queries and, where SQL can express them, the same in DuckDB's dialect."""

from __future__ import annotations

from . import chat, decontaminate, importance, licenses, main_text, mixing, near_duplicates, quality_rules, repeats, toxicity

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(w)) AS size, unnest(range(1, greatest(2, len(w) - 8))) AS i, w FROM b WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM windows),
dw AS (SELECT row_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT row_id, i, dw.size, item_id FROM dw JOIN windows ON windows.size = dw.size AND windows.win = array_to_string(w[i : i + dw.size - 1], ' ')),
covered AS (SELECT row_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row_id),
items AS (SELECT row_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN items USING (row_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.size + b.size - shared)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_importance": importance.op3_importance,
        "op4_chat_format": chat.op4_chat_format,
        "op5_main_text": main_text.op5_main_text,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_repeated_strings": repeats.op9_repeated_strings,
        "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_chat_format": chat.OP4_SQL, "op7_license_scan": licenses.op7_sql(), "op10_near_duplicates": OP10_SQL}
