"""SQL for those pN_ queries that SQL can express on whole tables: brute force of what the operators find."""

from __future__ import annotations

_NEIGHBOURS = """
WITH r AS (SELECT id, embedding::FLOAT[] AS v FROM url_nodes WHERE id IS NOT NULL AND len(embedding) = 64
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
u AS (SELECT id, min(v)::DOUBLE[] AS v FROM r GROUP BY id), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS size FROM u),
s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (a.size * b.size), 9) AS cosine FROM n a JOIN n b ON a.id <> b.id),
t AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t"""

_NEAR_DUPLICATES = r"""
WITH d AS (SELECT id, arg_max(content_text, struct_pack(t := epoch_us(created_at), d := md5(content_text))) AS t FROM page_content WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM d WHERE t IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM w WHERE len(ws) >= 40),
e AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM c WHERE k >= 0.5 * (na + nb - k)"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _NEIGHBOURS, "p5_found": _NEAR_DUPLICATES}
