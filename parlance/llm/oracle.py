"""DuckDB SQL for the queries of this package that SQL can express."""

# Weights, share and cut as in mixing.py. A source's level is the first
# one at which the sources cut by it and the weights of the others use up the
# goal; sources are cut in the order of their cap per weight.
OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h, coalesce('=' || source, '') AS s
  FROM documents),
c AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 2, 3), 3, '0') || substr(h, 1, 2) AS cell FROM d),
src AS (
  SELECT s, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap FROM c GROUP BY s),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY s = '', s) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         1.5::DOUBLE * (SELECT sum(source_size) FROM src)::DOUBLE AS goal FROM src),
o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, sum(weight) OVER after AS weight_after, row_number() OVER (ORDER BY cap / weight, s) AS i
  FROM w WINDOW before AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (
  SELECT arg_min((goal - cap_before) / weight_after, i) AS level FROM o WHERE (goal - cap_before) / weight_after <= cap / weight),
t AS (
  SELECT s, source_size, least(cap, weight * coalesce((SELECT level FROM l), 0)) AS target,
         ('0x' || substr(md5('mix-1' || s), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM w),
r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY c.s ORDER BY c.cell, c.size, c.h)::DOUBLE AS k
  FROM c JOIN t USING (s))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT AS copies FROM r)
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

OP3 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

OP12 = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS y,
         ('0x' || h[17:24])::UBIGINT % 100 AS h3, ('0x' || h[25:32])::UBIGINT % 100 AS h4 FROM u),
f AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(units[greatest(x, y) + 1:], '') AS s,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain'
              WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""

ORACLE = {"op12_fill_middle": OP12, "op2_int8_neardup": OP2, "op3_vp_search": OP3, "op8_mixing": OP8}
