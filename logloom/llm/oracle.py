"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: Components by transitive closure: for the small tables on which SQL checks the queries.
CLOSURE = "x(a, b) AS (SELECT id, id FROM ids UNION SELECT x.a, links.b FROM x JOIN links ON links.a = x.b), comp AS (SELECT a AS id, min(b) AS component_id FROM x GROUP BY a)"

MIXING = """
WITH n AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
k AS (SELECT src, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 25)::INT + 1)) AS k FROM r),
c AS (SELECT src, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf FROM k),
d AS (SELECT *, coalesce(source, '') AS src, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, any_value(d.u) AS u, count(*) AS copies FROM d JOIN c ON c.src = d.src AND c.cdf <= d.u GROUP BY d.doc_id)
SELECT documents.*, t.copy, substr(md5('18:' || t.doc_id || ':' || t.copy), 1, 16) AS shuffle_key
FROM documents JOIN (SELECT doc_id, unnest(range(1, copies + 1))::INT AS copy FROM m) t ON t.doc_id = documents.doc_id"""

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
g AS (SELECT min(doc_id) AS id, len(any_value(s)) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)), f AS (SELECT id, n, unnest(s) AS t FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ids AS (SELECT id FROM g), links AS (SELECT a, b FROM p), {CLOSURE}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component_id, s.doc_id) AS kept FROM s LEFT JOIN g ON len(s.s) > 0 AND list_sort(s.s) = g.s LEFT JOIN comp ON comp.id = g.id"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), ids AS (SELECT id FROM v),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98), {CLOSURE},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT ids.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, ids.id = comp.component_id AS kept FROM ids JOIN comp USING (id) LEFT JOIN n USING (id)"""

SHARDING = """
WITH b AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h FROM documents),
n AS (SELECT greatest(1, ceil(sum(n_bytes) / 2097152.0))::BIGINT AS n FROM b), a AS (SELECT doc_id, n_bytes, h % n AS seq FROM b, n),
s AS (SELECT seq, format('v1-{:06d}', seq) AS shard, sum(n_bytes)::BIGINT AS bytes FROM a GROUP BY seq),
t AS (SELECT *, greatest(floor(ln(greatest(bytes, 1) / 2097152.0) / ln(4.0)), -1)::INT AS tier FROM s WHERE bytes < 16777216),
c AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY tier ORDER BY seq, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 16777216 AS cut FROM t),
m AS (SELECT seq, tier, cut::BIGINT AS cut, count(*) OVER (PARTITION BY tier, cut) AS members FROM c)
SELECT a.doc_id, CASE WHEN m.members > 1 THEN format('v2-{:d}-{:06d}', m.tier, m.cut) ELSE format('v1-{:06d}', a.seq) END AS shard, a.n_bytes FROM a LEFT JOIN m ON m.seq = a.seq"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING, "op6_minhash": MINHASH, "op8_vectors": VECTORS, "op10_sharding": SHARDING}
