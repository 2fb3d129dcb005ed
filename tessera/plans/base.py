"""The relations of plans.evaluation once more, as DuckDB common table expressions that share no code with them."""

from __future__ import annotations

from math import log2

from tessera.operators.router import FEATURES, PUBLISHED
from tessera.plans.evaluation import DEEPEST, DEPTH, PREFIX, RRF_K


def _tok(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"


DUCK_BASE = f"""
corpus AS (SELECT doc_id::VARCHAR AS doc_id, text, lang AS src FROM documents),
queries AS (SELECT item_id::VARCHAR AS query_id, text AS query, 's' || (item_id % 3)::VARCHAR AS src FROM benchmark),
qrels AS (SELECT query_id, doc_id FROM corpus, queries WHERE contains(text, query)),
ctok AS MATERIALIZED (SELECT doc_id, {_tok('text')} AS w FROM corpus),
qtok AS (SELECT query_id, {_tok('query')} AS w FROM queries),
ct AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM ctok),
tf AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM ct GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM ctok),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(w) AS term FROM qtok) GROUP BY ALL),
bs AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e-12)))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bp AS (SELECT * FROM bs UNION ALL SELECT q.query_id, f.doc_id, 0e0 FROM queries q CROSS JOIN (SELECT doc_id FROM corpus ORDER BY doc_id LIMIT {DEEPEST}) f
  ANTI JOIN bs ON bs.query_id = q.query_id AND bs.doc_id = f.doc_id),
bm25x AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bp) WHERE rank <= {DEEPEST}),
bm25 AS (SELECT * FROM bm25x WHERE rank <= {DEPTH}),
hc AS MATERIALIZED (SELECT * FROM (SELECT doc_id AS id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1e0 ELSE -1e0 END) AS x FROM ct GROUP BY ALL) WHERE x <> 0),
hq AS (SELECT * FROM (SELECT query_id AS id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS i, sum(qtf * CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1e0 ELSE -1e0 END) AS x FROM qt GROUP BY ALL) WHERE x <> 0),
nc AS (SELECT id, sqrt(sum(x * x)) AS norm FROM hc GROUP BY id), nq AS (SELECT id, sqrt(sum(x * x)) AS norm FROM hq GROUP BY id),
dots AS (SELECT hq.id AS query_id, hc.id AS doc_id, sum(hq.x * hc.x) AS dot FROM hq JOIN hc USING (i) GROUP BY ALL),
ds AS (SELECT nq.id AS query_id, nc.id AS doc_id, round(coalesce(dot, 0) / (nq.norm * nc.norm), 9) AS score FROM nq CROSS JOIN nc LEFT JOIN dots ON dots.query_id = nq.id AND dots.doc_id = nc.id),
densex AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= {DEEPEST}),
dense AS (SELECT * FROM densex WHERE rank <= {DEPTH}),
fs AS (SELECT query_id, doc_id, round(sum(1e0 / ({RRF_K} + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM dense) GROUP BY ALL),
hybrid AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fs),
ov AS (SELECT h.query_id, h.doc_id, round(len(list_intersect(list_distinct(qtok.w), list_distinct(ctok.w)))::DOUBLE / greatest(len(list_distinct(qtok.w)), 1), 9) AS s
  FROM hybrid h JOIN qtok USING (query_id) JOIN ctok USING (doc_id) WHERE rank <= {PREFIX}),
reranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM ov UNION ALL SELECT query_id, doc_id, rank FROM hybrid WHERE rank > {PREFIX}),
rankings AS MATERIALIZED (SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense
  UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM reranked)"""

_ideal, _sum = [], 0.0
for _n in range(1, 11):
    _sum += 1 / log2(_n + 1)
    _ideal.append(f"({_n}, {_sum!r}e0)")

_WORD = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PRED = f"{PUBLISHED.intercept!r}e0" + "".join(f" + ({f} - {m!r}e0) / {s!r}e0 * ({c!r}e0)" for f, m, s, c in zip(FEATURES, PUBLISHED.means, PUBLISHED.scales, PUBLISHED.coefficients))

#: Per-query metrics at 10, router features and policy decisions. Empty gold scores 0.
EVAL = f"""
ideal AS (SELECT * FROM (VALUES {', '.join(_ideal)}) AS t(n, idcg)),
gold AS (SELECT query_id, count(*) AS g FROM qrels GROUP BY query_id),
hits AS (SELECT r.method, r.query_id, r.doc_id, r.rank FROM rankings r JOIN qrels x ON r.query_id = x.query_id AND r.doc_id = x.doc_id),
hs AS (SELECT method, query_id, sum(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END) AS h10, min(rank) AS first_rank, sum(CASE WHEN rank <= 10 THEN 1e0 / log2(rank + 1e0) ELSE 0e0 END) AS dcg FROM hits GROUP BY method, query_id),
pq AS (SELECT q.query_id, q.src, m.method, hs.first_rank, CASE WHEN g > 0 THEN coalesce(h10, 0e0) / g ELSE 0e0 END AS recall, CASE WHEN first_rank <= 10 THEN 1e0 / first_rank ELSE 0e0 END AS mrr,
    coalesce(1e0 / first_rank, 0e0) AS rr, CASE WHEN g > 0 THEN coalesce(dcg, 0e0) / idcg ELSE 0e0 END AS ndcg, CASE WHEN g > 0 AND h10 = g THEN 1e0 ELSE 0e0 END AS coverage
  FROM queries q CROSS JOIN (SELECT DISTINCT method FROM rankings) m LEFT JOIN gold ON gold.query_id = q.query_id LEFT JOIN hs ON hs.query_id = q.query_id AND hs.method = m.method LEFT JOIN ideal ON ideal.n = least(g, 10)),
b20 AS (SELECT query_id, doc_id, rank FROM rankings WHERE method = 'bm25' AND rank <= 20), d20 AS (SELECT query_id, doc_id, rank FROM rankings WHERE method = 'dense' AND rank <= 20),
bd AS (SELECT coalesce(b.query_id, d.query_id) AS query_id, b.rank AS br, d.rank AS dr FROM b20 b FULL OUTER JOIN d20 d ON b.query_id = d.query_id AND b.doc_id = d.doc_id),
lg AS (SELECT query_id, method, doc_id, rank FROM rankings WHERE method IN ('bm25', 'dense')),
rr2 AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM lg GROUP BY query_id, doc_id) AS z),
mg AS (SELECT query_id, CASE WHEN count(*) = 1 THEN 1e0 ELSE (max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END)) / max(CASE WHEN r = 1 THEN score END) END AS margin FROM rr2 WHERE r <= 2 GROUP BY query_id),
ft AS (SELECT bd.query_id, CASE WHEN count(CASE WHEN br = 1 AND dr = 1 THEN 1 END) > 0 THEN 0e0 ELSE 1e0 END AS top1_disagreement,
    count(CASE WHEN br <= 10 AND dr <= 10 THEN 1 END) * 1e0 / count(CASE WHEN br <= 10 OR dr <= 10 THEN 1 END) AS jaccard10, count(CASE WHEN br IS NOT NULL AND dr IS NOT NULL THEN 1 END) * 1e0 / count(*) AS jaccard20,
    sum(least(coalesce(1e0 / br, 0e0), coalesce(1e0 / dr, 0e0))) / sum(greatest(coalesce(1e0 / br, 0e0), coalesce(1e0 / dr, 0e0))) AS rank_overlap, 1e0 - avg(abs(coalesce(br, 21) - coalesce(dr, 21)) * 1e0) / 20e0 AS coherence
  FROM bd GROUP BY bd.query_id),
features AS (SELECT ft.query_id, q.src, top1_disagreement, jaccard10, jaccard20, rank_overlap, coherence, ln(1e0 + len(regexp_extract_all(coalesce(q.query, ''), '{_WORD}'))) AS log_words, margin FROM ft JOIN mg ON mg.query_id = ft.query_id JOIN queries q ON q.query_id = ft.query_id),
pred AS (SELECT *, round({_PRED}, 9) AS p FROM features),
th AS (SELECT 0.25e0 AS budget, percentile_cont(0.75) WITHIN GROUP (ORDER BY p) AS t FROM pred UNION ALL SELECT 0.5e0, percentile_cont(0.5) WITHIN GROUP (ORDER BY p) FROM pred UNION ALL SELECT 0.75e0, percentile_cont(0.25) WITHIN GROUP (ORDER BY p) FROM pred),
decisions AS (SELECT query_id, src, 'fixed_disagreement' AS policy, top1_disagreement > 0 AS rerank FROM pred UNION ALL SELECT query_id, src, 'cheap_jaccard', jaccard10 < 0.5e0 FROM pred UNION ALL SELECT query_id, src, 'never', FALSE FROM pred UNION ALL SELECT query_id, src, 'always', TRUE FROM pred
  UNION ALL SELECT query_id, src, CASE WHEN budget = 0.25e0 THEN 'utility_25' WHEN budget = 0.5e0 THEN 'utility_50' ELSE 'utility_75' END, p > t FROM pred CROSS JOIN th),
gain AS (SELECT a.query_id, a.src, b.ndcg AS base, a.ndcg AS after, a.ndcg - b.ndcg AS d, b.first_rank AS rb, a.first_rank AS ra FROM pq a JOIN pq b ON a.query_id = b.query_id AND a.method = 'reranked' AND b.method = 'hybrid')"""
