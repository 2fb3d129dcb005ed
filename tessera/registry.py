"""Queries over the driver's tables and the SQL that each must agree with.

Each query is built from DataFrame operators; its SQL, for DuckDB only, is written independently of them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import anchors, checks, failures, features, fusion, gate, latency, metrics, policies, router, runtime, splits, stats, study
from tessera.operators.components import connected_components
from tessera.operators.ranking import top_k
from tessera.operators.vector import dense_search, embedding_quality, hashed_embedding, hashing_model
from tessera.plans.base import DUCK_BASE, EVAL
from tessera.plans.evaluation import DEPTH, PREFIX, evaluation
from tessera.plans.lineage import cut, ensure_checkpoint_dir, forget, stored
from tessera.sources import vectors
from tessera.sources.tables import corpus, table
from tessera.streaming.latency import drain, latency_windows, read_events

_SPARK, _DUCK = {}, {}


def _duck_text(sql: str) -> str:
    sql = re.sub(r"SHA\{(.*?)\}", r"sha256(\1)", sql)
    sql = re.sub(r"HEX\{(.*?)\}", r"CAST('0x' || \1 AS BIGINT)", sql)
    return re.sub(r"LIST\{(.*?)\}", r"string_agg(DISTINCT \1, ',' ORDER BY \1)", sql)


def duck(name: str, sql: str, evaluate: bool = True) -> None:
    """The SQL of a query that `ev` or `query` builds, over the relations of plans.base."""
    body = re.sub(r"^\s*WITH ", ", ", sql) if sql.lstrip().startswith("WITH ") else " " + sql
    _DUCK[name] = _duck_text(f"WITH {DUCK_BASE}" + (f", {EVAL}" if evaluate else "") + body)


def ev(name: str, build) -> None:
    """A query over the folder's evaluation."""
    _SPARK[name] = lambda s, d: build(evaluation(s, d))


def nine(*cols: str, digits: int = 9) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def query(name: str, sql: str | None = None, base: bool = False):
    def add(f):
        _SPARK[name] = f
        if sql:
            _DUCK[name] = (f"WITH {DUCK_BASE} " if base else "") + sql
        return f

    return add


TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"
R = "ORDER BY"

# --- text ------------------------------------------------------------------------------------------------------------

query("tokenize_counts", f"SELECT doc_id, len({TOK})::BIGINT AS n_tokens, len(list_distinct({TOK}))::BIGINT AS n_distinct FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(tx.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(tx.tokenize(F.col("text")))).cast("long").alias("n_distinct")))
query("flatten_text", r"""SELECT event_id, 'k ' || regexp_extract(props, '-?[0-9]+') AS flat FROM events""")(lambda s, d: table(s, d, "events").select("event_id", tx.flatten_udf("props").alias("flat")))
query("json_key_census", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")(
    lambda s, d: table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n")))
query("normalize_unicode")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(tx.normalize_udf("text")).alias("digest")))
query("id_prefix", "SELECT split_part(p_name, ' ', 1) AS head, CASE WHEN contains(p_type, ' ') THEN regexp_extract(p_type, '^(.*) ', 1) ELSE 'unknown' END AS domain, count(*) AS n FROM part GROUP BY ALL")(
    lambda s, d: table(s, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("head"), tx.id_prefix(F.col("p_type"), " ").alias("domain")).agg(F.count("*").alias("n")))
query("excerpt", "SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(substr(text, 1, 237), ' [^ ]*$', '') || '...' END AS excerpt FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt")))
query("name_counterparts", """WITH s AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[a-z0-9]+'), '_') AS a,
  array_to_string(regexp_extract_all(lower(regexp_replace('My ' || p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[a-z0-9]+'), '_') AS b FROM part)
  SELECT p_partkey, length(a) >= 12 AND (a = b OR ends_with(b, '_' || a)) AS counterpart FROM s""")(
    lambda s, d: table(s, d, "part").select("p_partkey", tx.name_counterpart(F.col("p_name"), F.concat(F.lit("My "), F.col("p_name"))).alias("counterpart")))


@query("normalize_dedup", r"""WITH n AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS norm FROM conversations)
  SELECT id, CASE WHEN id = min(id) OVER (PARTITION BY norm) THEN 0 ELSE 2 END::INT AS reason FROM n""")
def _dedup(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return splits.eligible(c, tx.normalize_ascii(F.col("text")), "id").select("id", "reason")


# --- retrieval -------------------------------------------------------------------------------------------------------

query("corpus_stats", "SELECT n, round(avgdl, 9) AS avgdl FROM st", True)(lambda s, d: evaluation(s, d).index.stats.select("n", F.round("avgdl", 9).alias("avgdl")))
query("term_stats", "SELECT term, df FROM df", True)(lambda s, d: evaluation(s, d).index.term_stats)
query("postings", "SELECT term, doc_id, tf, dl::INT AS dl FROM tf", True)(lambda s, d: evaluation(s, d).index.postings.select("term", "doc_id", "tf", "dl"))
query("idf_table", "SELECT term, round(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 9) AS idf FROM df, st", True)(lambda s, d: evaluation(s, d).index.idf().select("term", F.round("idf", 9).alias("idf")))
query("bm25_scores", "SELECT query_id, doc_id, round(score, 9) AS score FROM bs", True)(lambda s, d: evaluation(s, d).asked.scores(evaluation(s, d).queries).select("query_id", "doc_id", F.round("score", 9).alias("score")))
query("bm25_topk", "SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs) WHERE rank <= 10", True)(
    lambda s, d: evaluation(s, d).asked.search(evaluation(s, d).queries, 10, pad=False).select("query_id", "doc_id", "score", "rank"))
query("bm25_topk_padded", "SELECT query_id, doc_id, score, rank::INT AS rank FROM bm25", True)(lambda s, d: evaluation(s, d).asked.search(evaluation(s, d).queries, DEPTH).select("query_id", "doc_id", "score", "rank"))
query("hashed_embeddings", "SELECT id AS doc_id, i::INT AS i, x FROM hc", True)(lambda s, d: evaluation(s, d).hashed.where("x <> 0"))
query("dense_topk", "SELECT query_id, doc_id, rank FROM dense", True)(lambda s, d: evaluation(s, d).dense)
query("embedding_quality", """SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim, count_if(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite,
  count_if(abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) > 1e-5) AS not_unit FROM embeddings""")(lambda s, d: embedding_quality(table(s, d, "embeddings"), "vec_id", "embedding").select(*["n", "ids", "min_dim", "max_dim", "not_finite", "not_unit"]))


@query("vector_label_topk", """WITH e AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings),
  s AS (SELECT q.id AS query_id, e.id AS doc_id, round(list_inner_product(q.v, e.v), 9) AS score FROM e q JOIN e ON q.id::BIGINT % 20 = 0 AND e.id <> q.id)
  SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def _vectors(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    return dense_search(e.where(F.col("doc_id").cast("long") % 20 == 0).withColumnRenamed("doc_id", "query_id"), e, 10, own=False)


def _legs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return evaluation(s, d).bm25, evaluation(s, d).dense


_UNION = "(SELECT query_id, doc_id, rank, 1e0 AS w, 0 AS leg FROM bm25 UNION ALL SELECT query_id, doc_id, rank, {w}, 1 FROM dense)"
query("rrf_weighted", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, round(sum(w / (10 + rank)), 9) AS score FROM {_UNION.format(w='1.25e0')} GROUP BY ALL)", True)(
    lambda s, d: fusion.weighted_rrf(_legs(s, d), [1, 1.25], 10))
query("rrf_unweighted", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leg, rk)::INT AS rank FROM (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min(leg) AS leg, arg_min(rank, leg) AS rk FROM {_UNION.format(w='1e0')} GROUP BY ALL)", True)(
    lambda s, d: fusion.weighted_rrf(_legs(s, d), k=60, first_seen=True).select("query_id", "doc_id", "score", "rank"))
_RRF = "WITH par AS (SELECT * FROM (VALUES {v}) AS t({c})), f AS (SELECT {c}, query_id, doc_id, round(sum(1e0 / ({k} + rank)), 9) AS score FROM rankings CROSS JOIN par WHERE method IN ('bm25', 'dense'){w} GROUP BY {c}, query_id, doc_id), o AS (SELECT *, row_number() OVER (PARTITION BY {c}, query_id ORDER BY score DESC, doc_id) AS rank FROM f), e AS (SELECT o.{c}, o.query_id, min(o.rank) AS first_rank, sum(CASE WHEN o.rank <= 10 THEN 1e0 ELSE 0e0 END) AS h FROM o JOIN qrels x ON o.query_id = x.query_id AND o.doc_id = x.doc_id GROUP BY o.{c}, o.query_id) SELECT par.{c}, round(avg(coalesce(1e0 / first_rank, 0e0)), 9) AS mrr, round(avg(coalesce(h / g, 0e0)), 9) AS recall10 FROM par CROSS JOIN queries q LEFT JOIN e ON e.{c} = par.{c} AND e.query_id = q.query_id LEFT JOIN gold ON gold.query_id = q.query_id GROUP BY par.{c}"
duck("rrf_k_ablation", _RRF.format(v="(10), (20), (40), (60), (100)", c="rrf_k", k="rrf_k", w=""))
duck("candidate_depth_ablation", _RRF.format(v="(25), (50), (100), (200), (500)", c="depth", k="60", w=" AND rank <= depth").replace("FROM rankings CROSS JOIN", "FROM (SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm25x UNION ALL SELECT 'dense', query_id, doc_id, rank FROM densex) CROSS JOIN"))


def _ablation(e, name: str, values: list[int], k: str, within: str) -> DataFrame:
    """Fused rankings for all values of a parameter in one pass over the two legs, which are searched once."""
    legs = e.deep_bm25.unionByName(e.deep_dense).withColumn(name, F.explode(F.array(*map(F.lit, values)))).where(within)
    fused = legs.groupBy(name, "query_id", "doc_id").agg(F.sum(F.expr(f"1.0D / ({k} + rank)")).alias("score"))
    ranked = top_k(fused, [name, "query_id"], None).withColumn("method", F.col(name).cast("string"))
    got = metrics.macro(metrics.evaluate(ranked, e.qrels, e.queries))
    return got.select(F.col("method").cast("int").alias(name), F.round("rr", 9).alias("mrr"), F.round("recall", 9).alias("recall10"))


ev("rrf_k_ablation", lambda e: _ablation(e, "rrf_k", [10, 20, 40, 60, 100], "rrf_k", f"rank <= {DEPTH}"))
ev("candidate_depth_ablation", lambda e: _ablation(e, "depth", [25, 50, 100, 200, 500], "60", "rank <= depth"))
ev("rerank_prefix", lambda e: e.reranked)
duck("rerank_prefix", "SELECT query_id, doc_id, rank FROM rankings WHERE method = 'reranked'", False)

# --- metrics ---------------------------------------------------------------------------------------------------------

for _m in ("bm25", "dense", "hybrid", "reranked"):
    duck(f"{_m}_eval", f"SELECT method, round(avg(recall), 9) AS recall10, round(avg(mrr), 9) AS mrr10, round(avg(rr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg10, round(avg(coverage), 9) AS coverage10, count(*) AS n FROM pq WHERE method = '{_m}' GROUP BY method")
    ev(f"{_m}_eval", lambda e, m=_m: metrics.macro(e.metrics_of(m)).select("method", *[F.round(a, 9).alias(b) for a, b in (("recall", "recall10"), ("mrr", "mrr10"), ("rr", "mrr"), ("ndcg", "ndcg10"), ("coverage", "coverage10"))], "n"))
duck("binary_metrics", "SELECT query_id, method, round(recall, 9) AS recall10, round(mrr, 9) AS mrr10, round(ndcg, 9) AS ndcg10, coverage AS coverage10 FROM pq")
duck("recall_at_k", "SELECT query_id, method, round(recall, 9) AS recall10 FROM pq")
duck("mrr", "SELECT query_id, method, round(rr, 9) AS rr FROM pq")
duck("ndcg_at_k", "SELECT query_id, method, round(ndcg, 9) AS ndcg10 FROM pq")
duck("macro_metrics_multi_k", "WITH ks AS (SELECT * FROM (VALUES (1), (5), (10)) AS t(k)), e AS (SELECT k, method, h.query_id, count(*) * 1e0 / max(g) AS r FROM hits h JOIN gold ON gold.query_id = h.query_id CROSS JOIN ks WHERE rank <= k GROUP BY k, method, h.query_id), n AS (SELECT count(*) AS n FROM queries), m AS (SELECT DISTINCT method FROM rankings) SELECT ks.k, m.method, round(coalesce(sum(r), 0e0) / max(n), 9) AS recall FROM ks CROSS JOIN m CROSS JOIN n LEFT JOIN e ON e.k = ks.k AND e.method = m.method GROUP BY ks.k, m.method")
duck("first_relevant_rank", "SELECT query_id, method, first_rank FROM pq")
duck("rank_effects", "SELECT query_id, CASE WHEN rb IS NULL AND ra IS NULL THEN 'unchanged_missing' WHEN rb IS NULL OR ra < rb THEN 'improved' WHEN ra IS NULL OR ra > rb THEN 'hurt' ELSE 'unchanged' END AS effect FROM gain")
duck("rank_transitions", "WITH g AS (SELECT b.query_id, b.doc_id, b.rank AS rb, a.rank AS ra FROM rankings b JOIN rankings a ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.method = 'hybrid' AND a.method = 'reranked' JOIN qrels x ON x.query_id = b.query_id AND x.doc_id = b.doc_id) SELECT query_id, doc_id, CASE WHEN rb <= 10 AND ra > 10 THEN 'left_top10' WHEN rb > 10 AND ra <= 10 THEN 'entered_top10' WHEN rb > 10 THEN 'outside_top10' WHEN ra < rb THEN 'raised' WHEN ra > rb THEN 'lowered' ELSE 'kept' END AS transition FROM g")

ev("binary_metrics", lambda e: e.per_query.select("query_id", "method", *[F.round(c, 9).alias(f"{c}10") for c in ("recall", "mrr", "ndcg")], F.col("coverage").alias("coverage10")))
ev("recall_at_k", lambda e: e.per_query.select("query_id", "method", F.round("recall", 9).alias("recall10")))
ev("mrr", lambda e: e.per_query.select("query_id", "method", *nine("rr")))
ev("ndcg_at_k", lambda e: e.per_query.select("query_id", "method", F.round("ndcg", 9).alias("ndcg10")))
ev("macro_metrics_multi_k", lambda e: metrics.macro(metrics.evaluate(e.rankings, e.qrels, e.queries, [1, 5, 10])).select("k", "method", *nine("recall")))
ev("first_relevant_rank", lambda e: e.per_query.select("query_id", "method", "first_rank"))
ev("rank_effects", lambda e: e.gain.select("query_id", metrics.rank_effect(F.col("rb"), F.col("ra")).alias("effect")))
ev("rank_transitions", lambda e: metrics.rank_of(e.reranked, metrics.rank_of(e.hybrid, e.qrels).withColumnRenamed("rank", "rb")).where("rb IS NOT NULL").select("query_id", "doc_id", metrics.transition(F.col("rb"), F.col("rank")).alias("transition")))

# --- routing ---------------------------------------------------------------------------------------------------------

duck("gate_disagreement", "SELECT query_id, top1_disagreement > 0 AS rerank FROM features")
duck("gate_jaccard", "SELECT query_id, jaccard10 < 0.5e0 AS rerank FROM features")
duck("router_features", "SELECT query_id, top1_disagreement, round(jaccard10, 9) AS jaccard10, round(jaccard20, 9) AS jaccard20, round(rank_overlap, 9) AS rank_overlap, round(coherence, 9) AS coherence, round(log_words, 9) AS log_words, round(margin, 7) AS margin FROM features")
_GRAM = [(f, g) for i, f in enumerate(router.FEATURES) for g in router.FEATURES[i:]]
SEEDS = [str(i) for i in range(20)]
duck("ridge_moments", "SELECT count(*) AS n, " + ", ".join([f"round(avg({f}), 7) AS m_{f}, round(sum({f} * d), 7) AS x_{f}" for f in router.FEATURES] + [f"round(sum({f} * {g}), 6) AS g_{f}_{g}" for f, g in _GRAM]) + " FROM features JOIN gain ON gain.query_id = features.query_id")
duck("router_predict", "SELECT query_id, round(p, 7) AS p FROM pred")
duck("budget_thresholds", "SELECT budget, round(t, 7) AS threshold FROM th")
duck("route_decisions", "SELECT query_id, policy, rerank FROM decisions")
_POL = "SELECT {g}policy, round(avg(CASE WHEN rerank THEN after ELSE base END), 9) AS ndcg10, count_if(rerank) AS calls, 20 * count_if(rerank) AS pairs FROM decisions JOIN gain ON gain.query_id = decisions.query_id GROUP BY {b}"
duck("policy_summary", _POL.format(g="", b="policy"))
duck("policy_by_source_rollup", _POL.format(g="coalesce(decisions.src, 'all') AS source, ", b="GROUPING SETS ((policy, decisions.src), (policy))"))
duck("routing_effects", "SELECT policy, count_if(NOT rerank AND d > 1e-12) AS harmful_skips, count_if(NOT rerank AND d < -1e-12) AS beneficial_skips, count_if(rerank AND d < -1e-12) AS harmful_reranks, count_if(rerank AND d > 1e-12) AS beneficial_reranks, round(sum(CASE WHEN NOT rerank THEN greatest(d, 0e0) ELSE 0e0 END), 9) AS forgone, round(sum(CASE WHEN NOT rerank THEN greatest(-d, 0e0) ELSE 0e0 END), 9) AS avoided FROM decisions JOIN gain ON gain.query_id = decisions.query_id GROUP BY policy")
_CALLS = "WITH c AS (SELECT policy, count_if(rerank) AS n FROM decisions GROUP BY policy)"
duck("oracle_ceiling", _CALLS + ", o AS (SELECT d, base, row_number() OVER (ORDER BY round(d, 9) DESC, query_id) AS r FROM gain) SELECT policy, round(avg(base + CASE WHEN r <= n THEN d ELSE 0e0 END), 9) AS ndcg10 FROM c CROSS JOIN o GROUP BY policy")
_RAND = _CALLS.replace("WITH c AS (SELECT policy, count_if(rerank) AS n FROM decisions GROUP BY policy)", "WITH c AS (SELECT policy{s}, count_if(rerank) AS n FROM decisions GROUP BY policy{s})") + ", seeds AS (SELECT * FROM (VALUES {v}) AS t(seed)), o AS (SELECT seed, src, d, base, row_number() OVER (PARTITION BY seed{s} ORDER BY SHA{{seed || '|' || query_id}}, query_id) AS r FROM gain CROSS JOIN seeds), e AS (SELECT policy, seed, avg(base + CASE WHEN r <= n THEN d ELSE 0e0 END) AS v FROM c JOIN o ON {j} GROUP BY policy, seed) SELECT policy, round(avg(v), 9) AS mean, round(min(v), 9) AS low, round(max(v), 9) AS high FROM e GROUP BY policy"
_SEEDED = ", ".join(f"('{x}')" for x in SEEDS)
duck("random_controls_hash", _RAND.format(s="", j="TRUE", v=_SEEDED))
duck("random_source_matched_hash", _RAND.format(s=", src", j="c.src = o.src", v=_SEEDED))
duck("routing_summary", "SELECT policy, coalesce(decisions.src, 'all') AS source, rerank, count(*) AS n, round(avg(d), 9) AS mean_gain FROM decisions JOIN gain ON gain.query_id = decisions.query_id GROUP BY GROUPING SETS ((policy, rerank, decisions.src), (policy, rerank))")
duck("failure_records", "SELECT gain.query_id, gain.src, round(base, 9) AS before, round(after, 9) AS after_, CASE WHEN d > 1e-12 THEN 'win' WHEN d < -1e-12 THEN 'loss' ELSE 'tie' END AS outcome, round(pq.coverage, 9) AS covered FROM gain JOIN pq ON pq.query_id = gain.query_id AND pq.method = 'hybrid'")
_FAIL = """WITH hp AS (SELECT h.query_id, h.doc_id, len(qtok.w) AS nq, len(ctok.w) AS nd FROM hybrid h JOIN qtok USING (query_id) JOIN ctok USING (doc_id) WHERE h.rank <= 20),
  kp AS (SELECT hp.query_id, hp.nq, nq + nd > 61 AS cut_, CASE WHEN nq + nd <= 61 THEN nq WHEN nq <= nd THEN least(nq, 31) ELSE greatest(61 - nd, 31) END AS kq, x.doc_id IS NOT NULL AS rel FROM hp LEFT JOIN qrels x ON x.query_id = hp.query_id AND x.doc_id = hp.doc_id),
  pp AS (SELECT query_id, count(*) AS pairs, count_if(cut_) AS pt, count_if(cut_ AND rel) AS ppt, count_if(kq < nq) AS qt, max(nq) AS nq FROM kp GROUP BY query_id),
  gg AS (SELECT x.query_id, count(*) AS pos, count_if(h.rank <= 20) AS inp, count_if(h.rank <= 10 AND r.rank > 10) AS lt, count_if(h.rank > 10 AND r.rank <= 10) AS en, avg(len(ctok.w)) AS nd
    FROM qrels x JOIN ctok ON ctok.doc_id = x.doc_id LEFT JOIN hybrid h ON h.query_id = x.query_id AND h.doc_id = x.doc_id LEFT JOIN reranked r ON r.query_id = x.query_id AND r.doc_id = x.doc_id GROUP BY x.query_id),
  tt AS (SELECT r.query_id, x.doc_id IS NULL AND c.src IS DISTINCT FROM q.src AS crossed FROM reranked r JOIN corpus c ON c.doc_id = r.doc_id JOIN queries q ON q.query_id = r.query_id LEFT JOIN qrels x ON x.query_id = r.query_id AND x.doc_id = r.doc_id WHERE r.rank = 1),
  rec AS (SELECT gain.*, CASE WHEN d > 1e-12 THEN 'win' WHEN d < -1e-12 THEN 'loss' ELSE 'tie' END AS oc, pos, inp, inp::DOUBLE / pos AS rec, lt, en, nd, pairs, pt, ppt, qt, nq, crossed, rerank AS gate
    FROM gain JOIN gg USING (query_id) JOIN pp USING (query_id) JOIN tt USING (query_id) JOIN decisions dd ON dd.query_id = gain.query_id AND dd.policy = 'fixed_disagreement'),
  s AS (SELECT *, unnest([{'k': 'source', 'v': src}, {'k': 'positives', 'v': CASE WHEN pos >= 3 THEN '3+' ELSE pos::VARCHAR END}, {'k': 'query_tokens', 'v': CASE WHEN nq < 32 THEN '0-31' WHEN nq < 64 THEN '32-63' ELSE '64+' END},
    {'k': 'positive_truncated', 'v': CASE WHEN ppt > 0 THEN 'yes' ELSE 'no' END}, {'k': 'doc_tokens', 'v': CASE WHEN nd < 128 THEN '0-127' WHEN nd < 256 THEN '128-255' ELSE '256+' END}, {'k': 'coverage', 'v': CASE WHEN inp = 0 THEN 'none' WHEN inp = pos THEN 'all' ELSE 'partial' END},
    {'k': 'focus_outcome', 'v': CASE WHEN src = 's0' THEN oc END}, {'k': 'focus_truncated', 'v': CASE WHEN src = 's0' THEN CASE WHEN ppt > 0 THEN 'yes' ELSE 'no' END END}, {'k': 'gate', 'v': CASE WHEN gate THEN 'selected' ELSE 'bypassed' END}, {'k': 'all', 'v': 'all'}]) AS g FROM rec)
  SELECT g.k AS stratum, g.v AS value, count(*) AS queries, round(avg(base), 9) AS before, round(avg(after), 9) AS after_, round(avg(d), 9) AS delta, count_if(oc = 'win') AS wins, count_if(oc = 'loss') AS losses, count_if(oc = 'tie') AS ties, round(avg(rec), 9) AS recall_prefix, count_if(inp = 0) AS without_positive, count_if(inp = pos) AS with_all,
    sum(pos)::BIGINT AS positives, sum(inp)::BIGINT AS positives_in_prefix, sum(lt)::BIGINT AS left_top10, sum(en)::BIGINT AS entered_top10, sum(pairs)::BIGINT AS pairs, sum(pt)::BIGINT AS pairs_truncated, sum(ppt)::BIGINT AS positive_pairs_truncated, sum(qt)::BIGINT AS query_truncated_pairs, count_if(qt > 0) AS query_truncated,
    count_if(crossed) AS cross_source, 0::BIGINT AS counterparts, round(avg(nq), 9) AS mean_query_tokens, round(avg(nd), 9) AS mean_doc_tokens FROM s WHERE g.v IS NOT NULL GROUP BY ALL"""
duck("failure_strata", _FAIL)
duck("case_selection", "WITH o AS (SELECT src, query_id, d, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), query_id) AS l, row_number() OVER (PARTITION BY src ORDER BY round(d, 9) DESC, query_id) AS w FROM gain) SELECT src, query_id, round(d, 9) AS d, 'loss' AS side FROM o WHERE l <= 5 AND d < 0 UNION ALL SELECT src, query_id, round(d, 9), 'win' FROM o WHERE w <= 5 AND d > 0")
duck("cache_violations", "WITH v AS (SELECT method || ':' || query_id AS id, 'duplicate' AS rule FROM rankings GROUP BY method, query_id HAVING count(*) <> count(DISTINCT doc_id) UNION ALL SELECT method || ':' || query_id, 'gap' FROM rankings GROUP BY method, query_id HAVING max(rank) <> count(*) UNION ALL SELECT query_id, 'no_gold' FROM queries ANTI JOIN gold USING (query_id) UNION ALL SELECT a.query_id, 'tail' FROM rankings a JOIN rankings b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.method = 'hybrid' AND b.method = 'reranked' WHERE a.rank > 20 AND a.rank <> b.rank) SELECT rule, count(*) AS n FROM v GROUP BY rule")


ev("gate_disagreement", lambda e: e.predictions.select("query_id", (F.col("top1_disagreement") > 0).alias("rerank")))
ev("gate_jaccard", lambda e: e.predictions.select("query_id", (F.col("jaccard10") < 0.5).alias("rerank")))
ev("router_features", lambda e: e.predictions.select("query_id", "top1_disagreement", *nine("jaccard10", "jaccard20", "rank_overlap", "coherence", "log_words"), *nine("margin", digits=7)))
ev("ridge_moments", lambda e: e.predictions.join(e.gain.select("query_id", "d"), "query_id").agg(F.count("*").alias("n"), *[F.round(F.avg(f), 7).alias(f"m_{f}") for f in router.FEATURES], *[F.round(F.sum(F.col(f) * F.col("d")), 7).alias(f"x_{f}") for f in router.FEATURES], *[F.round(F.sum(F.col(f) * F.col(g)), 6).alias(f"g_{f}_{g}") for f, g in _GRAM]))
ev("router_predict", lambda e: e.predictions.select("query_id", *nine("p", digits=7)))
ev("budget_thresholds", lambda e: e.thresholds.select("budget", *nine("threshold", digits=7)))
ev("route_decisions", lambda e: e.decisions.select("query_id", "policy", "rerank"))
ev("policy_summary", lambda e: policies.summarise(e.decided).select("policy", *nine("ndcg10"), "calls", "pairs"))
ev("policy_by_source_rollup", lambda e: policies.summarise(e.decided, True).select("policy", F.col("src").alias("source"), *nine("ndcg10"), "calls", "pairs"))
ev("routing_effects", lambda e: policies.effects(e.decided).select("policy", "harmful_skips", "beneficial_skips", "harmful_reranks", "beneficial_reranks", *nine("forgone", "avoided")))
ev("oracle_ceiling", lambda e: policies.oracle_ceiling(e.decided, e.gain).select("policy", *nine("ndcg10")))
ev("random_controls_hash", lambda e: policies.random_controls(e.decided, e.gain, SEEDS).select("policy", *nine("mean", "low", "high")))
ev("random_source_matched_hash", lambda e: policies.random_controls(e.decided, e.gain, SEEDS, True).select("policy", *nine("mean", "low", "high")))
ev("routing_summary", lambda e: policies.routing_summary(e.decided).select("policy", F.col("src").alias("source"), "rerank", "n", *nine("mean_gain")))
ev("failure_records", lambda e: e.gain.join(e.per_query.where("method = 'hybrid'").select("query_id", "coverage"), "query_id").select("query_id", "src", F.round("base", 9).alias("before"), F.round("after", 9).alias("after_"), metrics.outcome(F.col("d")).alias("outcome"), F.round("coverage", 9).alias("covered")))


def _cases(e) -> DataFrame:
    """The five largest losses and wins of each source."""
    rows = e.gain.select("src", "query_id", F.round("d", 9).alias("d"))
    side = lambda name, by, cond: rows.where(cond).withColumn("n", F.row_number().over(W.partitionBy("src").orderBy(by, "query_id"))).where("n <= 5").select("src", "query_id", "d", F.lit(name).alias("side"))
    return side("loss", F.asc("d"), "d < 0").unionByName(side("win", F.desc("d"), "d > 0"))


ev("case_selection", _cases)


def _strata(e) -> DataFrame:
    """All nine groupings of the failure records, and all of them, with 21 sums and means; the focus is source s0."""
    rec = failures.records(e.queries, e.docs, e.qrels, e.hybrid, e.reranked, e.gain, e.routed("fixed_disagreement"), tx.tokenize)
    return failures.strata(rec, "s0").select("*").withColumns({c: F.round(c, 9) for c in ("before", "after_", "delta", "recall_prefix", "mean_query_tokens", "mean_doc_tokens")})


ev("failure_strata", _strata)


def _rules(e) -> DataFrame:
    """Rules of the rankings that are broken, by number of queries."""
    per = e.rankings.groupBy("method", "query_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.max("rank").alias("last"))
    own = per.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != F.col("ids"), "duplicate"), F.when(F.col("last") != F.col("n"), "gap")))).alias("rule"))
    bare = e.queries.join(e.qrels, "query_id", "left_anti").select(F.lit("no_gold").alias("rule"))
    moved = e.hybrid.where("rank > 20").join(e.reranked.withColumnRenamed("rank", "now"), ["query_id", "doc_id"]).where("rank <> now").select(F.lit("tail").alias("rule"))
    return own.unionByName(bare).unionByName(moved).groupBy("rule").agg(F.count("*").alias("n"))


ev("cache_violations", _rules)


@query("gated_rerank", "SELECT h.query_id, h.doc_id, CASE WHEN t.a <> t.b THEN r.rank ELSE h.rank END AS rank FROM hybrid h JOIN reranked r USING (query_id, doc_id) JOIN (SELECT b.query_id, b.doc_id AS a, d.doc_id AS b FROM bm25 b JOIN dense d USING (query_id) WHERE b.rank = 1 AND d.rank = 1) t USING (query_id)", True)
def _gated(s: SparkSession, d: str) -> DataFrame:
    e = evaluation(s, d)
    top = e.bm25.where("rank = 1").unionByName(e.dense.where("rank = 1")).groupBy("query_id").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").select("query_id")
    return fusion.gated_rerank(e.hybrid, top, e.scorer).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("utility_rerank", f", {EVAL} SELECT h.query_id, h.doc_id, CASE WHEN c.rerank THEN r.rank ELSE h.rank END AS rank FROM hybrid h JOIN reranked r USING (query_id, doc_id) JOIN decisions c ON c.query_id = h.query_id AND c.policy = 'utility_75'", True)
def _utility(s: SparkSession, d: str) -> DataFrame:
    e = evaluation(s, d)
    return fusion.gated_rerank(e.hybrid, e.routed("utility_75"), e.scorer).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def _executed(s: SparkSession, d: str) -> tuple[runtime.Execution, DataFrame, DataFrame]:
    """The conditional re-ranking run anew from queries and legs, the frozen decisions, and the ranking that these should give."""
    e = evaluation(s, d)
    at = {r.budget: r.threshold for r in e.thresholds.collect()}[0.75]
    now = features.router_features(e.queries, e.bm25, e.dense).join(e.queries.select("query_id", "src"), "query_id").withColumn("p", F.round(router.PUBLISHED.predict(), 9))
    frozen = e.decisions.where("policy = 'utility_75'").select("query_id", "rerank")
    expected = e.reranked.join(e.routed("utility_75"), "query_id", "left_semi").unionByName(e.hybrid.join(e.routed("utility_75"), "query_id", "left_anti"))
    return runtime.execute(e.queries, e.docs, e.hybrid, now.where(F.col("p") > at).select("query_id"), fusion.overlap_scorer), frozen, expected


@query("runtime_verification", f", {EVAL} SELECT count_if(rerank) AS calls, 20 * count_if(rerank) AS pairs, 0::BIGINT AS differences FROM decisions WHERE policy = 'utility_75'", True)
def _verified(s: SparkSession, d: str) -> DataFrame:
    """Calls and pairs of the scorer as its workers counted them, and violations of the frozen decisions and rankings."""
    ran, frozen, expected = _executed(s, d)
    return runtime.violations(ran, frozen, expected).agg(F.lit(ran.calls).cast("long").alias("calls"), F.lit(ran.pairs).cast("long").alias("pairs"), F.count("*").alias("differences"))


@query("runtime_records", f", {EVAL} SELECT query_id, rerank AS reranked, rerank::BIGINT AS calls, CASE WHEN rerank THEN (SELECT count(*) FROM hybrid h WHERE h.query_id = c.query_id AND h.rank <= 20) ELSE 0 END AS scored_pairs, FALSE AS odd FROM decisions c WHERE policy = 'utility_75'", True)
def _run_records(s: SparkSession, d: str) -> DataFrame:
    """What ran for each query, and whether it breaks a rule."""
    ran, frozen, expected = _executed(s, d)
    odd = runtime.violations(ran, frozen, expected).select(F.col("id").alias("query_id"), F.lit(True).alias("odd")).distinct()
    return ran.records.join(odd, "query_id", "left").na.fill(False, ["odd"])


@query("rrf_recomputed", ", g AS (SELECT query_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM rankings WHERE method IN ('bm25', 'dense') GROUP BY ALL), f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) SELECT count(*) AS compared, count_if(f.rank <> h.rank) AS differ FROM f JOIN hybrid h USING (query_id, doc_id)", True)
def _recomputed(s: SparkSession, d: str) -> DataFrame:
    """The kept fused rankings against the fusion of the kept legs."""
    e = evaluation(s, d)
    again = fusion.weighted_rrf([e.bm25, e.dense], k=60).select("query_id", "doc_id", F.col("rank").alias("now"))
    return again.join(e.hybrid, ["query_id", "doc_id"], "full_outer").agg(F.count("*").alias("compared"), F.count_if(~F.col("now").eqNullSafe(F.col("rank"))).alias("differ"))


@query("vector_store", _duck_text("WITH d AS (SELECT doc_id::VARCHAR AS id, greatest(1, (SELECT ceil(count(*) / 1024) FROM documents))::BIGINT AS shards FROM documents) SELECT count(*) AS n, count(DISTINCT HEX{substr(md5(id), 1, 8)} % shards) AS shards, count(DISTINCT HEX{substr(md5(id), 1, 8)} % shards) AS encoded, 0::BIGINT AS again, 0::BIGINT AS odd, 0::BIGINT AS differ FROM d"))
def _vector_store(s: SparkSession, d: str) -> DataFrame:
    """All documents encoded into a store by workers, once and again, with the store's violations and the vectors that differ from the engine's own."""
    docs, path = corpus(s, d), f"{ensure_checkpoint_dir(s).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    first, again = (vectors.encode_store(docs, path, "hashed counts, 64", hashing_model()) for _ in range(2))
    own = hashed_embedding(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("v").alias("w"))
    off = F.exists(F.zip_with("v", "w", lambda a, b: F.abs(a - b)), lambda x: x > 1e-6)
    kept = vectors.read_store(docs, path, "hashed counts, 64")
    n = kept.join(own, "id", "left").agg(F.count("*").alias("n"), F.count_if(off).alias("differ")).first()
    odd = vectors.store_violations(docs, path, "hashed counts, 64").count()
    forget(s, path)
    return s.createDataFrame([(n.n, first["shards"], first["encoded"], again["encoded"], odd, n.differ)], "n long, shards long, encoded long, again long, odd long, differ long")


# --- statistics ------------------------------------------------------------------------------------------------------

duck("paired_deltas", "SELECT query_id, round(d, 9) AS delta FROM gain")
duck("sign_test_counts", "WITH c AS (SELECT count_if(d > 1e-12) AS wins, count_if(d < -1e-12) AS losses, count_if(abs(d) <= 1e-12) AS ties FROM gain) SELECT wins, losses, ties, round(CASE WHEN wins + losses = 0 THEN 1e0 ELSE least(1e0, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2e0))) FROM range((least(wins, losses) + 1)::BIGINT) AS t(i))) END, 7) AS p_value FROM c")
RESAMPLES = 20_000
_P = stats.PRIME


def _hashed(seed: str, of: str) -> str:
    return f"HEX{{substr(md5('{seed}|' || {of}), 1, 8)}} % {_P}"


def _weighed(seed: str, n: int) -> str:
    """The relation g, with hashes h, in n replicates r with its weights w: two rounds of fifth powers."""
    fifth = f"((y * y % {_P}) * x + {stats.ADDED}) % {_P}"
    weight = " + ".join(f"(x >= {t})::INT" for t in stats.POISSON)
    return f"""reps AS (SELECT r, {_hashed(seed, "r::VARCHAR")} AS hr FROM range({n}) AS t(r)),
x1 AS (SELECT g.*, reps.r, (g.h + hr) % {_P} AS x FROM g, reps), x2 AS (SELECT *, x * x % {_P} AS y FROM x1), x3 AS (SELECT * REPLACE (({fifth} + h) % {_P} AS x) FROM x2),
x4 AS (SELECT * REPLACE (x * x % {_P} AS y) FROM x3), x5 AS (SELECT * REPLACE ({fifth} AS x) FROM x4), weighed AS (SELECT *, {weight} AS w FROM x5)"""


def _boot(group: str, unit: str, src: str, by: str) -> str:
    return f"""WITH g AS (SELECT {group} AS grp, {_hashed("boot", unit)} AS h, sum(d) AS d, count(*) AS c FROM ({src}) AS x GROUP BY {by}), {_weighed("boot", RESAMPLES)},
m AS (SELECT r, grp, CASE WHEN sum(w * c) > 0 THEN sum(w * d) / sum(w * c) ELSE sum(d) / sum(c) END AS v FROM weighed GROUP BY r, grp), k AS (SELECT r, avg(v) AS v FROM m GROUP BY r)
SELECT round(quantile_cont(v, 0.025), 7) AS low, round(quantile_cont(v, 0.975), 7) AS high, count(*) AS resamples FROM k"""


duck("bootstrap_hash_ci", _boot("'all'", "query_id", "SELECT * FROM gain", "query_id"))
duck("stratified_bootstrap_hash_ci", _boot("src", "query_id", "SELECT * FROM gain", "src, query_id"))
_BOOTED = _boot("src", "component", "SELECT gain.src, gain.d, qc.component FROM gain JOIN qc ON qc.query_id = gain.query_id", "src, component")
ev("paired_deltas", lambda e: e.gain.select("query_id", F.round("d", 9).alias("delta")))


def _signs(e) -> DataFrame:
    """Wins, losses and ties, and the exact two-sided p-value."""
    n = e.gain.agg(F.count_if(F.col("d") > metrics.EVEN).alias("wins"), F.count_if(F.col("d") < -metrics.EVEN).alias("losses"), F.count_if(F.abs("d") <= metrics.EVEN).alias("ties"))
    one = n.first()
    return n.withColumn("p_value", F.lit(round(stats.sign_test(one.wins, one.losses), 7)))


ev("sign_test_counts", _signs)


def _interval(rows: DataFrame, strata: str, unit: str) -> DataFrame:
    got = stats.interval(stats.weighted_bootstrap(rows, strata, unit, ["d"], RESAMPLES, "boot"), "d")
    return got.select(*nine("low", "high", digits=7), "resamples")


ev("bootstrap_hash_ci", lambda e: _interval(e.gain.withColumn("src", F.lit("all")), "src", "query_id"))
ev("stratified_bootstrap_hash_ci", lambda e: _interval(e.gain, "src", "query_id"))
ev("component_bootstrap_hash_ci", lambda e: _interval(e.gain.join(e.components, "query_id"), "src", "component"))
_LAT = "WITH ev AS (SELECT user_id, event_type AS policy, value AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS repetition FROM events)"
duck("latency_summary", _LAT + " SELECT policy, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ms), 6) AS p50_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY ms), 6) AS p95_ms FROM ev GROUP BY policy", False)
#: The policy that others are held against, and resamples of the latency study.
BASELINE, LATENCY_RESAMPLES = "view", 10_000
_AGAINST = f", u AS (SELECT user_id, policy, avg(ms) AS ms FROM ev GROUP BY ALL), b AS (SELECT user_id, ms AS base FROM u WHERE policy = '{BASELINE}'), a AS (SELECT * FROM u JOIN b USING (user_id) WHERE policy <> '{BASELINE}')"
duck("latency_reduction", _LAT + _AGAINST + " SELECT policy, count(*) AS units, round(avg(ms - base), 6) AS delta_ms, round(1e0 - sum(ms) / sum(base), 6) AS reduction FROM a GROUP BY policy", False)
duck("replay_percentiles", _LAT + ", t AS (SELECT user_id, repetition, sum(ms) AS ms, count(*) AS parts FROM ev GROUP BY user_id, repetition) SELECT repetition, count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY ms), 6) AS p50_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY ms), 6) AS p95_ms FROM t GROUP BY repetition", False)



def _timed(s: SparkSession, d: str) -> DataFrame:
    return latency.repetitions(table(s, d, "events"), "user_id", "event_type", "value", "ts", "event_id")


_SPARK["latency_summary"] = lambda s, d: latency.summary(_timed(s, d)).select("policy", "n", *nine("mean_ms", "p50_ms", "p95_ms", digits=6))
_SPARK["latency_reduction"] = lambda s, d: latency.reductions(latency.against(_timed(s, d), BASELINE)).select("policy", "units", *nine("delta_ms", "reduction", digits=6))


@query("latency_reduction_ci", _duck_text(_LAT + _AGAINST + ", g AS (SELECT policy, ms, base, " + _hashed("latency", "user_id::VARCHAR") + " AS h FROM a), " + _weighed("latency", LATENCY_RESAMPLES) + """, m AS (SELECT r, policy, sum(w * ms) / sum(w) AS ms, sum(w * base) / sum(w) AS base FROM weighed GROUP BY ALL)
  SELECT policy, round(quantile_cont(ms - base, 0.025), 6) AS delta_low, round(quantile_cont(ms - base, 0.975), 6) AS delta_high, round(quantile_cont(1 - ms / base, 0.025), 6) AS reduction_low, round(quantile_cont(1 - ms / base, 0.975), 6) AS reduction_high FROM m GROUP BY policy"""))
def _reduction_ci(s: SparkSession, d: str) -> DataFrame:
    """Intervals of each policy's latency against the baseline's, over resampled users."""
    return latency.reduction_intervals(latency.against(_timed(s, d), BASELINE), LATENCY_RESAMPLES, "latency").select("policy", *nine("delta_low", "delta_high", "reduction_low", "reduction_high", digits=6))


def _replayed(s: SparkSession, d: str) -> DataFrame:
    return latency.summary(_timed(s, d).groupBy("query_id", "repetition").agg(F.sum("ms").alias("ms")), "repetition").select("repetition", "n", *nine("p50_ms", "p95_ms", digits=6))


_SPARK["replay_percentiles"] = _replayed

# --- splits and training data ----------------------------------------------------------------------------------------

query("hash_sample", "SELECT o_orderkey, rank::INT AS rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s1' || chr(0) || o_orderkey::VARCHAR), o_orderkey::VARCHAR) AS rank FROM orders) WHERE rank <= 50")(
    lambda s, d: splits.hash_sample(table(s, d, "orders"), "o_orderpriority", "o_orderkey", 50, "s1").select("o_orderkey", "rank"))
duck("holdout_split", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY SHA{'h1|' || CAST(c_custkey AS VARCHAR(20))}, c_custkey) AS r FROM customer) SELECT c_custkey, CASE WHEN r <= 10 THEN 'calibration' WHEN r <= 25 THEN 'confirmation' ELSE 'reserve' END AS split FROM r", False)
duck("ratio_split_hash", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY SHA{'r1|' || CAST(c_custkey AS VARCHAR(20))}, c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN r <= floor(n * 0.7e0) THEN 'train' WHEN r <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'dev' ELSE 'test' END AS split FROM r", False)
duck("schedule_rotation", "WITH p AS (SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) AS t(policy, i)), q AS (SELECT query_id, row_number() OVER (ORDER BY SHA{'z|' || query_id}, query_id) - 1 AS pos FROM queries) SELECT query_id, pos, policy, (i + pos) % 4 AS position FROM q CROSS JOIN p", False)


def _component_table(s: SparkSession, d: str) -> DataFrame:
    return connected_components(table(s, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


#: The smallest node reachable, by recursion keyed by the node; edges {e} as (u, v), both ways round.
_REACH = """b AS (SELECT u, v FROM {e} UNION ALL SELECT v, u FROM {e}), comp(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM b
  UNION (SELECT x.node, min(y.component) FROM recurring.comp x JOIN b ON b.u = x.node JOIN comp y ON y.node = b.v WHERE y.component < x.component GROUP BY x.node))"""
_SPARK["holdout_split"] = lambda s, d: splits.holdout(table(s, d, "customer"), "c_mktsegment", "c_custkey", "h1|", {"calibration": 10, "confirmation": 15}).select("c_custkey", "split")
_SPARK["ratio_split_hash"] = lambda s, d: splits.ratio_split(table(s, d, "customer"), "c_custkey", "r1|", {"train": 0.7, "dev": 0.15}, "test").select("c_custkey", "split")
ev("schedule_rotation", lambda e: splits.rotated(e.queries, "query_id", "z|", ["a", "b", "c", "d"]))
_COMP = "e AS (SELECT DISTINCT l_orderkey * 2 AS u, l_partkey * 2 + 1 AS v FROM lineitem), " + _REACH.format(e="e")
query("components", f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp")(_component_table)
query("split_leakage", f"WITH RECURSIVE {_COMP} SELECT node % 2 AS kind, count(*) AS nodes, count(DISTINCT component) AS components FROM comp GROUP BY ALL")(
    lambda s, d: _component_table(s, d).groupBy((F.col("node") % 2).alias("kind")).agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components")))
_QCOMP = f"""qe AS (SELECT DISTINCT 'a' || query_id AS u, 'b' || doc_id AS v FROM qrels), {_REACH.format(e="qe")},
  qc AS (SELECT query_id, coalesce(substr(component, 2), query_id) AS component FROM queries LEFT JOIN comp ON node = 'a' || query_id)"""
_RBASE = DUCK_BASE.lstrip()


def _query_components(s: SparkSession, d: str) -> DataFrame:
    return evaluation(s, d).components


_DUCK["component_bootstrap_hash_ci"] = _duck_text(f"WITH RECURSIVE {_RBASE}, {EVAL}, {_QCOMP}" + re.sub(r"^WITH ", ", ", _BOOTED))
query("query_components", f"WITH RECURSIVE {_RBASE}, {_QCOMP} SELECT query_id, component FROM qc")(_query_components)


@query("grouped_split", f"""WITH RECURSIVE {_RBASE}, {_QCOMP}, g AS (SELECT component, 's' || (component::BIGINT % 3)::VARCHAR AS src, count(*) AS n FROM qc GROUP BY component),
  o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sha256('g1' || chr(0) || component), component) AS r FROM g),
  fold(src, r, rest, component, chosen) AS (SELECT DISTINCT src, 0::BIGINT, 10::BIGINT, NULL::VARCHAR, FALSE FROM o
    UNION ALL SELECT o.src, o.r, CASE WHEN n <= rest THEN rest - n ELSE rest END, o.component, n <= rest FROM fold JOIN o ON o.src = fold.src AND o.r = fold.r + 1)
  SELECT component, g.src, g.n, chosen FROM fold JOIN g USING (component)""")
def _grouped(s: SparkSession, d: str) -> DataFrame:
    c = _query_components(s, d).groupBy("component").agg(F.count("*").alias("n")).withColumn("src", F.concat(F.lit("s"), (F.col("component").cast("long") % 3).cast("string")))
    return splits.grouped_quota(c, {"s0": 10, "s1": 10, "s2": 10}, "g1", strict=False).select("component", "src", "n", "chosen")


duck("overlap_audit", "WITH s AS (SELECT DISTINCT o_orderpriority AS split, o_custkey AS k FROM orders) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.split < b.split GROUP BY a.split, b.split", False)
duck("missing_gold", "SELECT count(*) AS missing FROM qrels ANTI JOIN corpus USING (doc_id)", False)
_NEG = "n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM hybrid ANTI JOIN qrels USING (query_id, doc_id)), neg AS (SELECT query_id, doc_id, p FROM n WHERE p <= 5 AND query_id IN (SELECT query_id FROM n WHERE p = 5))"


def _negatives(s: SparkSession, d: str) -> DataFrame:
    return splits.hard_negatives(evaluation(s, d).hybrid, evaluation(s, d).qrels, 5)


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    return splits.overlaps(table(s, d, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_custkey").alias("k")), "split", "k")


_SPARK["overlap_audit"] = _overlaps
ev("missing_gold", lambda e: checks.missing_gold(e.qrels, e.docs).agg(F.count("*").alias("missing")))


_SPARK["hard_negatives"] = lambda s, d: _negatives(s, d).groupBy("query_id", "positive_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "negative_id"))), lambda x: x["negative_id"]), ",").alias("negatives"))
_DUCK["hard_negatives"] = f"WITH {DUCK_BASE}, {_NEG} SELECT neg.query_id, x.doc_id AS positive_id, string_agg(neg.doc_id, ',' ORDER BY p) AS negatives FROM neg JOIN qrels x USING (query_id) GROUP BY ALL"
_SPARK["triplets"] = lambda s, d: _negatives(s, d).select("query_id", "positive_id", "negative_id")
_DUCK["triplets"] = f"WITH {DUCK_BASE}, {_NEG} SELECT neg.query_id, x.doc_id AS positive_id, neg.doc_id AS negative_id FROM neg JOIN qrels x USING (query_id)"
_SPARK["labelled_pairs"] = lambda s, d: (lambda n: n.select("query_id", F.col("positive_id").alias("doc_id"), F.lit(1.0).alias("label")).distinct().unionByName(n.select("query_id", F.col("negative_id").alias("doc_id"), F.lit(0.0).alias("label")).distinct()))(_negatives(s, d))
_DUCK["labelled_pairs"] = f"WITH {DUCK_BASE}, {_NEG} SELECT DISTINCT query_id, x.doc_id, 1e0 AS label FROM neg JOIN qrels x USING (query_id) UNION ALL SELECT DISTINCT query_id, neg.doc_id, 0e0 FROM neg WHERE query_id IN (SELECT query_id FROM qrels)"

# --- checks, fingerprints, fits, streams -----------------------------------------------------------------------------

query("ranking_fingerprints", """, r AS (SELECT method, query_id, '["' || string_agg(doc_id, '", "' ORDER BY rank) || '"]' AS body FROM rankings GROUP BY ALL) SELECT method, query_id, sha256(body) AS fingerprint FROM r""", True)(
    lambda s, d: evaluation(s, d).rankings.groupBy("method", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids")).select("method", "query_id", tx.ranking_fingerprint(F.col("ids")).alias("fingerprint")))
query("split_disjointness", """WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS split FROM orders)
  SELECT o_custkey::VARCHAR AS id, 'o_custkey in several splits' AS rule FROM s GROUP BY o_custkey HAVING count(DISTINCT split) > 1
  UNION ALL SELECT o_orderkey::VARCHAR, 'o_orderkey in several splits' FROM s GROUP BY o_orderkey HAVING count(DISTINCT split) > 1""")(
    lambda s, d: checks.shared_between_splits(table(s, d, "orders").withColumn("split", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")), "split", ["o_custkey", "o_orderkey"]))


@query("pair_tokens", """, p AS (SELECT query_id, doc_id, len(qtok.w) AS n_query, len(ctok.w) AS n_doc FROM hybrid JOIN qtok USING (query_id) JOIN ctok USING (doc_id) WHERE rank <= 20),
  k AS (SELECT *, CASE WHEN n_query + n_doc <= 61 THEN n_query WHEN n_query <= n_doc THEN least(n_query, 31) ELSE greatest(61 - n_doc, 31) END AS kept_query FROM p)
  SELECT query_id, doc_id, n_query::INT AS n_query, n_doc::INT AS n_doc, kept_query::INT AS kept_query, least(n_doc, 61 - kept_query)::INT AS kept_doc, n_query + n_doc > 61 AS truncated FROM k""", True)
def _pair_tokens(s: SparkSession, d: str) -> DataFrame:
    e = evaluation(s, d)
    return checks.pair_tokens(e.queries, e.docs, e.hybrid.where("rank <= 20"), 64, 3, tx.tokenize)


def _ridge(src: str, alpha: float = 10.0) -> str:
    """The ridge fit of d on the features of a relation, as common table expressions: w(w0 .. w6, md) by elimination of the scaled
    system, m and s with the means and scales."""
    k = range(len(router.FEATURES))
    dev = [f"({f} - m{i})" for i, f in enumerate(router.FEATURES)] + ["(d - md)"]
    sums = ", ".join(f"sum({dev[i]} * {dev[j]}) AS s{i}_{j}" for i in k for j in range(i, len(dev)))
    row = lambda i: ", ".join([f"s{min(i, j)}_{max(i, j)} / (c{i} * c{j})" + (f" + {alpha}e0" if i == j else "") for j in k] + [f"s{i}_{len(k)} / c{i}"])
    rows = " UNION ALL ".join(f"SELECT {i} AS i, [{row(i)}] AS v FROM g, c" for i in k)
    step = lambda n: f"e{n + 1} AS (SELECT i, CASE WHEN i = {n} THEN list_transform(v, lambda x: x / p[{n + 1}]) ELSE list_transform(range(1, {len(k) + 2}), lambda j: v[j] - v[{n + 1}] * p[j] / p[{n + 1}]) END AS v FROM e{n}, (SELECT v AS p FROM e{n} WHERE i = {n}) AS z)"
    scales = ", ".join(f"CASE WHEN sqrt(s{i}_{i} / n) <= 1e-12 THEN 1e0 ELSE sqrt(s{i}_{i} / n) END AS c{i}" for i in k)
    return (f"m AS (SELECT count(*) AS n, avg(d) AS md, {', '.join(f'avg({f}) AS m{i}' for i, f in enumerate(router.FEATURES))} FROM {src}), g AS (SELECT {sums} FROM {src}, m), "
            f"c AS (SELECT {scales} FROM g, m), e0 AS ({rows}), {', '.join(map(step, k))}, w AS (SELECT {', '.join(f'max(CASE WHEN i = {i} THEN v[{len(k) + 1}] END) AS w{i}' for i in k)} FROM e{len(k)})")


_COEF = "SELECT 'intercept' AS {n}, round(md, 7) AS {v} FROM m" + "".join(f" UNION ALL SELECT '{f}', round(w{i}, 7) FROM w" for i, f in enumerate(router.FEATURES))
duck("router_fit", f"WITH fitted AS (SELECT f.*, x.d FROM features AS f JOIN gain AS x USING (query_id)), {_ridge('fitted')} " + _COEF.format(n="feature", v="coefficient"))


def _coefficients(m: router.Ridge) -> list[tuple[str, float]]:
    return [(n, round(float(v), 7)) for n, v in [("intercept", m.intercept), *zip(router.FEATURES, m.coefficients)]]


@query("router_fit")
def _router_fit(s: SparkSession, d: str) -> DataFrame:
    """The ridge fit of all queries' gains on their features."""
    e = evaluation(s, d)
    m = router.fit(e.predictions.join(e.gain.select("query_id", "d"), "query_id"), "d")
    return s.createDataFrame(_coefficients(m), "feature string, coefficient double")


# --- a study: cohorts of whole components, a router that is fitted, calibrated, frozen and confirmed ------------------

#: Queries that count as seen before, and rows of each source that the splits take.
_SEEN, _QUOTAS = 10, {"calibration": 3, "confirmation": 6}
_SOURCES = ("s0", "s1", "s2")


def _anchored(s: SparkSession, d: str) -> DataFrame:
    e = evaluation(s, d)
    quotas = {name: dict.fromkeys(_SOURCES, n) for name, n in _QUOTAS.items()}
    return cut(anchors.anchored_split(e.queries.select("query_id", "src"), e.components, e.queries.where(F.col("query_id").cast("long") % _SEEN == 0).select("query_id"), quotas, "g2", strict=False))


def _anchored_sql() -> str:
    fits = {p: " AND ".join(f"n{i} <= {p}{i}" for i in range(3)) for p in "cf"}
    left = [f"CASE WHEN {fits['c']} THEN c{i} - n{i} ELSE c{i} END" for i in range(3)] + [f"CASE WHEN NOT ({fits['c']}) AND {fits['f']} THEN f{i} - n{i} ELSE f{i} END" for i in range(3)]
    start = ", ".join(f"{_QUOTAS[n]}::BIGINT" for n in ("calibration", "confirmation") for _ in range(3))
    return f"""{_QCOMP}, t AS (SELECT query_id, src, component, query_id::BIGINT % {_SEEN} = 0 AS seen FROM qc JOIN queries USING (query_id)),
  gc AS (SELECT component, {', '.join(f"count(CASE WHEN src = '{x}' THEN 1 END) AS n{i}" for i, x in enumerate(_SOURCES))}, bool_or(seen) AS held FROM t GROUP BY component),
  oc AS (SELECT *, row_number() OVER (ORDER BY sha256('g2' || chr(0) || component), component) AS r FROM gc WHERE NOT held),
  fold(r, c0, c1, c2, f0, f1, f2, component, split) AS (SELECT 0::BIGINT, {start}, NULL::VARCHAR, NULL::VARCHAR
    UNION ALL SELECT oc.r, {', '.join(left)}, oc.component, CASE WHEN {fits['c']} THEN 'calibration' WHEN {fits['f']} THEN 'confirmation' ELSE 'reserve' END FROM fold JOIN oc ON oc.r = fold.r + 1),
  placed AS (SELECT query_id, src, t.component, CASE WHEN seen THEN 'development' ELSE coalesce(split, 'quarantined') END AS split FROM t LEFT JOIN fold ON fold.component = t.component)"""


_PLACED = f"WITH RECURSIVE {_RBASE}, {_anchored_sql()}"
query("anchored_split", f"{_PLACED} SELECT query_id, src, component, split FROM placed")(_anchored)
query("unseen_counts", f"""{_PLACED}, used AS (SELECT DISTINCT doc_id FROM qrels JOIN placed USING (query_id) WHERE split IN ('development', 'quarantined', 'calibration')),
  touched AS (SELECT DISTINCT query_id FROM qrels JOIN used USING (doc_id)), reached AS (SELECT DISTINCT component FROM placed WHERE split IN ('development', 'quarantined', 'calibration'))
  SELECT src, count(*) AS n, count(CASE WHEN query_id NOT IN (SELECT query_id FROM touched) THEN 1 END) AS direct, count(CASE WHEN component NOT IN (SELECT component FROM reached) THEN 1 END) AS component_wide
  FROM placed WHERE split IN ('reserve', 'confirmation') GROUP BY src""")(
    lambda s, d: anchors.unseen_counts(_anchored(s, d).withColumn("split", F.when(F.col("split").isin("reserve", "confirmation"), "later").otherwise(F.col("split"))), evaluation(s, d).qrels, ["development", "quarantined", "calibration"], "later"))


def _orders(s: SparkSession, d: str, only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders (of these splits only, without texts, if given) as queries, split by priority, their customers as texts and their parts, which can repeat, as relevant documents."""
    comp = _component_table(s, d).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("query_id"), "component")
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("src"), F.col("o_custkey").cast("string").alias("norm"), F.col("o_orderpriority").alias("split"))
    rows = rows if only is None else rows.where(F.col("split").isin(*only)).drop("norm")
    return stored(rows.join(comp, "query_id"), "orders")[0], table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))


_ORDERS = f"WITH RECURSIVE {_COMP}, held AS (SELECT o_orderkey AS query_id, o_orderstatus AS src, o_custkey::VARCHAR AS norm, o_orderpriority AS split, component FROM orders JOIN comp ON node = o_orderkey * 2), rel AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS doc_id FROM lineitem)"
query("split_overlaps", f"""{_ORDERS}, keys AS (SELECT DISTINCT 'query' AS what, split, query_id::VARCHAR AS k FROM held UNION SELECT DISTINCT 'text', split, norm FROM held UNION SELECT DISTINCT 'component', split, component::VARCHAR FROM held
    UNION SELECT DISTINCT 'document', split, doc_id::VARCHAR FROM held JOIN rel USING (query_id))
  SELECT a.what AS what, a.split AS a, b.split AS b, count(*) AS shared FROM keys AS a JOIN keys AS b ON a.what = b.what AND a.k = b.k AND a.split < b.split GROUP BY ALL""")(
    lambda s, d: anchors.split_overlaps(*_orders(s, d)))
query("unseen_orders", f"""{_ORDERS}, used AS (SELECT DISTINCT doc_id FROM rel JOIN held USING (query_id) WHERE split = '1-URGENT'), touched AS (SELECT DISTINCT query_id FROM rel JOIN used USING (doc_id)),
  reached AS (SELECT DISTINCT component FROM held WHERE split = '1-URGENT')
  SELECT h.query_id, src, t.query_id IS NULL AS direct, r.component IS NULL AS component_wide FROM held AS h LEFT JOIN touched AS t ON t.query_id = h.query_id LEFT JOIN reached AS r ON r.component = h.component WHERE split = '5-LOW'""")(
    lambda s, d: anchors.unseen(*_orders(s, d, ("1-URGENT", "5-LOW")), ["1-URGENT"], "5-LOW"))


def _cohort(s: SparkSession, d: str) -> DataFrame:
    """Features with the cohort, 0 to 2, of each query: a hash of its component, so that cohorts share no relevant document."""
    e = evaluation(s, d)
    norm = F.lower(F.trim("query")).alias("norm")
    at = (F.conv(F.substring(F.md5("component"), 1, 8), 16, 10).cast("long") % 3).alias("cohort")
    # Components come from labels; the cohorts that they make are part of the design, and were cut from what made them.
    return e.predictions.drop("p").join(e.queries.select("query_id", norm), "query_id").join(e.components.select("query_id", at), "query_id")


def _frozen(s: SparkSession, d: str) -> study.Frozen:
    e, rows = evaluation(s, d), _cohort(s, d)
    train = rows.where("cohort = 0").join(study.labelled(e.gain.select("query_id", "d"), "d"), "query_id")
    return study.freeze(train, rows.where("cohort = 1"), "d", e.qrels, (0.25, 0.5, 0.75))


_STUDY = f"""WITH RECURSIVE {_RBASE}, {EVAL}, {_QCOMP}, coh AS (SELECT f.*, ('0x' || substr(md5(component), 1, 8))::BIGINT % 3 AS cohort FROM features AS f JOIN qc USING (query_id)),
  fitted AS (SELECT coh.*, x.d FROM coh JOIN gain AS x USING (query_id) WHERE cohort = 0), {_ridge('fitted')},
  guess AS (SELECT coh.*, round(md{''.join(f' + ({f} - m{i}) / c{i} * w{i}' for i, f in enumerate(router.FEATURES))}, 9) AS p FROM coh, m, c, w),
  lim AS ({' UNION ALL '.join(f"SELECT 'utility_{int(b * 100)}' AS policy, percentile_cont({1 - b}) WITHIN GROUP (ORDER BY p) AS t FROM guess WHERE cohort = 1" for b in (0.25, 0.5, 0.75))})"""


@query("frozen_router", f"{_STUDY} {_COEF.format(n='item', v='value')} UNION ALL SELECT 'threshold ' || policy, round(t, 7) FROM lim UNION ALL SELECT 'calls ' || policy, count(CASE WHEN p > t THEN 1 END)::DOUBLE FROM lim, guess WHERE cohort = 1 GROUP BY policy")
def _frozen_router(s: SparkSession, d: str) -> DataFrame:
    """A router fitted on one cohort, its thresholds, and the calls that these let through of another, whose labels aren't read."""
    f = _frozen(s, d)
    rows = [*_coefficients(f.model), *[(f"threshold utility_{int(b * 100)}", round(t, 7)) for b, t in f.thresholds.items()], *[(f"calls utility_{int(b * 100)}", float(f.evidence["calibration"][f"calls {b}"])) for b in f.thresholds]]
    return s.createDataFrame(rows, "item string, value double")


@query("frozen_confirmation", f"""{_STUDY}, dec AS (SELECT query_id, 'fixed_disagreement' AS policy, top1_disagreement > 0 AS rerank FROM guess WHERE cohort = 2 UNION ALL SELECT query_id, 'cheap_jaccard', jaccard10 < 0.5e0 FROM guess WHERE cohort = 2
    UNION ALL SELECT query_id, 'never', FALSE FROM guess WHERE cohort = 2 UNION ALL SELECT query_id, 'always', TRUE FROM guess WHERE cohort = 2 UNION ALL SELECT query_id, policy, p > t FROM guess, lim WHERE cohort = 2)
  SELECT policy, count(*) AS n, round(avg(CASE WHEN rerank THEN after ELSE base END), 9) AS ndcg10, count(CASE WHEN rerank THEN 1 END) AS calls, 20 * count(CASE WHEN rerank THEN 1 END) AS pairs FROM dec JOIN gain USING (query_id) GROUP BY policy""")
def _frozen_confirmation(s: SparkSession, d: str) -> DataFrame:
    """What the frozen router's written decisions gain on a third cohort, whose labels are read after they were written."""
    e, folder = evaluation(s, d), f"{ensure_checkpoint_dir(s).rstrip('/')}/study-{uuid.uuid4().hex}"
    conf = _cohort(s, d).where("cohort = 2")
    name = study.write_frozen(s, _frozen(s, d), folder)
    digest = study.freeze_decisions(conf, folder, name)
    gain = e.gain.join(conf.select("query_id"), "query_id", "left_semi")
    out = cut(study.confirm(gain, folder, name, digest).select("policy", "n", *nine("ndcg10"), "calls", "pairs"))
    forget(s, folder)
    return out


#: The gate's checks: relation, rule, what they need. That something is found for every query is a rule that may well fail.
_CHECKS = [
    gate.Check("corpus", "documents", "doc_id IS NULL"), gate.Check("rankings", "places", "n <> top OR spots <> n OR ids <> n", ("corpus",)), gate.Check("gold", "unknown", "true", ("corpus",), 0),
    gate.Check("prefix", "ranks", f"(h IS NULL) <> (r IS NULL) OR (h <= {PREFIX}) <> (r <= {PREFIX}) OR (h > {PREFIX} AND h <> r)", ("rankings",)), gate.Check("predictions", "routes", "p IS NULL OR abs(p) > 1", ("rankings",)),
    gate.Check("routes", "routes", "rerank <> (p > threshold)", ("predictions",)), gate.Check("gains", "gains", "base < 0 OR after > 1 OR abs(after - base - d) > 1e-12", ("gold", "prefix")),
    gate.Check("found", "gains", "after <= 0", ("gains",)), gate.Check("conclusion", "routes", "policy IS NULL", ("found", "routes"))]
_GATED = {
    "documents": "SELECT doc_id FROM corpus", "places": "SELECT method, query_id, count(*) AS n, max(rank) AS top, count(DISTINCT rank) AS spots, count(DISTINCT doc_id) AS ids FROM rankings GROUP BY ALL",
    "unknown": "SELECT DISTINCT doc_id FROM qrels ANTI JOIN corpus USING (doc_id)", "ranks": "SELECT h.rank AS h, r.rank AS r FROM hybrid AS h FULL JOIN reranked AS r ON r.query_id = h.query_id AND r.doc_id = h.doc_id",
    "routes": "SELECT d.query_id, d.policy, rerank, p, t AS threshold FROM decisions AS d JOIN pred USING (query_id) JOIN th ON d.policy = 'utility_' || (budget * 100)::INT::VARCHAR", "gains": "SELECT base, after, d FROM gain"}
_TOLD = "VALUES " + ", ".join(f"('{c.name}', '{c.over}', {c.at_least})" for c in _CHECKS)


@query("completion_gate", f"""WITH RECURSIVE {_RBASE}, {EVAL}, {', '.join(f'{n}_of AS ({q})' for n, q in _GATED.items())},
  told AS (SELECT * FROM ({_TOLD}) AS t("check", "over", least)), needs AS (SELECT * FROM (VALUES {', '.join(f"('{c.name}', '{n}')" for c in _CHECKS for n in c.needs)}) AS t(c, need)),
  got AS ({' UNION ALL '.join(f"SELECT '{c.name}' AS c, count(*) AS n, count(CASE WHEN coalesce({c.breaks}, TRUE) THEN 1 END) AS broken FROM {c.over}_of" for c in _CHECKS)}),
  bad(c) AS (SELECT c FROM got JOIN told ON "check" = c WHERE broken > 0 OR n < least UNION SELECT needs.c FROM bad JOIN needs ON need = bad.c)
  SELECT "check", "over", CASE WHEN c IN (SELECT needs.c FROM needs JOIN bad ON need = bad.c) THEN 'blocked' WHEN n < least THEN 'missing' WHEN broken > 0 THEN 'failed' ELSE 'passed' END AS status, broken, n AS rows
  FROM got JOIN told ON "check" = c""")
def _completion_gate(s: SparkSession, d: str) -> DataFrame:
    """Whether the evaluation's relations hold together, a row a check."""
    e = evaluation(s, d)
    ranks = lambda m, n: getattr(e, m).select("query_id", "doc_id", F.col("rank").alias(n))
    at = e.thresholds.select(F.concat(F.lit("utility_"), F.round(F.col("budget") * 100).cast("int").cast("string")).alias("policy"), "threshold")
    relations = {
        "documents": e.docs.select("doc_id"), "places": e.rankings.groupBy("method", "query_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("spots"), F.count_distinct("doc_id").alias("ids")),
        "unknown": checks.missing_gold(e.qrels, e.docs), "ranks": ranks("hybrid", "h").join(ranks("reranked", "r"), ["query_id", "doc_id"], "full_outer").select("h", "r"),
        "routes": e.decisions.join(e.predictions.select("query_id", "p"), "query_id").join(F.broadcast(at), "policy").select("query_id", "policy", "rerank", "p", "threshold"), "gains": e.gain.select("base", "after", "d")}
    return gate.gate(s, relations, _CHECKS).drop("digest")


@query("stream_latency", """SELECT date_trunc('day', ts) AS window_start, event_type AS policy, count(*) AS n, round(sum(value), 6) AS total_ms, max(value) AS max_ms FROM events GROUP BY ALL""")
def _stream(s: SparkSession, d: str) -> DataFrame:
    """All events as a stream, with daily windows in UTC."""
    events = read_events(s, d, "events.parquet")
    got = drain(latency_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), late=None), s)
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "policy", "n", F.round("total_ms", 6).alias("total_ms"), "max_ms")


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_DUCK)
