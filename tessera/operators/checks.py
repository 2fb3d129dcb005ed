"""Constraint checks: each returns the rows that break a rule, as (id, rule); none means that all hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fusion import weighted_rrf
from tessera.plans.skew import among, lookup_join


def _all(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def require_none(violations: DataFrame) -> None:
    """Raises with the first few violations, if there are any."""
    if got := violations.orderBy("rule", "id").take(5):
        raise ValueError("; ".join(f"{r.rule}: {r.id}" for r in got))


def cache_violations(cache: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rules of a ranking cache: query_id, relevant_ids, bm25, dense, hybrid, reranked (arrays of ids) and rerank_k.

    Ids are given once; gold isn't empty and, like all rankings, within the corpus (doc_id); rerank_k lies in 1 .. the hybrid
    ranking's length; the re-ranked prefix is a permutation of the hybrid's, the tail the same.
    """
    legs = ("bm25", "dense", "hybrid", "reranked")
    k = F.col("rerank_k")
    prefix = lambda c: F.sort_array(F.expr(f"slice({c}, 1, greatest(rerank_k, 0))"))
    tail = lambda c: F.expr(f"slice({c}, greatest(rerank_k, 0) + 1, size({c}))")
    rules: dict[str, Column] = {"no gold": F.coalesce(F.size("relevant_ids"), F.lit(0)) < 1, "depth out of range": (k < 1) | (k > F.size("hybrid")) | k.isNull()}
    rules |= {f"repeated in {c}": F.size(F.array_distinct(c)) < F.size(c) for c in legs}
    rules |= {f"missing {c}": F.col(c).isNull() for c in legs}
    rules |= {"prefix is no permutation": prefix("hybrid") != prefix("reranked"), "tail differs": tail("hybrid") != tail("reranked")}
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    own = cache.select(F.col("query_id").alias("id"), F.explode(broken).alias("rule"))
    twice = cache.groupBy(F.col("query_id").alias("id")).count().where("count > 1").select("id", F.lit("repeated query").alias("rule"))
    used = cache.select(F.col("query_id").alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array()) for c in ("relevant_ids", *legs)])))).alias("doc_id"))
    unknown = used.join(corpus.select("doc_id"), "doc_id", "left_anti").select("id", F.lit("unknown document").alias("rule")).distinct()
    return _all([own, twice, unknown])


def shared_between_splits(rows: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """Values of any of the keys that occur in more than one split; nulls are no values."""
    per = lambda c: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("id")).agg(F.count_distinct(split).alias("n"))
    return _all([per(c).where("n > 1").select("id", F.lit(f"{c} in several splits").alias("rule")) for c in keys])


def prediction_violations(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each query has exactly one finite prediction (query_id, p), and each prediction a query."""
    n = predictions.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf"))).alias("odd"))
    both = queries.select("query_id", F.lit(1).alias("asked")).distinct().join(n, "query_id", "full_outer")
    rule = F.when(F.col("asked").isNull(), "no such query").when(F.col("n").isNull(), "no prediction").when(F.col("n") > 1, "repeated prediction").when(F.col("odd") > 0, "not finite")
    return both.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")


def rank_violations(ranks: DataFrame, system: str) -> DataFrame:
    """query_id, {system}_rank, {system}_rr: ranks start at 1, and the reciprocal is the rank's (0 without one) to 1e-12; ids once."""
    rank, rr = F.col(f"{system}_rank"), F.col(f"{system}_rr")
    rule = F.when(rank < 1, "rank below 1").when(rr.isNull() | (F.abs(rr - F.coalesce(F.lit(1.0) / F.nullif(rank, F.lit(0)), F.lit(0.0))) > 1e-12), "reciprocal differs")
    own = ranks.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    twice = ranks.groupBy(F.col("query_id").alias("id")).count().where("count > 1").select("id", F.lit("repeated query").alias("rule"))
    return own.unionByName(twice)


def missing_gold(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Relevant documents that the corpus lacks."""
    return qrels.join(corpus.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("unknown document").alias("rule")).distinct()


def pair_tokens(queries: DataFrame, docs: DataFrame, pairs: DataFrame, budget: int, special: int, tokenize) -> DataFrame:
    """(query_id, doc_id, n_query, n_doc, kept_query, kept_doc, truncated): tokens of a pair under `budget`, longest side first.

    `special` tokens are the pair's own. The longer side is cut until both fit; equal lengths lose from the document first.
    """
    q = queries.select("query_id", F.size(tokenize(F.col("query"))).alias("n_query"))
    d = among(docs, pairs, "doc_id").select("doc_id", F.size(tokenize(F.col("text"))).alias("n_doc"))
    both = lookup_join(lookup_join(pairs.select("query_id", "doc_id"), q, ["query_id"]), d, ["doc_id"])
    room, a, b = max(budget - special, 0), F.col("n_query"), F.col("n_doc")
    half = (room + 1) // 2
    kept_q = F.when(a + b <= room, a).when(a <= b, F.least(a, F.lit(half))).otherwise(F.greatest(F.lit(room) - b, F.lit(half)))
    kept_q = F.least(kept_q, a)
    kept_d = F.when(a + b <= room, b).otherwise(F.least(b, F.lit(room) - kept_q))
    return both.select("*", kept_q.cast("int").alias("kept_query"), kept_d.cast("int").alias("kept_doc"), (a + b > room).alias("truncated"))


def fusion_violations(cache: DataFrame, k: float = 60) -> DataFrame:
    """Queries of a cache (query_id, bm25, dense, hybrid) whose hybrid ranking isn't the fusion of the two others."""
    leg = lambda c: cache.select("query_id", F.posexplode(c).alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)
    again = weighted_rrf([leg("bm25"), leg("dense")], k=k).select("query_id", "doc_id", F.col("rank").alias("now"))
    both = again.join(leg("hybrid"), ["query_id", "doc_id"], "full_outer").where(~F.col("now").eqNullSafe(F.col("rank")))
    return both.select(F.col("query_id").alias("id"), F.lit("fusion differs").alias("rule")).distinct()


def timing_violations(rows: DataFrame, timings: str, wanted: Sequence[str]) -> DataFrame:
    """Rows (query_id, a map of milliseconds by name) that lack a wanted name or hold a negative or non-finite time."""
    t = F.col(timings)
    lacks = F.exists(F.array(*map(F.lit, wanted)), lambda n: ~F.coalesce(F.map_contains_key(t, n), F.lit(False)))
    odd = F.exists(F.map_values(t), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    rule = F.when(t.isNull() | lacks, "timing missing").when(odd, "timing negative or not finite")
    return rows.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")


def count_violations(rows: DataFrame, by: str, declared: Mapping[str, int]) -> DataFrame:
    """Groups whose number of rows isn't the declared one; groups that aren't declared count as declared empty."""
    want = rows.sparkSession.createDataFrame([(k, int(v)) for k, v in declared.items()], "id string, want long")
    have = rows.groupBy(F.col(by).cast("string").alias("id")).agg(F.count("*").alias("n"))
    both = have.join(want, "id", "full_outer").where(F.coalesce("n", F.lit(0)) != F.coalesce("want", F.lit(0)))
    return both.select("id", F.lit("number differs").alias("rule"))


def alignment_violations(cache: DataFrame, prepared: DataFrame) -> DataFrame:
    """Queries that only one of two tables (query_id, src, relevant_ids) has, or whose source or set of relevant ids differs."""
    side = lambda df, n: df.select("query_id", F.struct("src", F.array_sort(F.array_distinct("relevant_ids"))).alias(n))
    both = side(cache, "a").join(side(prepared, "b"), "query_id", "full_outer")
    rule = F.when(F.col("a").isNull(), "not in the cache").when(F.col("b").isNull(), "not prepared").when(F.col("a") != F.col("b"), "differs from the prepared query")
    return both.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")


def cohort_violations(cache: DataFrame, depth: int = 100, rerank_k: int = 20, split: str | None = None) -> DataFrame:
    """Rows whose legs don't have `depth` documents or whose prefix isn't rerank_k, and rows of another split than the given one."""
    rule = F.when((F.size("bm25") != depth) | (F.size("dense") != depth) | F.col("bm25").isNull() | F.col("dense").isNull(), "legs of another depth").when(F.col("rerank_k") != rerank_k, "prefix of another depth")
    found = cache.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    return found if split is None else found.unionByName(cache.where(~F.col("split").eqNullSafe(F.lit(split))).select(F.col("query_id").alias("id"), F.lit("another split").alias("rule")))
