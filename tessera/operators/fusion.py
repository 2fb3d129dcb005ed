"""Reciprocal-rank fusion and conditional re-ranking over long ranking relations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import plain_tokens
from tessera.operators.ranking import top_k
from tessera.plans.skew import among


def _legs(rankings: Sequence[DataFrame], weights: Sequence[float]) -> DataFrame:
    legs = [r.select("query_id", "doc_id", "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("leg")) for i, (r, w) in enumerate(zip(rankings, weights))]
    return reduce(DataFrame.unionByName, legs)


def weighted_rrf(rankings: Sequence[DataFrame], weights: Sequence[float] | None = None, k: float = 60, depth: int | None = None, first_seen: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): sum of w / (k + rank), ties by id, or with first_seen by the earliest leg and rank."""
    weights = [1.0] * len(rankings) if weights is None else list(weights)
    if not rankings or len(weights) != len(rankings) or k < 0:
        raise ValueError("one ranking at least, a weight for each, and k >= 0")
    legs = _legs(rankings, weights)
    legs = legs if depth is None else legs.where(F.col("rank") <= depth)
    fused = legs.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    return top_k(fused, ["query_id"], None, tie=F.col("seen") if first_seen else None).drop("seen")


def rerank_prefix(ranking: DataFrame, scores: DataFrame, depth: int = 20) -> DataFrame:
    """The first `depth` of each query by falling score, then id; the tail as it was. scores: (query_id, doc_id, pair_score).

    A candidate of the prefix without a finite score, or with two, fails the query as it runs.
    """
    r = ranking.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank")
    one = scores.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_scores"), F.max("pair_score").alias("pair_score"))
    r = r.join(one, ["query_id", "doc_id"], "left")
    odd = F.coalesce(F.col("n_scores") != 1, F.lit(True)) | F.col("pair_score").isNull() | F.isnan("pair_score") | (F.abs("pair_score") == float("inf"))
    fail = F.raise_error(F.concat(F.lit("one finite score is needed of query "), "query_id", F.lit(" and document "), "doc_id")).cast("double")
    score = F.when(odd, fail).otherwise(F.round("pair_score", 9))
    head = r.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "doc_id")).alias("rank"))
    return head.unionByName(ranking.where(F.col("rank") > depth).select("query_id", "doc_id", "rank"))


def rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): candidates (query_id, doc_id) by the scorer's falling score, then id; the first `top` (0 or less: none)."""
    return top_k(scorer(candidates.select("query_id", "doc_id")).withColumnRenamed("pair_score", "score"), ["query_id"], top)


def model_scorer(queries: DataFrame, docs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A pair scorer for rerank_prefix and gated_rerank that runs a model over Arrow batches.

    load is called once in each task's worker and returns a function of query texts and document texts to their scores.
    """

    def score(pairs: DataFrame) -> DataFrame:
        both = pairs.select("query_id", "doc_id").join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")

        def run(batches):
            model = load()
            for b in batches:
                got = pa.array([float(x) for x in model(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], names=["query_id", "doc_id", "pair_score"])

        return both.select("query_id", "doc_id", "query", "text").mapInArrow(run, "query_id string, doc_id string, pair_score double")

    return score


def ranking_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, n): rows that a has n times more than b (n below 0: less); none means that they are equal."""
    side = lambda r, n: r.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("n"))
    return side(a, 1).unionByName(side(b, -1)).groupBy("query_id", "doc_id", "rank").agg(F.sum("n").alias("n")).where("n <> 0")


def gated_rerank(ranking: DataFrame, routed: DataFrame, scorer, depth: int = 20) -> DataFrame:
    """Only routed queries (query_id) reach the scorer: filter, score, union; others keep their ranking."""
    yes, no = ranking.join(routed, "query_id", "left_semi"), ranking.join(routed, "query_id", "left_anti")
    pairs = yes.where(F.col("rank") <= depth).select("query_id", "doc_id")
    return rerank_prefix(yes, scorer(pairs), depth).unionByName(no.select("query_id", "doc_id", "rank"))


def token_overlap(pairs: DataFrame, queries: DataFrame, docs: DataFrame, tokenize) -> DataFrame:
    """A deterministic pair scorer: share of the query's distinct tokens that the document has."""
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("qt"))
    d = among(docs, pairs, "doc_id").select("doc_id", F.array_distinct(tokenize(F.col("text"))).alias("dt"))
    score: Column = F.size(F.array_intersect("qt", "dt")) / F.greatest(F.size("qt"), F.lit(1))
    return pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", score.alias("pair_score"))


def overlap_scorer():
    """`token_overlap` as a function of a query and its candidates' texts, for `runtime.execute`."""

    def score(query: str, texts: list[str]) -> list[float]:
        q = set(plain_tokens(query))
        return [len(q & set(plain_tokens(t))) / max(len(q), 1) for t in texts]

    return score
