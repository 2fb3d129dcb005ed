"""Retrieval metrics over long ranking relations, a query set at a time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Differences up to this count as none.
EVEN = 1e-12


def ideal_gains(k: int) -> list[float]:
    """Discounted gain of the first n ranks, for n from 0 to k."""
    return [0.0, *accumulate(1 / log2(n + 1) for n in range(1, k + 1))]


def evaluate(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = (10,)) -> DataFrame:
    """(query_id, method, k, gold, first_rank, recall, mrr, rr, ndcg, coverage) for each query of `queries`, method and k.

    rankings: (method, query_id, doc_id, rank from 1); qrels: (query_id, doc_id), distinct. Methods without a result for a
    query, and queries without relevant documents, score 0; rankings of other queries are ignored; k below 1 scores 0. mrr
    looks at the first k only, rr at the whole ranking; coverage is 1 where all relevant documents are among the first k.
    """
    cutoffs = F.explode(F.array(*[F.lit(int(k)) for k in ks])) if ks else F.explode(F.array().cast("array<int>"))
    gold = qrels.groupBy("query_id").agg(F.count("*").alias("gold"))
    hits = rankings.join(qrels, ["query_id", "doc_id"]).select("method", "query_id", "doc_id", "rank", cutoffs.alias("k"))
    inside = F.col("rank") <= F.col("k")
    got = hits.groupBy("method", "query_id", "k").agg(F.min("rank").alias("first_rank"), F.count_distinct(F.when(inside, F.col("doc_id"))).alias("found"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"))
    methods = rankings.select("method").distinct()  # a row a method
    grid = queries.select("query_id").join(F.broadcast(methods)).select("*", cutoffs.alias("k"))
    all_ = grid.join(gold, "query_id", "left").join(got, ["method", "query_id", "k"], "left")
    most = max([0, *ks])
    ideal = F.element_at(F.array(*[F.lit(x) for x in ideal_gains(most)]), F.least(F.col("gold"), F.col("k")).cast("int") + 1)
    some = (F.col("gold") > 0) & (F.col("k") > 0)
    first = F.col("first_rank")
    return all_.select(
        "query_id", "method", "k", F.coalesce("gold", F.lit(0)).alias("gold"), "first_rank",
        F.when(some, F.coalesce("found", F.lit(0)) / F.col("gold")).otherwise(0.0).alias("recall"),
        F.when(first <= F.col("k"), 1.0 / first).otherwise(0.0).alias("mrr"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"),
        F.when(some, F.coalesce("gain", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        F.when(some & (F.col("found") == F.col("gold")), 1.0).otherwise(0.0).alias("coverage"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """Means by method and k over all queries."""
    return per_query.groupBy("method", "k").agg(*[F.avg(c).alias(c) for c in ("recall", "mrr", "rr", "ndcg", "coverage")], F.count("*").alias("n"))


def gains(per_query: DataFrame, before: str = "hybrid", after: str = "reranked") -> DataFrame:
    """(query_id, base, after, d, rb, ra): nDCG of two methods, its difference, and their first relevant ranks."""
    b = per_query.where(F.col("method") == before).select("query_id", F.col("ndcg").alias("base"), F.col("first_rank").alias("rb"))
    a = per_query.where(F.col("method") == after).select("query_id", F.col("ndcg").alias("after"), F.col("first_rank").alias("ra"))
    return b.join(a, "query_id").select("query_id", "base", "after", (F.col("after") - F.col("base")).alias("d"), "rb", "ra")


def outcome(d: Column) -> Column:
    return F.when(d > EVEN, "win").when(d < -EVEN, "loss").otherwise("tie")


def rank_effect(before: Column, after: Column) -> Column:
    """improved, hurt, unchanged, or unchanged_missing where neither has a rank."""
    return F.when(before.isNull() & after.isNull(), "unchanged_missing").when(before.isNull() | (after < before), "improved").when(after.isNull() | (after > before), "hurt").otherwise("unchanged")


def transition(before: Column, after: Column, cutoff: int = 10) -> Column:
    """How a document moved across or beside the cutoff; absent where neither ranking has it. One rank alone is an error, here null."""
    both = before.isNotNull() & after.isNotNull()
    move = F.when((before <= cutoff) & (after > cutoff), f"left_top{cutoff}").when((before > cutoff) & (after <= cutoff), f"entered_top{cutoff}").when(before > cutoff, f"outside_top{cutoff}")
    move = move.when(after < before, "raised").when(after > before, "lowered").otherwise("kept")
    return F.when(before.isNull() & after.isNull(), "absent").when(both, move)


def rank_of(rankings: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, doc_id) with the rank of the document, null where it isn't ranked."""
    return wanted.join(rankings.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
