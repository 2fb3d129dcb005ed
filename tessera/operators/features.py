"""Routing features of two first-stage rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators.fusion import weighted_rrf

DEEP, SHALLOW, RRF_K = 20, 10, 60


def leg_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, top1_disagreement, jaccard10, jaccard20, rank_overlap, coherence) of two rankings (query_id, doc_id, rank).

    One full outer join of the first DEEP of each; a document that one of them lacks ranks behind its last there.
    """
    x = a.where(F.col("rank") <= DEEP).select("query_id", "doc_id", F.col("rank").alias("ra"))
    y = b.where(F.col("rank") <= DEEP).select("query_id", "doc_id", F.col("rank").alias("rb"))
    both, ra, rb = x.join(y, ["query_id", "doc_id"], "full_outer"), F.col("ra"), F.col("rb")
    near = lambda c: F.coalesce(c <= SHALLOW, F.lit(False))
    wa, wb = F.coalesce(1.0 / ra, F.lit(0.0)), F.coalesce(1.0 / rb, F.lit(0.0))
    gap = F.abs(F.coalesce(ra, F.lit(DEEP + 1)) - F.coalesce(rb, F.lit(DEEP + 1)))
    return both.groupBy("query_id").agg(
        F.when(F.max((ra == 1) & (rb == 1)), 0.0).otherwise(1.0).alias("top1_disagreement"),
        (F.count_if(near(ra) & near(rb)) / F.count_if(near(ra) | near(rb))).alias("jaccard10"),
        (F.count_if(ra.isNotNull() & rb.isNotNull()) / F.count("*")).alias("jaccard20"),
        (F.sum(F.least(wa, wb)) / F.sum(F.greatest(wa, wb))).alias("rank_overlap"),
        (1 - F.avg(gap.cast("double")) / DEEP).alias("coherence"),
    )


def fused_margin(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, margin): how far the best fused score is ahead of the second, as a share of it; 1 for a single document."""
    top = weighted_rrf([a, b], k=RRF_K).where("rank <= 2").groupBy("query_id").agg(F.max("score").alias("first"), F.min("score").alias("second"), F.count("*").alias("n"))
    return top.select("query_id", F.when(F.col("n") == 1, 1.0).otherwise((F.col("first") - F.col("second")) / F.col("first")).alias("margin"))


def router_features(queries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The seven features of each query (query_id, query) that has a ranking: no label is read."""
    size = queries.select("query_id", F.log1p(word_count(F.col("query")).cast("double")).alias("log_words"))
    return leg_features(a, b).join(fused_margin(a, b), "query_id").join(size, "query_id")
