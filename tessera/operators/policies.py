"""Policies that choose which queries are re-ranked, and what they gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.metrics import EVEN

#: Pairs that a re-ranked query costs.
PAIRS = 20


def calibrate(predictions: DataFrame, budgets: Sequence[float], p: str = "p") -> DataFrame:
    """(budget, threshold): the linear quantile of the predictions above which that share of them lies; no labels are read."""
    got = predictions.agg(*[F.percentile(p, 1 - b).alias(f"t{i}") for i, b in enumerate(budgets)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("budget"), F.col(f"t{i}").alias("threshold")) for i, b in enumerate(budgets)])
    return got.select(F.inline(rows))


def decide(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(query_id, src, policy, rerank): two gates on features, never, always, and utility above each budget's threshold.

    predictions: (query_id, src, top1_disagreement, jaccard10, p). Thresholds are strict: ties aren't re-ranked.
    """
    gates = {"fixed_disagreement": F.col("top1_disagreement") > 0, "cheap_jaccard": F.col("jaccard10") < 0.5, "never": F.lit(False), "always": F.lit(True)}
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("rerank")) for n, c in gates.items()])
    fixed = predictions.select("query_id", "src", F.inline(rows))
    name = F.concat(F.lit("utility_"), F.round(F.col("budget") * 100).cast("int").cast("string"))
    routed = predictions.join(F.broadcast(thresholds)).select("query_id", "src", name.alias("policy"), (F.col("p") > F.col("threshold")).alias("rerank"))
    return fixed.unionByName(routed)


def _with_all(df: DataFrame, keys: Sequence[str], over: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates by keys and `over`, and by keys alone, in one pass; `over` is then 'all'."""
    sets = df.groupingSets([[*keys, over], list(keys)], *keys, over).agg(*aggs, F.grouping(over).alias("total"))
    return sets.withColumn(over, F.when(F.col("total") == 1, "all").otherwise(F.col(over))).drop("total")


def summarise(decided: DataFrame, by_source: bool = False) -> DataFrame:
    """decided: (query_id, src, policy, rerank, base, after). Mean nDCG, calls and pairs by policy, with sources and 'all' if asked."""
    aggs = [F.avg(F.when(F.col("rerank"), F.col("after")).otherwise(F.col("base"))).alias("ndcg10"), F.count_if("rerank").alias("calls"), (F.count_if("rerank") * PAIRS).alias("pairs")]
    return _with_all(decided, ["policy"], "src", aggs) if by_source else decided.groupBy("policy").agg(*aggs)


def effects(decided: DataFrame) -> DataFrame:
    """Harmful and beneficial skips and re-rankings by policy, the gain forgone and the harm avoided."""
    on, d = F.col("rerank"), F.col("d")
    return decided.groupBy("policy").agg(
        F.count_if(~on & (d > EVEN)).alias("harmful_skips"), F.count_if(~on & (d < -EVEN)).alias("beneficial_skips"), F.count_if(on & (d < -EVEN)).alias("harmful_reranks"), F.count_if(on & (d > EVEN)).alias("beneficial_reranks"),
        F.sum(F.when(~on, F.greatest(d, F.lit(0.0))).otherwise(0.0)).alias("forgone"), F.sum(F.when(~on, F.greatest(-d, F.lit(0.0))).otherwise(0.0)).alias("avoided"))


def routing_summary(decided: DataFrame) -> DataFrame:
    """Number and mean gain of re-ranked and bypassed queries, by policy and source, and over all sources."""
    return _with_all(decided, ["policy", "rerank"], "src", [F.count("*").alias("n"), F.avg("d").alias("mean_gain")])


def oracle_ceiling(decided: DataFrame, gain: DataFrame) -> DataFrame:
    """(policy, ndcg10): mean nDCG if each policy's calls went to the queries that gain most, ties to the smaller id."""
    calls = decided.groupBy("policy").agg(F.count_if("rerank").alias("calls"))
    top = gain.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("d", 9)), "query_id")))
    return top.join(F.broadcast(calls)).groupBy("policy").agg(F.avg(F.col("base") + F.when(F.col("place") <= F.col("calls"), F.col("d")).otherwise(0.0)).alias("ndcg10"))


def random_controls(decided: DataFrame, gain: DataFrame, seeds: Sequence[str], by_source: bool = False) -> DataFrame:
    """(policy, mean, low, high) over seeds: each draws as many queries as the policy re-ranks, by hash, in each source if asked."""
    strata = ["src"] if by_source else []
    calls = decided.groupBy("policy", *strata).agg(F.count_if("rerank").alias("calls"))
    drawn = gain.select("query_id", *strata, "d", "base", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    key = F.sha2(F.concat_ws("|", "seed", "query_id"), 256)
    drawn = drawn.withColumn("place", F.row_number().over(W.partitionBy("seed", *strata).orderBy(key, "query_id")))
    met = drawn.join(F.broadcast(calls), strata) if strata else drawn.join(F.broadcast(calls))
    each = met.groupBy("policy", "seed").agg(F.avg(F.col("base") + F.when(F.col("place") <= F.col("calls"), F.col("d")).otherwise(0.0)).alias("v"))
    return each.groupBy("policy").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def non_inferior(interval_lows: Sequence[float], calls: int, reference_calls: int, margin: float = 0.01) -> bool:
    """Whether all intervals of the difference lie above -margin and fewer calls are made."""
    return bool(interval_lows) and all(low > -margin for low in interval_lows) and calls < reference_calls
