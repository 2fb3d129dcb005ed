"""Latency of policies from events of repeated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.stats import weighted_bootstrap


def repetitions(events: DataFrame, query: str, policy: str, ms: str, time: str, id_col: str) -> DataFrame:
    """(query_id, policy, ms, repetition): events of a query and policy numbered in time."""
    by = W.partitionBy("query_id", "policy").orderBy("at", "id")
    rows = events.select(F.col(query).alias("query_id"), F.col(policy).alias("policy"), F.col(ms).alias("ms"), F.col(time).alias("at"), F.col(id_col).alias("id"))
    return rows.withColumn("repetition", F.row_number().over(by)).drop("at", "id")


def summary(rows: DataFrame, by: str = "policy") -> DataFrame:
    """Number, mean, median and 95th percentile (linear) of ms."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))


def against(rows: DataFrame, baseline: str) -> DataFrame:
    """(query_id, policy, ms, base): means over a query's repetitions, of each other policy and of the baseline for the same query.

    Queries that lack one of the two are left out of that comparison.
    """
    each = rows.groupBy("query_id", "policy").agg(F.avg("ms").alias("ms"))
    base = each.where(F.col("policy") == baseline).select("query_id", F.col("ms").alias("base"))
    return each.where(F.col("policy") != baseline).join(base, "query_id")


def reductions(rows: DataFrame) -> DataFrame:
    """(policy, units, delta_ms, reduction) of `against`."""
    return rows.groupBy("policy").agg(F.count("*").alias("units"), F.avg(F.col("ms") - F.col("base")).alias("delta_ms"), (1 - F.sum("ms") / F.sum("base")).alias("reduction"))


def reduction_intervals(rows: DataFrame, resamples: int, seed: str, strata: str | None = None, level: float = 0.95) -> DataFrame:
    """(policy, delta_low, delta_high, reduction_low, reduction_high): percentile intervals over resampled queries.

    rows: (query_id, policy, ms, base), and strata, which weigh alike. The query is the unit, after its repetitions were averaged,
    and has one weight in all policies of a replicate.
    """
    rows = rows if strata else rows.withColumn("all_rows", F.lit("all"))
    got = weighted_bootstrap(rows, strata or "all_rows", "query_id", ["ms", "base"], resamples, seed, ["policy"])
    tail, delta, cut_ = (1 - level) / 2, F.col("ms") - F.col("base"), 1 - F.col("ms") / F.col("base")
    return got.groupBy("policy").agg(*[F.percentile(c, p).alias(n) for c, p, n in ((delta, tail, "delta_low"), (delta, 1 - tail, "delta_high"), (cut_, tail, "reduction_low"), (cut_, 1 - tail, "reduction_high"))])


def violations(rows: DataFrame, repetitions_: int) -> DataFrame:
    """(id, rule): events (query_id, policy, repetition from 0, total_ms, reranked, scored_pairs, src) that break a rule."""
    own = F.when(F.col("total_ms").isNull() | F.isnan("total_ms") | (F.col("total_ms") <= 0) | (F.col("total_ms") == float("inf")), "latency not positive and finite")
    own = own.when(F.col("scored_pairs") < 0, "negative pairs").when(F.col("reranked") != (F.col("scored_pairs") > 0), "calls and pairs disagree")
    single = rows.select(F.col("query_id").alias("id"), own.alias("rule")).where("rule IS NOT NULL")
    per = rows.groupBy("query_id", "policy").agg(F.count("*").alias("n"), F.count_distinct("repetition").alias("r"), F.min("repetition").alias("lo"), F.max("repetition").alias("hi"), F.count_distinct("reranked").alias("routes"))
    rule = F.when((F.col("n") != repetitions_) | (F.col("r") != repetitions_) | (F.col("lo") != 0) | (F.col("hi") != repetitions_ - 1), "repetitions incomplete").when(F.col("routes") > 1, "routing changes")
    many = per.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    src = rows.groupBy(F.col("query_id").alias("id")).agg(F.count_distinct("src").alias("n")).where("n > 1").select("id", F.lit("sources disagree").alias("rule"))
    return single.unionByName(many).unionByName(src)
