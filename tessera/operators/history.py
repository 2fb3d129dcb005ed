"""Audits of rank tables: one row a query, one nullable rank a system."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import EVEN, rank_effect
from tessera.operators.stats import interval, sign_test, weighted_bootstrap


def _rr(system: str):
    return F.coalesce(1.0 / F.col(f"{system}_rank"), F.lit(0.0))


def _interval(rows: DataFrame, value, resamples: int, seed: str):
    one = rows.select(F.lit("all").alias("g"), "query_id", value.alias("v"))
    return interval(weighted_bootstrap(one, "g", "query_id", ["v"], resamples, seed), "v").first()


def system_summary(ranks: DataFrame, systems: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """(system, n, found, mrr, low, high): mean reciprocal rank (a missing rank counts 0) and its bootstrap interval."""
    rows = []
    for s in systems:
        m = ranks.agg(F.count("*").alias("n"), F.count(f"{s}_rank").alias("found"), F.avg(_rr(s)).alias("mrr")).first()
        ci = _interval(ranks, _rr(s), resamples, f"{seed}|{s}")
        rows.append((s, m.n, m.found, m.mrr, ci.low, ci.high))
    return ranks.sparkSession.createDataFrame(rows, "system string, n long, found long, mrr double, low double, high double")


def comparisons(ranks: DataFrame, pairs: Sequence[tuple[str, str]], resamples: int, seed: str) -> DataFrame:
    """(before, after, delta, low, high, wins, losses, ties, p_value): paired differences of the reciprocal ranks."""
    rows = []
    for a, b in pairs:
        d = _rr(b) - _rr(a)
        m = ranks.agg(F.avg(d).alias("d"), F.count_if(d > EVEN).alias("w"), F.count_if(d < -EVEN).alias("l"), F.count("*").alias("n")).first()
        ci = _interval(ranks, d, resamples, f"{seed}|{a}|{b}")
        rows.append((a, b, m.d, ci.low, ci.high, m.w, m.l, m.n - m.w - m.l, sign_test(m.w, m.l)))
    return ranks.sparkSession.createDataFrame(rows, "before string, after string, delta double, low double, high double, wins long, losses long, ties long, p_value double")


def claim_differences(summary: DataFrame, claims: Mapping[str, float], decimals: int = 3) -> DataFrame:
    """(system, claimed, computed): claimed means that aren't the computed ones at that number of decimals."""
    want = summary.sparkSession.createDataFrame(list(claims.items()), "system string, claimed double")
    return want.join(summary.select("system", F.col("mrr").alias("computed")), "system", "left").where(~F.round("claimed", decimals).eqNullSafe(F.round("computed", decimals)))


def effects_by_step(ranks: DataFrame, systems: Sequence[str]) -> DataFrame:
    """(query_id, step, effect, place): each step from a system to the next; hurt first, then improved, unchanged, missing."""
    order = F.create_map(*[F.lit(x) for p in (("hurt", 0), ("improved", 1), ("unchanged", 2), ("unchanged_missing", 3)) for x in p])
    steps = [ranks.select("query_id", F.lit(f"{a} to {b}").alias("step"), rank_effect(F.col(f"{a}_rank"), F.col(f"{b}_rank")).alias("effect")) for a, b in zip(systems, systems[1:])]
    return reduce(DataFrame.unionByName, steps).withColumn("place", order[F.col("effect")])
