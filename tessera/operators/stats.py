"""Paired statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import comb, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut
from tessera.plans.skew import lookup_join


#: Arithmetic of the weights' hashes: 2^31 - 1, and what is added in each round; units that a task weighs at once.
PRIME, ADDED, TILE = (1 << 31) - 1, 1_013_904_223, 64
#: Hashes from which a weight is one more: the distribution function of a Poisson variable of mean 1, in parts of PRIME.
POISSON = np.array([int(PRIME * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(10)])


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided p-value; ties are dropped beforehand."""
    n, k = wins + losses, min(wins, losses)
    return 1.0 if not n else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with its place (from 0) in the order of key: sorted in parts, then moved by the sizes of the parts before.

    Only one count a part reaches the driver.
    """
    part, at = F.shiftrightunsigned(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    rows = cut(df.orderBy(key).withColumn(name, F.monotonically_increasing_id()))
    sizes = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, before = [], 0
    for r in sizes:
        starts += [F.lit(r.part), F.lit(before)]
        before += r["count"]
    return rows.withColumn(name, at + F.create_map(*starts)[part]) if starts else rows


def hash_bootstrap(deltas: DataFrame, key: str, value: str, resamples: int, seed: str) -> DataFrame:
    """(replicate, mean): resamples of all rows with replacement; draw i of replicate r is row hash(seed, r, i) mod n.

    Replicates spread over the cluster, and any engine draws the same rows. Rows are numbered by key, which must be unique.
    """
    rows = numbered(deltas.select(F.col(key).alias("k"), F.col(value).alias("v")), "k", "i").select("i", "v")
    n = rows.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "r", "j")), 1, 8), 16, 10).cast("long") % max(n, 1)
    grid = deltas.sparkSession.range(resamples if n else 0).withColumnRenamed("id", "r").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    return lookup_join(grid.select("r", "j", draw.alias("i")), rows, ["i"]).groupBy("r").agg(F.avg("v").alias("mean"))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    return x


def _fifth(x: np.ndarray) -> np.ndarray:
    """x^5 + ADDED modulo PRIME: one to one, as 5 and PRIME - 1 have no common factor."""
    y = _mod(x * x)
    return _mod(_mod(y * y) * x + ADDED)


def unit_weights(units: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The weight of each unit (row) in each replicate (column), from their hashes below PRIME: Poisson draws of mean 1."""
    x = _fifth(_mod(units[:, None] + replicates[None]))
    x = _fifth(_mod(x + units[:, None]))
    return np.searchsorted(POISSON, x, side="right")


def _hash(*parts: Column | str) -> Column:
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % PRIME


def weighted_bootstrap(rows: DataFrame, strata: str, unit: str, values: Sequence[str], resamples: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, r, one column for each value): resampled means of the values, macro-averaged over the strata.

    Units (clusters of rows) get a weight in each replicate, a Poisson draw of mean 1 from hash(seed, unit) and hash(seed, r), for
    which draws with replacement stand where units are many; a stratum's mean is the weighted sum over its rows by their weighted
    number, or the plain one in replicates that weigh all of its units with 0. A weight doesn't depend on what else there is:
    values and groups share the draws, so that their replicates are paired, and any engine draws the same.

    One pass: a task adds up the weighted sums of its units for all replicates at once, and a row for each replicate and group
    leaves it. Nulls in values are left out of sums but count; an empty table has no replicates.
    """
    if isinstance(resamples, bool) or not isinstance(resamples, int) or resamples < 1:
        raise ValueError("resamples must be a positive integer")
    keys, m = [f"k{i}" for i in range(len(by))], len(values)
    sums = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(strata).alias("g"), F.col(unit).alias("u")).agg(*[F.sum(F.col(v).cast("double")).alias(f"v{i}") for i, v in enumerate(values)], F.count("*").alias("c"))
    sums = cut(sums.select(*keys, "g", F.coalesce(_hash(seed, F.col("u")), F.lit(0)).alias("h"), *[F.coalesce(f"v{i}", F.lit(0.0)).alias(f"v{i}") for i in range(m)], F.col("c").cast("double").alias("c")))
    groups = cut(sums.groupBy(*keys, "g").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(m)], F.sum("c").alias("c")).withColumn("at", F.monotonically_increasing_id()))
    values_c = [*[f"v{i}" for i in range(m)], "c"]

    def run(batches):
        r = np.fromiter((int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:8], 16) % PRIME for i in range(resamples)), np.int64, resamples)
        total: dict[int, np.ndarray] = {}
        for b in batches:
            group, h, x = b.column(0).to_numpy(), b.column(1).to_numpy(), np.stack([b.column(2 + i).to_numpy() for i in range(m + 1)])
            for at in range(0, len(h), TILE):
                w = unit_weights(h[at : at + TILE], r).astype(float)
                for g in np.unique(group[at : at + TILE]):
                    own = group[at : at + TILE] == g
                    total[int(g)] = total.get(int(g), 0) + x[:, at : at + TILE][:, own] @ w[own]
        for g, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, g)), pa.array(np.arange(resamples)), *[pa.array(c) for c in x]], names=["at", "r", *values_c])

    asked = lookup_join(sums, groups.select(*keys, "g", "at"), [*keys, "g"]).select("at", "h", *values_c)
    drawn = asked.mapInArrow(run, "at long, r long, " + ", ".join(f"{c} double" for c in values_c)).groupBy("at", "r").agg(*[F.sum(c).alias(f"w{c}") for c in values_c])
    each = lookup_join(drawn, groups, ["at"])
    mean = lambda i: F.when(F.col("wc") > 0, F.col(f"wv{i}") / F.col("wc")).otherwise(F.col(f"v{i}") / F.col("c"))
    means = each.groupBy(*keys, "r").agg(*[F.avg(mean(i)).alias(f"m{i}") for i in range(m)])
    return means.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "r", *[F.col(f"m{i}").alias(v) for i, v in enumerate(values)])


def interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """(low, high, resamples): the percentile interval."""
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.count("*").alias("resamples"))
