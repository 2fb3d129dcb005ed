"""Mixing sources to target weights (native DataFrame operations only).

Tokens are summed per source; water-filled targets give each source a repetition rate; each document comes out
floor(rate) times, plus one hash-seeded Bernoulli copy with probability equal to the fraction of the rate. Chance alone can
take too many of a source's long documents; so the draws are summed under SEEDS seeds in one grouped pass, and each source
takes the seed whose sum comes nearest to its target. All documents draw alike, at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.plans.lineage import cut
from tessera.plans.skew import lookup_join

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-v1"
#: Seeds that each source tries. The best of n misses by about 1.25 / n standard deviations of one draw's sum.
SEEDS = 32
#: Draws are h * a + b modulo this prime, for the hash h of a document and the numbers a, b of a seed.
PRIME = (1 << 31) - 1
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target) for sources in code point order, null last, weighing as `weights`, repeating.

    The level L solves sum(min(L * weight, ceiling * size)) = all sizes. With sources by rising ceiling / weight, the level
    if the first k are at their ceiling is (all - their ceilings) / remaining weight; its maximum over k is L. All of this
    runs over one row a source.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * ceiling)
    everything = W.partitionBy(F.lit(0))
    rising = everything.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    level = (F.sum("source_size").over(everything) - F.sum("cap").over(rising) + F.col("cap")) / (F.sum("w").over(everything) - F.sum("w").over(rising) + F.col("w"))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")).alias("target"))


def seed_numbers(n: int) -> list[tuple[int, int]]:
    """(a, b) of each seed, from its number."""
    h = [hashlib.md5(f"{SEED}|{i}".encode()).digest() for i in range(n)]
    return [(int.from_bytes(x[:4], "big") % (PRIME - 1) + 1, int.from_bytes(x[4:8], "big") % PRIME) for x in h]


def hashed(seed: str, key: Column) -> Column:
    """A number in [0, PRIME) from a hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 12), 16, 10).cast("long") % PRIME).cast("long")


def drawn(h: Column, a: Column | int, b: Column | int, frac: Column) -> Column:
    """Whether the document of hash h gets its further copy under the seed a, b: with probability frac."""
    return ((h * a + b) % PRIME) < frac * float(PRIME)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies, taken added (existing columns of these names are replaced).

    copies is how often the mix takes the row, at most `ceiling`. Reruns agree, and repeated rows share their fate; rows with
    a null id use their text. Null text has size 0, null source is a source, an empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", n_words(F.col(text_col)) if size is None else size)
    stats = cut(source_targets(sized.select(source_col, "size"), source_col, "size", weights, ceiling))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(F.lit(0.0))
    stats = stats.withColumn("rate", rate).withColumn("frac", F.col("rate") - F.floor("rate"))
    key = lambda: hashed(seed, F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit("")))
    numbers = seed_numbers(SEEDS)
    each = lookup_join(sized.select(F.col(source_col).alias("source"), "size", key().alias("h")), stats.select("source", "frac"), ["source"])
    sums = each.groupBy("source").agg(*[F.sum(F.when(drawn(F.col("h"), a, b, F.col("frac")), F.col("size")).otherwise(0)).alias(f"s{i}") for i, (a, b) in enumerate(numbers)])
    sums = lookup_join(sums, stats, ["source"])
    miss = [F.abs(F.col(f"s{i}") + F.floor("rate") * F.col("source_size") - F.col("target")) for i in range(SEEDS)]
    best = F.array_min(F.array(*[F.struct(m.alias("m"), F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (m, (a, b)) in enumerate(zip(miss, numbers))]))
    k_, rate_, frac_, a_, b_ = fresh(sized.columns + ["source_size", "target", "copies", "taken"], "mix_key", "rate", "frac", "seed_a", "seed_b")
    chosen = cut(sums.withColumn("best", best).select(F.col("source").alias(k_), "source_size", "target", F.col("rate").alias(rate_), F.col("frac").alias(frac_), F.col("best.a").alias(a_), F.col("best.b").alias(b_)))
    out = lookup_join(sized.withColumn(k_, F.col(source_col)), chosen, [k_])
    copies = F.floor(rate_) + drawn(key(), F.col(a_), F.col(b_), F.col(frac_)).cast("int")
    out = out.withColumn("copies", copies.cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop(k_, rate_, frac_, a_, b_)


def emit_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixed corpus itself: each row `copies` times, with the given columns."""
    (n,) = fresh(mixed, "copy_no")
    return mixed.where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_sql() -> str:
    numbers = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(seed_numbers(SEEDS)))
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size,
                  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::BIGINT % {PRIME} AS h FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - sum(cap) OVER r + cap)::DOUBLE / (sum(w) OVER () - sum(w) OVER r + w)::DOUBLE AS lev
      FROM o WINDOW r AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
t AS (SELECT source, source_size, least(max(lev) OVER () * w, cap::DOUBLE) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
j AS (SELECT d.doc_id, d.source, d.size, d.h, u.source_size, u.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS f FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
seeds AS (SELECT * FROM (VALUES {numbers}) AS s(i, a, b)),
m AS (SELECT source, i, abs(sum(CASE WHEN (h * a + b) % {PRIME} < f * {float(PRIME)!r}::DOUBLE THEN size ELSE 0 END) + any_value(whole * source_size) - any_value(target)) AS miss FROM j, seeds GROUP BY source, i),
c AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY miss, i) AS n FROM m)
SELECT j.doc_id, j.size, j.source_size, j.target, j.size * (j.whole + CASE WHEN (h * a + b) % {PRIME} < f * {float(PRIME)!r}::DOUBLE THEN 1 ELSE 0 END) AS taken
FROM j JOIN c ON c.n = 1 AND j.source IS NOT DISTINCT FROM c.source JOIN seeds USING (i)"""
