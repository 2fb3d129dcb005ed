"""Hash samples, hold-out splits and whole-component quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.stats import numbered
from tessera.plans.lineage import cut

_ASKED = "s string, rest long, k string, c string"


def seeded_key(seed: str, id_: Column) -> Column:
    """SHA-256 of seed, NUL, id."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\x00"), id_.cast("string")), 256)


def hash_sample(df: DataFrame, domain: str, id_col: str, n: int, seed: str) -> DataFrame:
    """The n rows of each domain with the smallest keys, and their rank."""
    w = W.partitionBy(domain).orderBy(seeded_key(seed, F.col(id_col)), F.col(id_col).cast("string"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def eligible(df: DataFrame, norm: Column, id_col: str, excluded: DataFrame | None = None) -> DataFrame:
    """df with reason: 0 kept, 1 its normalised text is excluded, 2 another row of that text has a smaller id."""
    d = df.withColumn("norm", norm)
    first = d.groupBy("norm").agg(F.min(F.col(id_col).cast("string")).alias("first_id"))
    d = d.join(first, "norm").withColumn("reason", F.when(F.col(id_col).cast("string") == F.col("first_id"), 0).otherwise(2)).drop("first_id")
    if excluded is not None:
        d = d.join(excluded.select(F.col("norm").alias("x")).distinct(), F.col("norm") == F.col("x"), "left").withColumn("reason", F.when(F.col("x").isNotNull(), 1).otherwise(F.col("reason"))).drop("x")
    return d


def query_components(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, component): queries that share a relevant document, directly or over others; named by the smallest query id.

    A query without relevant documents is a component of its own.
    """
    edges = qrels.select(F.concat(F.lit("a"), "query_id").alias("src"), F.concat(F.lit("b"), "doc_id").alias("dst"))
    comp = connected_components(edges).where(F.col("node").startswith("a")).select(F.substring("node", 2, 1 << 20).alias("query_id"), F.substring("component", 2, 1 << 20).alias("component"))
    return queries.select("query_id").join(comp, "query_id", "left").select("query_id", F.coalesce("component", "query_id").alias("component"))


def grouped_quota(components: DataFrame, quota: Mapping[str, int], seed: str, strict: bool = True) -> DataFrame:
    """components (component, src, n) with `chosen`: whole components in hash order while they fit their source's quota.

    Each round takes, by a running sum, all that fit up to the first that doesn't, and goes on behind it with what is left;
    components larger than that drop out. Only a row a source and round reaches the driver. With strict, a quota left unmet
    raises; sources without a quota choose nothing.
    """
    rows = cut(components.withColumn("component", F.col("component").cast("string")).withColumn("key", seeded_key(seed, F.col("component"))))
    left, after, spans = {s: int(q) for s, q in quota.items()}, {}, []
    todo = [s for s, q in left.items() if q > 0]
    while todo:
        asked = rows.sparkSession.createDataFrame([(s, left[s], *after.get(s, ("", ""))) for s in todo], _ASKED)
        fit = rows.join(F.broadcast(asked), F.col("src") == F.col("s")).where("n <= rest AND (key > k OR (key = k AND component > c))")
        run = fit.withColumn("run", F.sum("n").over(W.partitionBy("src").orderBy("key", "component").rowsBetween(W.unboundedPreceding, 0)))
        got = run.groupBy("src").agg(F.max(F.when(F.col("run") <= F.col("rest"), F.col("run"))).alias("taken"), F.min(F.when(F.col("run") > F.col("rest"), F.struct("key", "component"))).alias("stop")).collect()
        todo = []
        for r in got:
            stop = tuple(r.stop) if r.stop else ("g", "")  # behind all hexadecimal keys
            spans.append((r.src, left[r.src], *after.get(r.src, ("", "")), *stop))
            left[r.src] -= r.taken or 0
            after[r.src] = stop
            if r.stop and left[r.src] > 0:
                todo.append(r.src)
    short = sorted(s for s, q in left.items() if q > 0)
    if strict and short:
        raise ValueError(f"quota infeasible: {short}")
    taken = rows.sparkSession.createDataFrame(spans, f"{_ASKED}, k2 string, c2 string")
    inside = (F.col("src") == F.col("s")) & (F.col("n") <= F.col("rest")) & (F.struct("key", "component") > F.struct("k", "c")) & (F.struct("key", "component") < F.struct("k2", "c2"))
    chosen = rows.join(F.broadcast(taken), inside, "left_semi").select(F.col("component").alias("in"), F.col("src").alias("of")).distinct()
    out = rows.join(chosen, F.col("component").eqNullSafe(F.col("in")) & F.col("src").eqNullSafe(F.col("of")), "left")
    return out.withColumn("chosen", F.col("of").isNotNull()).drop("in", "of", "key")


def holdout(df: DataFrame, domain: str, id_col: str, seed: str, sizes: Mapping[str, int], rest: str = "reserve") -> DataFrame:
    """df with split: in each domain the first ids by SHA-256 of seed and id go to the given splits in turn, the others to rest."""
    key = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)
    place, split, upto = F.row_number().over(W.partitionBy(domain).orderBy(key, id_col)), None, 0
    for name, n in sizes.items():
        upto += n
        split = F.when(place <= upto, name) if split is None else split.when(place <= upto, name)
    return df.withColumn("split", F.lit(rest) if split is None else split.otherwise(rest))


def ratio_split(df: DataFrame, id_col: str, seed: str, shares: Mapping[str, float], rest: str) -> DataFrame:
    """df with split: ids, which must be unique, by SHA-256 of seed and id; each split takes the floor of its share in turn."""
    keyed = df.withColumn("key", F.struct(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256), F.col(id_col)))
    at = numbered(keyed, "key", "place").drop("key")
    n, split, upto = at.count(), F.lit(rest), 0
    for name, share in shares.items():
        first, upto = upto, upto + int(n * share)
        split = F.when((F.col("place") >= first) & (F.col("place") < upto), name).otherwise(split)
    return at.withColumn("split", split).drop("place")


def rotated(df: DataFrame, id_col: str, seed: str, policies: Sequence[str]) -> DataFrame:
    """(id, pos, policy, position): ids in hash order, and the policies of each rotated by its place: all places come alike often."""
    keyed = df.select(id_col, F.struct(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256), F.col(id_col)).alias("key"))
    each = numbered(keyed, "key", "pos").select(id_col, "pos", F.posexplode(F.array(*map(F.lit, policies))).alias("i", "policy"))
    return each.select(id_col, "pos", "policy", ((F.col("i") + F.col("pos")) % len(policies)).alias("position"))


def overlaps(df: DataFrame, split: str, key: str) -> DataFrame:
    """(a, b, shared): number of keys that two splits share. A key has a row a split, so that its pairs are those of the splits."""
    each = df.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return each.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("shared"))


def hard_negatives(ranking: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """(query_id, positive_id, negative_id, position): the first n ranked non-relevant ids, if there are n, for each positive."""
    if n <= 0:
        raise ValueError("n must be positive")
    neg = ranking.join(qrels, ["query_id", "doc_id"], "left_anti").dropDuplicates(["query_id", "doc_id"])
    neg = neg.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("position") <= n)
    full = neg.groupBy("query_id").count().where(F.col("count") == n).select("query_id")
    return neg.join(full, "query_id", "left_semi").join(qrels.withColumnRenamed("doc_id", "positive_id"), "query_id").select("query_id", "positive_id", F.col("doc_id").alias("negative_id"), "position")
