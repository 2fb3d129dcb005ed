"""Splits of whole components around queries that were seen before, and what later splits share with earlier ones.

Components that hold a query of an earlier cohort are reachable from it: their other queries are quarantined. Of the rest,
whole components are admitted to one split after another, in hash order, while all of their sources fit its quotas.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.splits import overlaps, seeded_key
from tessera.plans.lineage import cut, stored
from tessera.plans.skew import split_join


def tagged(rows: DataFrame, components: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, src, component, seen): rows (query_id, src) with their component and whether they are among the anchors.

    Raises on ids that are null or repeated, in either, on anchors that aren't rows and on rows without a component.
    """
    n = rows.groupBy("query_id").agg(F.min("src").alias("src"), F.count("*").alias("n"))
    a = anchors.groupBy("query_id").agg(F.count("*").alias("times"))
    both = n.join(a, "query_id", "full_outer").join(components.select("query_id", "component"), "query_id", "left")
    out = cut(both.withColumn("wrong", F.when(F.col("query_id").isNull(), "null id").when(F.col("n").isNull(), "unknown anchor").when((F.col("n") > 1) | (F.col("times") > 1), "repeated id").when(F.col("component").isNull(), "no component")))
    if bad := out.where("wrong IS NOT NULL").select("query_id", "wrong").orderBy("wrong", "query_id").first():
        raise ValueError(f"{bad.wrong}: {bad.query_id}")
    return out.select("query_id", "src", "component", F.col("times").isNotNull().alias("seen"))


def _profile(tags: DataFrame, sources: Sequence[str], seed: str) -> DataFrame:
    """A row a component, in parts that follow the order of its key: its rows of each source (n0, n1, ...), of others, and of anchors."""
    per = [F.count_if(F.col("src") == s).alias(f"n{i}") for i, s in enumerate(sources)]
    known = F.coalesce(F.col("src").isin(*sources), F.lit(False)) if sources else F.lit(False)
    comp = tags.groupBy("component").agg(*per, F.count_if(~known).alias("others"), F.count_if("seen").alias("anchors"), F.count("*").alias("n"))
    keyed = comp.withColumn("key", F.struct(seeded_key(seed, F.col("component")), F.col("component").cast("string")))
    return cut(keyed.orderBy("key").withColumn("part", F.spark_partition_id()))


def _admitted(free: DataFrame, quota: Sequence[int]) -> tuple[Column, list[int]]:
    """Which of the components, in the order of their key, a split takes whose quotas (by source) they must fit as wholes, and what
    stays unmet.

    Each round takes all up to the first that doesn't fit beside those before it; what is left of the quotas then rules out that
    one for good, as it does any that is larger. Running sums go over the parts, whose sums (a row a part) reach the driver.
    """
    k, left, after, taken = len(quota), list(map(int, quota)), None, F.lit(False)
    ns = [f"n{i}" for i in range(k)]
    while any(left):
        fitting = (F.col("others") == 0) & reduce(Column.__and__, [F.col(c) <= r for c, r in zip(ns, left)])
        if after is not None:
            fitting = fitting & (F.col("key") > after)
        rows = free.where(fitting)
        before, shifts = [0] * k, {}
        for r in rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in ns]).orderBy("part").collect():
            shifts[r.part] = list(before)
            before = [b + r[c] for b, c in zip(before, ns)]
        if not shifts:
            break
        w = W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
        shift = lambda i: F.create_map(*[F.lit(x) for p, b in shifts.items() for x in (p, b[i])])[F.col("part")]
        run = rows.select("key", *ns, *[(F.sum(c).over(w) + shift(i)).alias(f"run{i}") for i, c in enumerate(ns)])
        over = reduce(Column.__or__, [F.col(f"run{i}") > r for i, r in enumerate(left)])
        stop = run.agg(F.min(F.when(over, F.col("key")))).first()[0]
        end = None if stop is None else F.struct(*[F.lit(x) for x in stop])
        inside = fitting if end is None else fitting & (F.col("key") < end)
        taken = taken | inside
        got = free.where(inside).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ns]).first()
        left, after = [r - g for r, g in zip(left, got)], end
        if end is None:
            break
    return taken, left


def anchored_split(rows: DataFrame, components: DataFrame, anchors: DataFrame, quotas: Mapping[str, Mapping[str, int]], seed: str, strict: bool = True, seen: str = "development", linked: str = "quarantined", rest: str = "reserve") -> DataFrame:
    """(query_id, src, component, split) of rows (query_id, src), given their components and the anchors, those seen before.

    Anchors are `seen`; other queries of their components are `linked`. Of the other components, in the order of SHA-256 of seed, NUL
    and name, each split of quotas (rows by source; sources without one take none) admits in turn whole components that fit what
    is left for all of their sources; the others are `rest`. With strict, a quota left unmet raises; without, it stays unmet.
    """
    tags = tagged(rows, components, anchors)
    sources = sorted({s for q in quotas.values() for s in q})
    comp = _profile(tags, sources, seed).withColumn("split", F.when(F.col("anchors") > 0, linked))
    for name, quota in quotas.items():
        taken, unmet = _admitted(comp.where("split IS NULL"), [quota.get(s, 0) for s in sources])
        if strict and any(unmet):
            raise ValueError(f"quota infeasible for {name}: {dict(zip(sources, unmet))}")
        comp = cut(comp.withColumn("split", F.when(F.col("split").isNull() & taken, name).otherwise(F.col("split"))))
    place = comp.select("component", F.coalesce("split", F.lit(rest)).alias("split"), "n")
    out = split_join(tags, place, "component", "n")
    return out.select("query_id", "src", "component", F.when(F.col("seen"), seen).otherwise(F.col("split")).alias("split"))


def split_overlaps(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """(what, a, b, shared): ids, normalised texts, relevant documents and components that each two splits share; none where 0.

    rows: (query_id, norm, component, split), a query of two splits with a row in each; gold: (query_id, doc_id).
    """
    kinds = {"query": rows.select("split", F.col("query_id").alias("k")), "text": rows.select("split", F.col("norm").alias("k")), "component": rows.select("split", F.col("component").alias("k")),
             "document": rows.select("query_id", "split").join(gold.select("query_id", F.col("doc_id").alias("k")), "query_id").select("split", "k")}
    each = [overlaps(df.where("k IS NOT NULL"), "split", "k").select(F.lit(what).alias("what"), "a", "b", "shared") for what, df in kinds.items()]
    return reduce(DataFrame.unionByName, each)


def unseen(rows: DataFrame, gold: DataFrame, earlier: Sequence[str], later: str) -> DataFrame:
    """(query_id, src, direct, component_wide): whether a query of the later split shares no relevant document with queries of the
    earlier ones, and whether nothing links it to them, over any queries. rows: (query_id, src, component, split); gold as above."""
    is_before, is_after = F.col("split").isin(*earlier), F.col("split") == later
    sides = rows.select("query_id", is_before.alias("b"), is_after.alias("a")).where("a OR b").groupBy("query_id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    # The gold of both sides from one shuffle; it is narrow, and all that the searches below read.
    held, _ = stored(gold.select("query_id", "doc_id").join(sides, "query_id"), "gold")
    used = held.where("b").select("doc_id").distinct()
    touched = held.where("a").join(used, "doc_id", "left_semi").select("query_id").distinct().withColumn("by_document", F.lit(True))
    reached = rows.where(is_before).select("component").distinct().withColumn("by_component", F.lit(True))
    out = rows.where(is_after).join(touched, "query_id", "left").join(reached, "component", "left")
    return out.select("query_id", "src", F.col("by_document").isNull().alias("direct"), F.col("by_component").isNull().alias("component_wide"))


def unseen_counts(rows: DataFrame, gold: DataFrame, earlier: Sequence[str], later: str) -> DataFrame:
    """(src, n, direct, component_wide): the later split's queries by source, and those of each kind of `unseen`."""
    return unseen(rows, gold, earlier, later).groupBy("src").agg(F.count("*").alias("n"), F.count_if("direct").alias("direct"), F.count_if("component_wide").alias("component_wide"))
