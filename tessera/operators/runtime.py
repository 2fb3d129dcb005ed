"""Conditional re-ranking as it runs: calls of the scorer and the pairs it gets are counted in the workers that make them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.fusion import ranking_differences, rerank_prefix
from tessera.plans.lineage import stored
from tessera.plans.skew import among

Scorer = Callable[[str, list[str]], Sequence[float]]


class Counting:
    """A scorer that counts its calls and the pairs it gets."""

    def __init__(self, score: Scorer):
        self.score, self.calls, self.pairs = score, 0, 0

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        self.calls += 1
        self.pairs += len(texts)
        got = [float(x) for x in self.score(query, texts)]
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} scores of {len(texts)} documents")
        return got


@dataclass
class Execution:
    """What ran: the ranking (query_id, doc_id, rank), a record a query (query_id, reranked, calls, scored_pairs), and the
    scorer's calls and pairs in all as the job that ran it observed them."""

    ranking: DataFrame
    records: DataFrame
    calls: int
    pairs: int


def execute(queries: DataFrame, docs: DataFrame, ranking: DataFrame, routed: DataFrame, load: Callable[[], Scorer], depth: int = 20) -> Execution:
    """Runs the scorer once for each routed query (query_id) that the ranking has, over its first `depth` documents.

    queries: (query_id, query); docs: (doc_id, text). load is called once in each task's worker and returns a function of a
    query's text and its candidates' texts to their scores. The scores, and how often the scorer was called for them, are written
    to a table as the worker returns them; the ranking and the records are made from that table, so that the scorer doesn't run
    again, and a task that was tried twice counts once. A candidate without a text or a finite score fails the ranking.
    """
    if isinstance(depth, bool) or not isinstance(depth, int) or depth < 1:
        raise ValueError("depth must be a positive integer")
    head = ranking.where(F.col("rank") <= depth).join(routed.select("query_id").distinct(), "query_id", "left_semi")
    texts = head.join(among(docs.select("doc_id", "text"), head, "doc_id"), "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("c"))  # depth entries at most
    asked = texts.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", F.col("c.doc_id").alias("doc_ids"), F.col("c.text").alias("texts"))

    def run(batches):
        score = Counting(load())
        for b in batches:
            scores, calls, pairs = [], [], []
            for query, own in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                before = score.calls, score.pairs
                scores.append(score(query or "", ["" if t is None else t for t in own]))
                calls.append(score.calls - before[0])
                pairs.append(score.pairs - before[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.list_(pa.float64())), pa.array(calls, pa.int64()), pa.array(pairs, pa.int64())], names=["query_id", "doc_ids", "scores", "calls", "pairs"])

    seen = Observation()
    ran = asked.mapInArrow(run, "query_id string, doc_ids array<string>, scores array<double>, calls long, pairs long")
    log, _ = stored(ran.observe(seen, F.sum("calls").alias("calls"), F.sum("pairs").alias("pairs")), "scorer-calls")
    scores = log.select("query_id", F.explode(F.arrays_zip("doc_ids", "scores")).alias("x")).select("query_id", F.col("x.doc_ids").alias("doc_id"), F.col("x.scores").alias("pair_score"))
    yes, no = ranking.join(log, "query_id", "left_semi"), ranking.join(log, "query_id", "left_anti")
    final = rerank_prefix(yes, scores, depth).unionByName(no.select("query_id", "doc_id", "rank"))
    per = log.groupBy("query_id").agg(F.sum("calls").alias("calls"), F.sum("pairs").alias("scored_pairs"))
    records = queries.select("query_id").join(per, "query_id", "left").na.fill(0, ["calls", "scored_pairs"]).select("query_id", (F.col("calls") > 0).alias("reranked"), "calls", "scored_pairs")
    return Execution(final, records, seen.get["calls"] or 0, seen.get["pairs"] or 0)


def violations(ran: Execution, decisions: DataFrame, expected: DataFrame, depth: int = 20) -> DataFrame:
    """(id, rule): where an execution differs from the frozen decisions (query_id, rerank) and the expected ranking.

    Both have the same queries, once each; a query is re-ranked if and only if that was decided, by one call over all of its
    first documents; its ranking is the expected one; the calls observed are those recorded.
    """
    size = expected.where(F.col("rank") <= depth).groupBy("query_id").agg(F.count("*").alias("due"))
    frozen = decisions.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rerank").alias("rerank"))
    both = ran.records.join(frozen, "query_id", "full_outer").join(size, "query_id", "left")
    due = F.when(F.col("rerank"), F.coalesce("due", F.lit(0))).otherwise(0)
    rule = F.when(F.col("n").isNull(), "no decision").when(F.col("reranked").isNull(), "not run").when(F.col("n") > 1, "repeated decision")
    rule = rule.when(F.col("reranked") != F.col("rerank"), "decision differs").when(F.col("scored_pairs") != due, "pairs differ").when(F.col("calls") != F.col("rerank").cast("int"), "calls differ")
    own = both.select(F.col("query_id").alias("id"), rule.alias("rule")).where("rule IS NOT NULL")
    moved = ranking_differences(ran.ranking, expected).select(F.col("query_id").alias("id"), F.lit("ranking differs").alias("rule")).distinct()
    total = ran.records.agg(F.sum("calls").alias("calls"), F.sum("scored_pairs").alias("pairs")).select(F.lit("all queries").alias("id"), F.when((F.coalesce("calls", F.lit(0)) != ran.calls) | (F.coalesce("pairs", F.lit(0)) != ran.pairs), "observed calls differ").alias("rule")).where("rule IS NOT NULL")
    return own.unionByName(moved).unionByName(total)
