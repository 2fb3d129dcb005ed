"""Where re-ranking helps and where it hurts: a record for each query, and the groups they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checks import pair_tokens
from tessera.operators.metrics import outcome, rank_of, transition
from tessera.plans.skew import among

#: Edges of the groups by number of query tokens and by mean tokens of the relevant documents.
QUERY_TOKENS, DOC_TOKENS = (32, 64), (128, 256)


def records(queries: DataFrame, docs: DataFrame, qrels: DataFrame, hybrid: DataFrame, reranked: DataFrame, gain: DataFrame, gated: DataFrame, tokenize, depth: int = 20, budget: int = 64, special: int = 3, name=None) -> DataFrame:
    """A row a query with relevant documents: its gain and outcome, coverage of the prefix, transitions, truncation, top result.

    queries: (query_id, query, src); docs: (doc_id, text, src); gain: (query_id, base, after, d); gated: (query_id) of the
    queries that the gate selects. A top result is cross-source if it isn't relevant and of another source than the query.
    With name, a Column function of two document ids, such a result is a counterpart where it holds for a relevant document.
    """
    gold = rank_of(reranked, rank_of(hybrid, qrels).withColumnRenamed("rank", "rb")).withColumnRenamed("rank", "ra")
    size = among(docs, qrels, "doc_id").select("doc_id", F.size(tokenize(F.col("text"))).alias("n_doc"))
    gold = gold.join(size, "doc_id").withColumn("move", transition(F.col("rb"), F.col("ra")))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_gold = gold.groupBy("query_id").agg(F.count("*").alias("positives"), count(F.col("rb") <= depth).alias("in_prefix"), count(F.col("move") == "left_top10").alias("left_top10"), count(F.col("move") == "entered_top10").alias("entered_top10"), F.avg("n_doc").alias("doc_tokens"))
    prefix = hybrid.where(F.col("rank") <= depth).select("query_id", "doc_id")
    pairs = pair_tokens(queries, docs, prefix, budget, special, tokenize)
    pairs = pairs.join(qrels.withColumn("relevant", F.lit(True)), ["query_id", "doc_id"], "left")
    of_pairs = pairs.groupBy("query_id").agg(F.count("*").alias("pairs"), count(F.col("truncated")).alias("pairs_truncated"), count(F.col("truncated") & F.col("relevant")).alias("positive_pairs_truncated"), count(F.col("kept_query") < F.col("n_query")).alias("query_truncated_pairs"), F.max("n_query").alias("query_tokens"))
    top = reranked.where("rank = 1").select("query_id", F.col("doc_id").alias("top1")).join(docs.select(F.col("doc_id").alias("top1"), F.col("src").alias("top1_src")), "top1")
    top = top.join(qrels.select("query_id", F.col("doc_id").alias("top1"), F.lit(True).alias("judged")), ["query_id", "top1"], "left")
    counterpart = F.lit(False) if name is None else F.coalesce(name(F.col("top1"), F.col("doc_id")), F.lit(False))
    near = top.where("judged IS NULL").join(qrels, "query_id").groupBy("query_id").agg(F.max(counterpart).alias("like"))
    all_ = queries.select("query_id", "src", "query").join(gain.select("query_id", "base", "after", "d"), "query_id").join(of_gold, "query_id").join(of_pairs, "query_id").join(top, "query_id").join(near, "query_id", "left")
    all_ = all_.join(gated.select("query_id", F.lit(True).alias("gate")).distinct(), "query_id", "left")
    cross = F.col("judged").isNull() & ~F.lower("top1_src").eqNullSafe(F.lower("src"))
    return all_.select("query_id", "src", "base", "after", "d", outcome(F.col("d")).alias("outcome"), "positives", "in_prefix", (F.col("in_prefix") / F.col("positives")).alias("recall_prefix"), "left_top10", "entered_top10", "doc_tokens", "pairs", "pairs_truncated", "positive_pairs_truncated",
                       "query_truncated_pairs", "query_tokens", "top1", cross.alias("cross_source"), (cross & F.coalesce("like", F.lit(False))).alias("counterpart"), F.coalesce("gate", F.lit(False)).alias("gate"))


def _band(c: str, edges: tuple[int, int]):
    return F.when(F.col(c) < edges[0], f"0-{edges[0] - 1}").when(F.col(c) < edges[1], f"{edges[0]}-{edges[1] - 1}").otherwise(f"{edges[1]}+")


def strata(rows: DataFrame, focus: str) -> DataFrame:
    """(stratum, value, 21 sums and means): nine groupings of the records, and all of them, in one pass.

    focus: the source whose queries are grouped by outcome and by truncation besides.
    """
    cut_ = F.when(F.col("positive_pairs_truncated") > 0, "yes").otherwise("no")
    mine = lambda c: F.when(F.lower("src") == focus.lower(), c)
    kinds = {
        "source": F.col("src"), "positives": F.when(F.col("positives") >= 3, "3+").otherwise(F.col("positives").cast("string")), "query_tokens": _band("query_tokens", QUERY_TOKENS), "positive_truncated": cut_,
        "doc_tokens": _band("doc_tokens", DOC_TOKENS), "coverage": F.when(F.col("in_prefix") == 0, "none").when(F.col("in_prefix") == F.col("positives"), "all").otherwise("partial"),
        "focus_outcome": mine(F.col("outcome")), "focus_truncated": mine(cut_), "gate": F.when(F.col("gate"), "selected").otherwise("bypassed"), "all": F.lit("all"),
    }
    # A row a record and grouping: ten times the queries, before partial aggregation.
    each = rows.withColumn("g", F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), v.alias("value")) for k, v in kinds.items()]))).where("g.value IS NOT NULL")
    n = lambda c: F.count_if(c)
    return each.groupBy(F.col("g.stratum").alias("stratum"), F.col("g.value").alias("value")).agg(
        F.count("*").alias("queries"), F.avg("base").alias("before"), F.avg("after").alias("after_"), F.avg("d").alias("delta"), n(F.col("outcome") == "win").alias("wins"), n(F.col("outcome") == "loss").alias("losses"), n(F.col("outcome") == "tie").alias("ties"),
        F.avg("recall_prefix").alias("recall_prefix"), n(F.col("in_prefix") == 0).alias("without_positive"), n(F.col("in_prefix") == F.col("positives")).alias("with_all"), F.sum("positives").alias("positives"), F.sum("in_prefix").alias("positives_in_prefix"),
        F.sum("left_top10").alias("left_top10"), F.sum("entered_top10").alias("entered_top10"), F.sum("pairs").alias("pairs"), F.sum("pairs_truncated").alias("pairs_truncated"), F.sum("positive_pairs_truncated").alias("positive_pairs_truncated"),
        F.sum("query_truncated_pairs").alias("query_truncated_pairs"), n(F.col("query_truncated_pairs") > 0).alias("query_truncated"), n(F.col("cross_source")).alias("cross_source"), n(F.col("counterpart")).alias("counterparts"), F.avg("query_tokens").alias("mean_query_tokens"), F.avg("doc_tokens").alias("mean_doc_tokens"))
