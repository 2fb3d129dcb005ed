"""The relations that the evaluation queries share, each built when it is first asked for and kept for the session."""

from __future__ import annotations

from collections import OrderedDict
from functools import cached_property
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import features, metrics, policies, splits
from tessera.operators.bm25 import Index
from tessera.operators.fusion import rerank_prefix, token_overlap, weighted_rrf
from tessera.operators.router import PUBLISHED
from tessera.operators.study import labelled, require_unlabelled
from tessera.operators.vector import DIM, dense_search, hashed_components, hashed_embedding
from tessera.plans.lineage import cut, forget
from tessera.plans.steps import contents
from tessera.sources.files import digest
from tessera.sources.tables import corpus, derived_qrels, queries

#: Depth of the candidate lists, of the deepest ablation, of the re-ranked prefix; constant of the fusion.
DEPTH, DEEPEST, PREFIX, RRF_K = 100, 500, 20, 60
BUDGETS = (0.25, 0.5, 0.75)

#: Folders' evaluations that are kept, those used last; what older ones stored is removed, and with it what was read from them.
FOLDERS = 4
_KEPT: OrderedDict[tuple, Evaluation] = OrderedDict()
_LOCK = Lock()


def evaluation(spark: SparkSession, d: str) -> Evaluation:
    """That of the session and the folder's present contents."""
    key = (spark.sparkContext.applicationId, id(spark), d, digest([contents(spark, f"{d}/{t}.parquet") for t in ("documents", "benchmark")]))
    with _LOCK:
        if key not in _KEPT:
            _KEPT[key] = Evaluation(spark, d)
        _KEPT.move_to_end(key)
        old = [_KEPT.popitem(last=False) for _ in range(len(_KEPT) - FOLDERS)]
    for (app, *_), e in old:
        if app == spark.sparkContext.applicationId:
            for folder in {e.__dict__[i].folder for i in ("index", "asked") if i in e.__dict__}:
                forget(spark, folder)
    return _KEPT[key]


class Evaluation:
    """Rankings, labels, metrics and decisions over a folder of tables. What is shuffled is cut, so that it is computed once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.docs, self.queries = corpus(spark, d), queries(spark, d)

    @cached_property
    def index(self) -> Index:
        return Index(self.docs)

    @cached_property
    def asked(self) -> Index:
        """The index of the terms of the folder's queries, with the documents' vectors; texts are cut once for both."""
        return Index(self.docs, self.queries, DIM)

    @cached_property
    def qrels(self) -> DataFrame:
        return labelled(cut(derived_qrels(self.docs, self.queries, self.asked.postings)), "query_id", "doc_id")

    @cached_property
    def deep_bm25(self) -> DataFrame:
        return cut(self.asked.search(self.queries, DEEPEST).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")))

    @property
    def hashed(self) -> DataFrame:
        """(doc_id, i, x): the documents' hashed components, summed where the text lies, without a shuffle of sums."""
        return hashed_components(self.docs, "doc_id", "text")

    @cached_property
    def deep_dense(self) -> DataFrame:
        found = dense_search(hashed_embedding(self.queries, "query_id", "query"), self.asked.vectors, DEEPEST)
        return cut(found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")))

    @property
    def bm25(self) -> DataFrame:
        return self.deep_bm25.where(F.col("rank") <= DEPTH)

    @property
    def dense(self) -> DataFrame:
        return self.deep_dense.where(F.col("rank") <= DEPTH)

    @cached_property
    def hybrid(self) -> DataFrame:
        return cut(weighted_rrf([self.bm25, self.dense], k=RRF_K).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")))

    def scorer(self, pairs: DataFrame) -> DataFrame:
        return token_overlap(pairs, self.queries, self.docs, tokenize)

    @cached_property
    def reranked(self) -> DataFrame:
        scores = self.scorer(self.hybrid.where(F.col("rank") <= PREFIX).select("query_id", "doc_id"))
        return cut(rerank_prefix(self.hybrid, scores, PREFIX).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank")))

    def ranking(self, method: str) -> DataFrame:
        return getattr(self, method).select(F.lit(method).alias("method"), "query_id", "doc_id", "rank")

    @property
    def rankings(self) -> DataFrame:
        a, b, c, d = (self.ranking(m) for m in ("bm25", "dense", "hybrid", "reranked"))
        return a.unionByName(b).unionByName(c).unionByName(d)

    def metrics_of(self, method: str) -> DataFrame:
        return metrics.evaluate(self.ranking(method), self.qrels, self.queries)

    @cached_property
    def per_query(self) -> DataFrame:
        return cut(metrics.evaluate(self.rankings, self.qrels, self.queries))

    @cached_property
    def gain(self) -> DataFrame:
        return cut(metrics.gains(self.per_query).join(self.queries.select("query_id", "src"), "query_id"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Features and the published router's prediction of each query; no label is read."""
        f = features.router_features(self.queries, self.bm25, self.dense).join(self.queries.select("query_id", "src"), "query_id")
        require_unlabelled(f, "predictions")
        return cut(f.withColumn("p", F.round(PUBLISHED.predict(), 9)))

    @cached_property
    def thresholds(self) -> DataFrame:
        return policies.calibrate(self.predictions, BUDGETS)

    @cached_property
    def decisions(self) -> DataFrame:
        return cut(policies.decide(self.predictions, self.thresholds))

    @property
    def decided(self) -> DataFrame:
        return self.decisions.join(self.gain.drop("src"), "query_id")

    @cached_property
    def components(self) -> DataFrame:
        return cut(splits.query_components(self.queries.select("query_id"), self.qrels))

    def routed(self, policy: str) -> DataFrame:
        return self.decisions.where((F.col("policy") == policy) & F.col("rerank")).select("query_id")
