"""A router that is fitted on one cohort, calibrated on a second, frozen under its digest, and confirmed on a third.

Label columns carry a mark in their metadata, which every plan that reads them shows: calibration and predictions refuse such
plans. A frozen router is named by the SHA-256 of its text, its decisions by a digest of their rows; both are checked when read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import checks, policies
from tessera.operators.router import FEATURES, Ridge, fit
from tessera.plans.lineage import cut

MARK = "tessera-label"


def labelled(df: DataFrame, *cols: str) -> DataFrame:
    """df with the given columns marked as labels."""
    for c in cols:
        df = df.withMetadata(c, {**df.schema[c].metadata, MARK: True})
    return df


def reads_labels(df: DataFrame) -> bool:
    """Whether the analysed plan of df reads a marked column, be it only to join or filter by it.

    A checkpoint hides what was read before it, except in the columns that it kept: ask before cutting.
    """
    todo = [df._jdf.queryExecution().analyzed()]
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    while todo:
        node = todo.pop()
        if any(a.metadata().contains(MARK) for a in each(node.output())):
            return True
        todo += [*each(node.children()), *each(node.subqueries())]
    return False


def require_unlabelled(df: DataFrame, what: str) -> None:
    if reads_labels(df):
        raise ValueError(f"{what} may read no label")


def row_digest(df: DataFrame) -> str:
    """SHA-256 of the number of rows and of two sums of their hashes: the same for the same rows in any order and parts."""
    cols = sorted(df.columns)
    each = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in ("a", "b")]
    return hashlib.sha256(":".join(map(str, df.agg(F.count("*"), *each).first())).encode()).hexdigest()


@dataclass(frozen=True)
class Frozen:
    """A fitted router, its thresholds by budget, and what they were made from."""

    model: Ridge
    thresholds: Mapping[float, float]
    evidence: Mapping[str, object]

    def to_json(self) -> str:
        return json.dumps({"model": json.loads(self.model.to_json()), "thresholds": {str(b): t for b, t in sorted(self.thresholds.items())}, "evidence": dict(self.evidence)}, sort_keys=True, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> Frozen:
        v = json.loads(text)
        return Frozen(Ridge.from_json(json.dumps(v["model"])), {float(b): t for b, t in v["thresholds"].items()}, v["evidence"])

    @property
    def name(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p, to nine digits. Raises if they read a label."""
        require_unlabelled(rows, "predictions")
        return rows.withColumn("p", F.round(self.model.predict(), 9))

    def decide(self, rows: DataFrame) -> DataFrame:
        """(query_id, src, policy, rerank) of rows (query_id, src, features). Raises if they read a label."""
        at = rows.sparkSession.createDataFrame([(float(b), float(t)) for b, t in sorted(self.thresholds.items())], "budget double, threshold double")
        return policies.decide(self.predict(rows), at)


def cohort_overlaps(cohorts: Mapping[str, DataFrame], gold: DataFrame) -> DataFrame:
    """(id, rule): ids, normalised texts and relevant documents that cohorts (query_id, norm) share, and those repeated within one."""
    rows = None
    for name, df in cohorts.items():
        one = df.select("query_id", "norm", F.lit(name).alias("split"))
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    docs = rows.join(gold.select("query_id", "doc_id"), "query_id").select("split", F.col("doc_id").alias("document"))
    twice = [rows.where(F.col(c).isNotNull()).groupBy("split", F.col(c).alias("id")).count().where("count > 1").select("id", F.lit(f"{c} repeated in a cohort").alias("rule")) for c in ("query_id", "norm")]
    out = checks.shared_between_splits(rows, "split", ["query_id", "norm"]).unionByName(checks.shared_between_splits(docs, "split", ["document"]))
    return out.unionByName(twice[0]).unionByName(twice[1])


def freeze(train: DataFrame, calibration: DataFrame, target: str, gold: DataFrame, budgets: Sequence[float], alpha: float = 10.0) -> Frozen:
    """The ridge fit of train's target and the thresholds of calibration's predictions.

    train and calibration: (query_id, norm, features), train with the target, gold: (query_id, doc_id). Raises where the cohorts share
    an id, a text or a relevant document or repeat an id or text, where calibration reads a label, and below two rows in either.
    """
    require_unlabelled(calibration, "calibration")
    checks.require_none(cohort_overlaps({"train": train, "calibration": calibration}, gold))
    model = fit(train, target, alpha)
    p = cut(calibration.withColumn("p", F.round(model.predict(), 9)).select("query_id", "p"))
    n = p.count()
    if n < 2:
        raise ValueError("two rows at least are needed to calibrate")
    thresholds = {r.budget: r.threshold for r in policies.calibrate(p, budgets).collect()}
    counts = [c for b in budgets for c in (F.count_if(F.col("p") > thresholds[b]).alias(f"calls {b}"), F.count_if(F.col("p") == thresholds[b]).alias(f"ties {b}"))]
    signs = train.agg(F.count_if(F.col(target) > 0).alias("positive"), F.count_if(F.col(target) == 0).alias("zero"), F.count_if(F.col(target) < 0).alias("negative")).first()
    evidence = {"train_rows": model.rows, "calibration_rows": n, "targets": signs.asDict(), "calibration": p.agg(*counts).first().asDict(),
                "train_digest": row_digest(train.select("query_id", "norm", *FEATURES, target)), "calibration_digest": row_digest(calibration.select("query_id", "norm", *FEATURES))}
    return Frozen(model, thresholds, evidence)


def write_frozen(spark: SparkSession, frozen: Frozen, folder: str) -> str:
    """Writes it to folder under its name, which is returned; never over another one."""
    spark.createDataFrame([(frozen.to_json(),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{frozen.name}/router")
    return frozen.name


def load_frozen(spark: SparkSession, folder: str, name: str) -> Frozen:
    """Raises if what lies under the name has another digest."""
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{name}/router").collect())
    if hashlib.sha256(text.encode()).hexdigest() != name:
        raise ValueError(f"{folder}/{name}: the router was changed")
    return Frozen.from_json(text)


def freeze_decisions(rows: DataFrame, folder: str, name: str) -> str:
    """Writes what the frozen router decides on rows, before any label of theirs is read, and returns the digest of the decisions."""
    spark, at = rows.sparkSession, f"{folder}/{name}/decisions"
    load_frozen(spark, folder, name).decide(rows).write.mode("errorifexists").parquet(at)
    return row_digest(spark.read.parquet(at))


def confirm(gain: DataFrame, folder: str, name: str, digest: str) -> DataFrame:
    """(policy, n, ndcg10, calls, pairs) of the frozen decisions on gain (query_id, src, base, after), read only now.

    Raises if router or decisions were changed since, or if the decisions and gain aren't of the same queries, one each.
    """
    spark = gain.sparkSession
    load_frozen(spark, folder, name)
    decisions = spark.read.parquet(f"{folder}/{name}/decisions")
    if row_digest(decisions) != digest:
        raise ValueError(f"{folder}/{name}: the decisions were changed")
    one = decisions.where("policy = 'never'").select("query_id", F.lit(0.0).alias("p"))
    twice = gain.groupBy(F.col("query_id").alias("id")).count().where("count > 1").select("id", F.lit("repeated query").alias("rule"))
    checks.require_none(checks.prediction_violations(gain, one).unionByName(twice))
    decided = decisions.join(gain.drop("src"), "query_id")
    return policies.summarise(decided).join(decided.groupBy("policy").agg(F.count("*").alias("n")), "policy").select("policy", "n", "ndcg10", "calls", "pairs")
