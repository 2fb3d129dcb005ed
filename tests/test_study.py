import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import router, study
from tessera.operators.router import FEATURES

SCHEMA = "query_id string, norm string, src string, " + ", ".join(f"{f} double" for f in FEATURES) + ", d double"


def cohort(spark, name, n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [r.random() for _ in FEATURES]
        rows.append((f"{name}{i}", f"text {name} {i}", r.choice("ab"), *x, max(-1.0, min(1.0, 0.3 * x[0] - 0.2 * x[5] + r.gauss(0, 0.05)))))
    return study.labelled(spark.createDataFrame(rows, SCHEMA), "d"), rows


def gold_of(spark, *cohorts):
    return spark.createDataFrame([(x[0], f"doc of {x[0]}") for c in cohorts for x in c], "query_id string, doc_id string")


def test_plans_show_the_labels_that_they_read(spark):
    df, _ = cohort(spark, "t", 5, 1)
    other = spark.range(3)
    assert study.reads_labels(df) and not study.reads_labels(other)
    assert not study.reads_labels(spark.createDataFrame(df.drop("d").collect(), df.drop("d").schema))
    # Labels read only to join, to filter or to derive from count, also through a checkpoint that keeps them.
    assert study.reads_labels(other.join(df.where("d > 0").select("query_id"), F.col("id").cast("string") == F.col("query_id"), "left_semi"))
    assert study.reads_labels(df.groupBy("src").agg(F.avg("d").alias("m")).select("m"))
    assert study.reads_labels(df.select((F.col("d") * 2).alias("x")))
    assert study.reads_labels(df.select("query_id", "d").checkpoint().select("query_id"))


def test_fit_calibrate_freeze_confirm(spark, tmp_path):
    train, a = cohort(spark, "t", 60, 1)
    cal, b = cohort(spark, "c", 41, 2)
    conf, c = cohort(spark, "f", 30, 3)
    unread = lambda rows: spark.createDataFrame([x[:-1] for x in rows], SCHEMA.rsplit(",", 1)[0])
    gold = gold_of(spark, a, b)
    f = study.freeze(train, unread(b), "d", gold, [0.25, 0.5, 0.75])
    with pytest.raises(ValueError, match="calibration may read no label"):
        study.freeze(train, cal, "d", gold, [0.5])
    with pytest.raises(ValueError, match="predictions may read no label"):
        f.decide(conf)

    x, y = np.array([r[3:-1] for r in a]), np.array([r[-1] for r in a])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(7), z.T @ (y - y.mean()))
    plain = lambda rows: np.round(y.mean() + (np.array([r[3:-1] for r in rows]) - x.mean(0)) / x.std(0) @ w, 9)
    assert f.model.coefficients == pytest.approx(w)
    for budget, t in f.thresholds.items():
        assert t == pytest.approx(np.quantile(plain(b), 1 - budget))
        assert f.evidence["calibration"][f"calls {budget}"] == (plain(b) > t).sum()
    assert f.evidence["targets"] == {"positive": (y > 0).sum(), "zero": 0, "negative": (y < 0).sum()}

    folder = str(tmp_path / "study")
    name = study.write_frozen(spark, f, folder)
    assert name == f.name and study.load_frozen(spark, folder, name) == f
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        study.write_frozen(spark, f, folder)
    digest = study.freeze_decisions(unread(c), folder, name)
    gain = spark.createDataFrame([(r[0], r[2], 0.5, 0.5 + r[-1] / 2) for r in c], "query_id string, src string, base double, after double")
    got = {r.policy: r for r in study.confirm(gain, folder, name, digest).collect()}
    for budget, t in f.thresholds.items():
        routed = plain(c) > t
        at = got[f"utility_{int(budget * 100)}"]
        assert (at.n, at.calls, at.pairs) == (30, routed.sum(), 20 * routed.sum())
        assert at.ndcg10 == pytest.approx(np.where(routed, 0.5 + np.array([r[-1] for r in c]) / 2, 0.5).mean())
    assert got["always"].calls == 30 and got["never"].calls == 0

    for wrong, rule in ((gain.where("query_id <> 'f3'"), "no such query: f3"), (gain.union(gain.where("query_id = 'f4'")), "repeated query: f4"), (gain.union(spark.createDataFrame([("new", "a", 0.0, 0.0)], gain.schema)), "no prediction: new")):
        with pytest.raises(ValueError, match=rule):
            study.confirm(wrong, folder, name, digest)
    with pytest.raises(ValueError, match="decisions were changed"):
        study.confirm(gain, folder, name, "0" * 64)
    spark.createDataFrame([(f.to_json().replace('"alpha": 10.0', '"alpha": 1.0'),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/router")
    with pytest.raises(ValueError, match="router was changed"):
        study.confirm(gain, folder, name, digest)


def test_cohorts_share_nothing(spark):
    train, a = cohort(spark, "t", 6, 1)
    _, b = cohort(spark, "c", 6, 2)
    schema = SCHEMA.rsplit(",", 1)[0]
    gold = gold_of(spark, a, b)

    def refused(rows, rule, more=()):
        cal = spark.createDataFrame([x[:-1] for x in rows], schema)
        with pytest.raises(ValueError, match=rule):
            study.freeze(train, cal, "d", gold.union(spark.createDataFrame(more, gold.schema)) if more else gold, [0.5])

    refused([*b, a[0]], "norm in several splits: text t 0")
    refused([*b, b[0]], "norm repeated in a cohort: text c 0")
    refused([*b, ("c9", "text t 3", *a[3][2:])], "norm in several splits: text t 3")
    refused(b, "document in several splits: shared", [("t1", "shared"), ("c1", "shared")])
    refused(b[:1], "two rows")
    assert study.freeze(train, spark.createDataFrame([x[:-1] for x in b], schema), "d", gold, [0.5]).evidence["calibration_rows"] == 6


def test_digests_tell_rows_not_their_order(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 7 as string) AS s")
    assert study.row_digest(df) == study.row_digest(df.orderBy(F.desc("id")).repartition(5).select("s", "id"))
    assert study.row_digest(df) != study.row_digest(df.union(df.limit(1))) != study.row_digest(df.withColumn("s", F.when(F.col("id") == 3, "x").otherwise(F.col("s"))))
    assert router.FEATURES == FEATURES
