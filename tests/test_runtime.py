import os
import subprocess
import sys
import textwrap
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import fusion, runtime

RANK = "query_id string, doc_id string, rank long"


def overlap(load_count=None):
    return fusion.overlap_scorer()


@pytest.fixture(scope="module")
def case(spark):
    qs = [(f"q{i}", f"red tape {i}") for i in range(6)]
    docs = [(f"d{j}", " ".join(["red", "tape", str(j), "city"][: 1 + j % 4])) for j in range(5)] + [("none", None)]
    rows = [(q, d, r + 1) for q, _ in qs for r, d in enumerate([f"d{j}" for j in range(5)] + ["none"])]
    decisions = [(q, i % 2 == 0) for i, (q, _) in enumerate(qs)]
    q, d, r = spark.createDataFrame(qs, "query_id string, query string"), spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(rows, RANK)
    frozen = spark.createDataFrame(decisions, "query_id string, rerank boolean")
    scores = fusion.token_overlap(r.where("rank <= 4").select("query_id", "doc_id"), q, d, tx.tokenize)
    yes = frozen.where("rerank").select("query_id")
    expected = fusion.rerank_prefix(r.join(yes, "query_id", "left_semi"), scores.join(yes, "query_id", "left_semi"), 4).unionByName(r.join(yes, "query_id", "left_anti"))
    return q, d, r, frozen, expected


def rules(ran, frozen, expected, depth=4):
    return sorted(map(tuple, runtime.violations(ran, frozen, expected, depth).collect()))


def test_workers_count_calls_and_pairs(spark, case):
    q, d, r, frozen, expected = case
    ran = runtime.execute(q, d, r, frozen.where("rerank").select("query_id"), fusion.overlap_scorer, 4)
    assert (ran.calls, ran.pairs) == (3, 12) and rules(ran, frozen, expected) == []
    assert sorted(map(tuple, ran.records.collect())) == [(f"q{i}", i % 2 == 0, int(i % 2 == 0), 4 * int(i % 2 == 0)) for i in range(6)]
    tail = {(x.query_id, x.doc_id) for x in ran.ranking.where("rank > 4").collect()}
    assert tail == {(f"q{i}", x) for i in range(6) for x in ("d4", "none")}
    assert ran.ranking.count() == ran.ranking.count() == 36 and (ran.calls, ran.pairs) == (3, 12)


def test_every_departure_from_the_frozen_run_shows(spark, case):
    q, d, r, frozen, expected = case
    routed = frozen.where("rerank").select("query_id")
    more = runtime.execute(q, d, r, routed.unionByName(spark.createDataFrame([("q1",)], "query_id string")), fusion.overlap_scorer, 4)
    assert (more.calls, more.pairs) == (4, 16) and ("q1", "decision differs") in rules(more, frozen, expected)
    every = runtime.execute(q, d, r, q, fusion.overlap_scorer, 4)  # the ranking alone wouldn't show a scorer that always runs
    assert every.calls == 6 and [x for x in rules(every, frozen, expected) if x[1] == "decision differs"] == [(f"q{i}", "decision differs") for i in (1, 3, 5)]
    less = runtime.execute(q, d, r, routed.where("query_id <> 'q2'"), fusion.overlap_scorer, 4)
    assert ("q2", "decision differs") in rules(less, frozen, expected)
    shallow = runtime.execute(q, d, r, routed, fusion.overlap_scorer, 3)
    assert [x for x in rules(shallow, frozen, expected) if x[1] == "pairs differ"] == [(f"q{i}", "pairs differ") for i in (0, 2, 4)]
    good = runtime.execute(q, d, r, routed, fusion.overlap_scorer, 4)
    assert rules(replace(good, calls=4), frozen, expected) == [("all queries", "observed calls differ")]
    assert rules(good, frozen.unionByName(spark.createDataFrame([("q9", False)], frozen.schema)), expected) == [("q9", "not run")]
    assert ("q5", "no decision") in rules(good, frozen.where("query_id <> 'q5'"), expected)
    other = expected.withColumn("doc_id", F.when((F.col("query_id") == "q3") & (F.col("rank") == 6), "d0").otherwise(F.col("doc_id")))
    assert rules(good, frozen, other) == [("q3", "ranking differs")]
    calls_twice = replace(good, records=good.records.withColumn("calls", F.col("calls") * 2), calls=6)
    assert rules(calls_twice, frozen, expected) == [(f"q{i}", "calls differ") for i in (0, 2, 4)]


def test_scorers_that_lose_or_invent_scores_and_bad_depths_fail(spark, case):
    q, d, r, frozen, _ = case
    routed = frozen.where("rerank").select("query_id")
    for bad, match in ((lambda: lambda query, texts: [1.0], "1 scores of 4"), (lambda: lambda query, texts: [float("nan")] * len(texts), "one finite score")):
        with pytest.raises(Exception, match=match):
            runtime.execute(q, d, r, routed, bad, 4).ranking.collect()
    for depth in (0, -1, True, 1.5):
        with pytest.raises(ValueError, match="positive"):
            runtime.execute(q, d, r, routed, fusion.overlap_scorer, depth)
    with pytest.raises(Exception, match="one finite score"):
        runtime.execute(q, d.where("doc_id <> 'd1'"), r, routed, fusion.overlap_scorer, 4).ranking.collect()
    none = runtime.execute(q, d, r, routed.where("false"), fusion.overlap_scorer, 4)
    assert (none.calls, none.pairs) == (0, 0) and none.ranking.count() == 36


def test_tokens_in_workers_are_those_of_the_engine(spark):
    texts = ["", "A b_C-9", "Éé İstanbul Ko", "x\x00y  z", "漢字 ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.tokenize(F.col("t")).alias("w"), "t").collect()
    assert all(x.w == tx.plain_tokens(x.t) for x in got)


def test_tasks_tried_twice_count_once(tmp_path):
    """Its own session: a local master tries tasks again only if its name says so."""
    code = textwrap.dedent("""
        import os, sys
        from pyspark.sql import SparkSession
        from pyspark import TaskContext
        from tessera.operators import runtime
        s = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
        s.sparkContext.setLogLevel("OFF")

        def load():
            n = [0]
            def score(query, texts):
                n[0] += 1
                if TaskContext.get().attemptNumber() == 0 and n[0] > 2:
                    raise RuntimeError("lost")
                return [float(len(t)) for t in texts]
            return score

        q = s.range(20).selectExpr("concat('q', id) AS query_id", "'x' AS query")
        d = s.range(3).selectExpr("concat('d', id) AS doc_id", "repeat('x', int(id)) AS text")
        r = q.select("query_id").crossJoin(d.select("doc_id")).selectExpr("*", "bigint(substr(doc_id, 2)) + 1 AS rank")
        ran = runtime.execute(q, d, r, q, load, 3)
        print("COUNTED", ran.calls, ran.pairs, ran.records.count(), ran.ranking.where("rank = 1 AND doc_id = 'd2'").count())
    """)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    got = subprocess.run([sys.executable, "-c", code, f"file://{tmp_path}"], capture_output=True, text=True, timeout=180, env=env)
    assert "COUNTED 20 60 20 20" in got.stdout, got.stderr[-2000:]
