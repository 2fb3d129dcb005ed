import pytest
from pyspark.sql import functions as F

from tessera.operators.gate import Check, gate, require_complete
from tessera.plans import steps
from tessera.plans.steps import Step

CHECKS = [Check("decisions", "decisions", "rerank <> (p > 0)", ("predictions",)), Check("predictions", "predictions", "p IS NULL OR isnan(p)", ("corpus",)), Check("corpus", "corpus", "doc_id IS NULL"),
          Check("latency", "latency", "ms <= 0", ("corpus",)), Check("summary", "decisions", "p > 9", ("decisions", "latency")), Check("own", "other", "x < 0", (), 0)]


def relations(spark):
    return {"corpus": spark.createDataFrame([("a",), ("b",)], "doc_id string"), "predictions": spark.createDataFrame([(0.5,), (-0.5,)], "p double"),
            "decisions": spark.createDataFrame([(0.5, True, {"k": 1}), (-0.5, False, None)], "p double, rerank boolean, m map<string, int>"),
            "latency": spark.createDataFrame([(3.0,)], "ms double"), "other": spark.createDataFrame([], "x int")}


def of(spark, rel):
    return {r.check: r for r in gate(spark, rel, CHECKS).collect()}


def test_breaking_one_input_stops_its_dependants_only(spark):
    rel = relations(spark)
    fine = of(spark, rel)
    assert [r.check for r in gate(spark, rel, CHECKS).collect()] == [c.name for c in CHECKS]
    assert {r.status for r in fine.values()} == {"passed"} and len({r.digest for r in fine.values()}) == len(CHECKS)
    assert require_complete(gate(spark, rel, CHECKS)) == require_complete(gate(spark, {n: d.repartition(3) for n, d in rel.items()}, CHECKS[::-1]))
    after = {"corpus": {"corpus", "predictions", "decisions", "latency", "summary"}, "predictions": {"predictions", "decisions", "summary"}, "latency": {"latency", "summary"}, "decisions": {"decisions", "summary"}}
    odd = {"corpus": spark.createDataFrame([("a",), (None,)], "doc_id string"), "predictions": spark.createDataFrame([(float("nan"),)], "p double"), "latency": spark.createDataFrame([(-1.0,), (None,)], "ms double"),
           "decisions": spark.createDataFrame([(0.5, False, None), (0.5, None, None)], "p double, rerank boolean, m map<string, int>")}
    for name, bad in odd.items():
        for broken, status in ((bad, "failed"), (None, "missing"), (bad.limit(0), "missing")):
            got = of(spark, {**rel, name: broken})
            assert got[name].status == status
            assert {c: r.status for c, r in got.items() if c != name} == {c: "blocked" if c in after[name] else "passed" for c in got if c != name}
            assert {c for c in got if got[c].digest != fine[c].digest} >= after[name]
            assert "own" not in {c for c in got if got[c].digest != fine[c].digest}
            with pytest.raises(ValueError, match=f"{name}: {status}"):
                require_complete(gate(spark, {**rel, name: broken}, CHECKS))
    assert of(spark, {**rel, "latency": odd["latency"]})["latency"].broken == 2  # null is broken, too


def test_digests_follow_the_evidence(spark):
    rel = relations(spark)
    assert gate(spark, rel, [Check("c", "latency", F.col("ms") > 2)]).first().broken == 1
    a, b = of(spark, rel), of(spark, {**rel, "latency": spark.createDataFrame([(4.0,)], "ms double")})
    assert {c for c in a if a[c].digest != b[c].digest} == {"latency", "summary"} and {r.status for r in b.values()} == {"passed"}


def test_graphs_that_make_no_sense(spark):
    for checks, rule in (([CHECKS[2], CHECKS[2]], "one name"), ([CHECKS[0]], "not there"), ([Check("a", "x", "true", ("b",)), Check("b", "x", "true", ("a",))], "need one another")):
        with pytest.raises(ValueError, match=rule):
            gate(spark, {}, checks)
    with pytest.raises(ValueError, match="no checks"):
        require_complete(gate(spark, {}, []))


def test_steps_are_made_once_and_after_what_changed(spark, tmp_path):
    src, folder = {n: str(tmp_path / n) for n in ("docs", "asks")}, str(tmp_path / "kept")
    for p in src.values():
        spark.range(10).write.parquet(p)
    calls, stop = [], set()

    def build(name):
        def make(*given, factor=1):
            calls.append(name)
            if name in stop:
                raise RuntimeError(name)
            return given[0].select((F.sum("id") * factor + len(given)).alias("id"))
        return make

    plan = lambda factor=1: [Step("index", ["docs"], build("index")), Step("found", ["index", "asks"], build("found"), {"factor": factor}), Step("terms", ["docs"], build("terms")), Step("report", ["found"], build("report"))]
    stop.add("terms")
    with pytest.raises(RuntimeError):
        steps.run(spark, folder, plan(), src)
    assert calls == ["index", "found", "terms"]
    stop.clear(), calls.clear()
    tables, made = steps.run(spark, folder, plan(), src)
    assert made == calls == ["terms", "report"] and tables["report"].first().id == 45 + 1 + 2 + 1
    assert steps.run(spark, folder, plan(), src)[1] == [] and len(calls) == 2
    spark.range(11).write.mode("overwrite").parquet(src["asks"])
    assert steps.run(spark, folder, plan(), src)[1] == ["found", "report"]
    tables, made = steps.run(spark, folder, plan(2), src)
    assert made == ["found", "report"] and tables["found"].first().id == 2 * 46 + 2
    # Two tables of a step are kept: going back to the parameter before is free, to the input before it isn't.
    assert steps.run(spark, folder, plan(1), src)[1] == []
    assert len(list((tmp_path / "kept" / "found").iterdir())) == 2 and len(list((tmp_path / "kept" / "index").iterdir())) == 1
    # What a stopped run left has no entry.
    key = steps.keys(spark, plan(1), src)["report"]
    (tmp_path / "kept" / "report" / key / "_SUCCESS").unlink()
    assert steps.run(spark, folder, plan(1), src)[1] == ["report"]


def test_plans_of_steps_that_make_no_sense(spark, tmp_path):
    with pytest.raises(ValueError, match="isn't made before"):
        steps.keys(spark, [Step("a", ["b"], None)], {})
    with pytest.raises(ValueError, match="two of the name"):
        steps.keys(spark, [Step("a", [], None), Step("a", [], None)], {})
    with pytest.raises(ValueError, match="positive"):
        steps.run(spark, str(tmp_path), [], {}, keep=0)
