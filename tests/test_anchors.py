import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors, splits
from tessera.plans.lineage import ensure_checkpoint_dir

SEED = "fixed"


def tables(spark, rows):
    """rows: (id, src, documents)"""
    q = spark.createDataFrame([(i, s) for i, s, _ in rows], "query_id string, src string")
    g = spark.createDataFrame([(i, d) for i, _, ds in rows for d in ds], "query_id string, doc_id string")
    return q, g, splits.query_components(q, g)


def plain_components(rows):
    name = {i: i for i, _, _ in rows}
    while True:
        low = {}
        for i, _, ds in rows:
            for d in ds:
                low[d] = min(low.get(d, name[i]), name[i])
        new = {i: min([name[i], *[low[d] for d in ds]]) for i, _, ds in rows}
        if new == name:
            return name
        name = new


def plain_split(rows, seen, quotas):
    """Components one by one, as the rule says."""
    comp = plain_components(rows)
    key = lambda c: (hashlib.sha256(f"{SEED}\0{c}".encode()).hexdigest(), c)
    held = {comp[i] for i in seen}
    at = {c: "quarantined" for c in held}
    for name, quota in quotas.items():
        left = dict(quota)
        for c in sorted({*comp.values()} - at.keys(), key=key):
            n = {}
            for i, s, _ in rows:
                if comp[i] == c:
                    n[s] = n.get(s, 0) + 1
            if all(v <= left.get(s, 0) for s, v in n.items()):
                at[c] = name
                for s, v in n.items():
                    left[s] -= v
    return {i: "development" if i in seen else at.get(comp[i], "reserve") for i, _, _ in rows}


def split(spark, rows, seen, quotas, **more):
    q, _, comp = tables(spark, rows)
    a = spark.createDataFrame([(i,) for i in seen], "query_id string")
    return {r.query_id: r.split for r in anchors.anchored_split(q, comp, a, quotas, SEED, **more).collect()}


def test_neighbours_of_what_was_seen_are_quarantined(spark):
    rows = [("pilot", "a", ["p1"]), ("linked", "a", ["p1", "p2"]), ("transitive", "a", ["p2"]), *[(f"fresh{i}", "a", [f"t{i}"]) for i in range(7)]]
    quotas = {"calibration": {"a": 2}, "confirmation": {"a": 3}}
    got = split(spark, rows, ["pilot"], quotas)
    assert {i for i, s in got.items() if s == "quarantined"} == {"linked", "transitive"} and got["pilot"] == "development"
    assert sorted(got.values()).count("calibration") == 2 and sorted(got.values()).count("confirmation") == 3
    assert got == split(spark, rows[::-1], ["pilot"], quotas) == plain_split(rows, {"pilot"}, quotas)


def test_components_are_never_cut_to_meet_a_quota(spark):
    rows = [("pilot", "a", []), ("a", "a", ["t1"]), ("b", "a", ["t1"]), ("c", "a", ["t2"]), ("d", "a", ["t2"])]
    with pytest.raises(ValueError, match="infeasible for calibration: {'a': 1}"):
        split(spark, rows, ["pilot"], {"calibration": {"a": 1}, "confirmation": {"a": 2}})
    got = split(spark, rows, ["pilot"], {"calibration": {"a": 1}, "confirmation": {"a": 2}}, strict=False)
    assert sorted(got.values()) == ["confirmation"] * 2 + ["development"] + ["reserve"] * 2


def test_components_over_several_sources_fit_all_of_their_quotas(spark):
    rows = [("pilot_a", "a", []), ("pilot_b", "b", []), ("pair_a", "a", ["x"]), ("pair_b", "b", ["x"]), *[(f"{s}{i}", s, []) for s in "ab" for i in range(4)]]
    got = split(spark, rows, ["pilot_a", "pilot_b"], {"calibration": {"a": 1, "b": 1}, "confirmation": {"a": 2, "b": 2}})
    src = {i: s for i, s, _ in rows}
    for name, n in (("calibration", 1), ("confirmation", 2)):
        assert sorted(src[i] for i, s in got.items() if s == name) == sorted("ab" * n)
    assert got["pair_a"] == got["pair_b"]


@pytest.mark.parametrize("seed", range(2))
def test_splits_against_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(f"q{i}", r.choice("abc"), [f"d{r.randrange(90)}" for _ in range(r.choice([0, 1, 1, 2]))]) for i in range(120)]
    seen = {f"q{r.randrange(120)}" for _ in range(3)}
    quotas = {"calibration": {"a": 9, "b": 4}, "confirmation": {"a": 7, "b": 12, "c": r.randrange(20)}}
    assert split(spark, rows, seen, quotas, strict=False) == plain_split(rows, seen, quotas)


def test_odd_ids_are_refused(spark):
    q, _, comp = tables(spark, [("a", "x", []), ("b", "x", [])])
    of = lambda *i: spark.createDataFrame([(x,) for x in i], "query_id string")
    for rows, seen, rule in ((q, of("c"), "unknown anchor: c"), (q, of("a", "a"), "repeated id: a"), (q.union(q), of("a"), "repeated id: a"), (q.union(spark.createDataFrame([(None, "x")], q.schema)), of(), "null id"), (q, of("a"), "no component: b")):
        with pytest.raises(ValueError, match=rule):
            anchors.tagged(rows, comp.where("component <> 'b'") if rule.startswith("no") else comp, seen)
    assert anchors.anchored_split(q.limit(0), comp, of(), {"calibration": {"x": 0}}, SEED).collect() == []
    with pytest.raises(ValueError, match="infeasible"):
        anchors.anchored_split(q.limit(0), comp, of(), {"calibration": {"x": 1}}, SEED)


def test_direct_and_component_wide_disjointness(spark):
    q, gold, comp = tables(spark, [("a", "x", ["t1"]), ("bridge", "x", ["t1", "t2"]), ("c", "x", ["t2"]), ("d", "y", ["t3"]), ("e", "y", ["t1"])])
    place = spark.createDataFrame([("a", "development"), ("bridge", "reserve"), ("c", "confirmation"), ("d", "confirmation"), ("e", "confirmation")], "query_id string, split string")
    rows = q.join(comp, "query_id").join(place, "query_id").withColumn("norm", F.when(F.col("query_id").isin("a", "d"), "same").otherwise(F.col("query_id")))
    got = {r.query_id: (r.direct, r.component_wide) for r in anchors.unseen(rows, gold, ["development", "calibration"], "confirmation").collect()}
    assert got == {"c": (True, False), "d": (True, True), "e": (False, False)}
    assert {tuple(r) for r in anchors.unseen_counts(rows, gold, ["development"], "confirmation").collect()} == {("x", 1, 1, 0), ("y", 2, 1, 1)}
    shared = {(r.what, r.a, r.b): r.shared for r in anchors.split_overlaps(rows, gold).collect()}
    assert shared == {("text", "confirmation", "development"): 1, ("document", "confirmation", "development"): 1, ("document", "confirmation", "reserve"): 2, ("document", "development", "reserve"): 1,
                      ("component", "confirmation", "development"): 1, ("component", "confirmation", "reserve"): 1, ("component", "development", "reserve"): 1}


def test_unseen_orders_keep_only_what_is_asked_for(spark):
    from tessera import registry
    from tests.test_skew import kept_bytes

    d = "/root/testdata/sf0.01"
    ensure_checkpoint_dir(spark)
    before, n = kept_bytes(spark), spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert registry.queries()["unseen_orders"](spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '5-LOW'").join(spark.read.parquet(f"{d}/lineitem.parquet"), F.expr("o_orderkey = l_orderkey"), "left_semi").count()
    assert kept_bytes(spark) - before < 10 * n
