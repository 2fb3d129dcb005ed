import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import flatten_json, tokenize
from tessera.operators import fusion, splits
from tessera.operators.bm25 import Index
from tessera.operators.components import connected_components
from tessera.operators.stats import hash_bootstrap, numbered, sign_test
from tessera.sources.tables import derived_qrels


def test_bm25_ranks_pads_and_counts_query_repeats(spark):
    docs = spark.createDataFrame([("weather", "forecast the city weather"), ("stocks", "stock price"), ("math", "add numbers"), ("10", "x"), ("2", None)], "doc_id string, text string")
    qs = spark.createDataFrame([("q", "forecast city weather"), ("none", "zzz")], "query_id string, query string")
    got = {}
    for r in Index(docs).search(qs, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got["q"][0][0] == "weather" and got["q"][0][1] > 0 and [x[0] for x in got["q"][1:]] == ["10", "2"]
    assert [x[0] for x in got["none"]] == ["10", "2", "math"]
    assert Index(docs).search(qs, 0).count() == 0


def test_tokens_are_cut_before_lower_casing(spark):
    assert spark.range(1).select(tokenize(F.lit("A_b \u212ax \u00e99"))).first()[0] == ["a_b", "x", "9"]


def test_flatten_json_order_and_names():
    assert flatten_json('{"id": 1, "z_key": null, "name": "n", "parameters": {"a": [true, "b"]}}') == "name n a True b z key"


def test_rrf_and_prefix_rerank(spark):
    leg = lambda ids: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "query_id string, doc_id string, rank int")
    out = fusion.weighted_rrf([leg("ba"), leg("ab")])
    assert [r.doc_id for r in out.orderBy("rank").collect()] == ["a", "b"]
    assert [r.doc_id for r in fusion.weighted_rrf([leg("ba"), leg("ab")], first_seen=True).orderBy("rank").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        fusion.weighted_rrf([leg("a")], [1, 2])
    s = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 0.0)], "query_id string, doc_id string, pair_score double")
    assert [r.doc_id for r in fusion.rerank_prefix(leg("bacd"), s, 3).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_grouped_quota_raises_when_infeasible(spark):
    c = spark.createDataFrame([("a", "s", 3), ("b", "s", 4)], "component string, src string, n int")
    with pytest.raises(ValueError):
        splits.grouped_quota(c, {"s": 1}, "x")


def test_sign_test():
    assert sign_test(5, 0) == 1 / 16 and sign_test(1, 4) == 0.375 and sign_test(0, 0) == 1.0


def test_numbers_follow_the_order_over_many_parts(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.k == r.i for r in numbered(df.repartition(7), "k", "i").collect())
    assert numbered(df.where("false"), "k", "i").count() == 0


def test_bootstrap_draws_by_hash(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(9)], "k string, v double")
    draw = lambda r, j: int(hashlib.md5(f"s|{r}|{j}".encode()).hexdigest()[:8], 16) % 9
    got = {r.r: r["mean"] for r in hash_bootstrap(df, "k", "v", 5, "s").collect()}
    assert got == {r: pytest.approx(sum(draw(r, j) for j in range(9)) / 9) for r in range(5)}
    assert hash_bootstrap(df.where("false"), "k", "v", 5, "s").count() == 0


def test_grouped_quota_against_a_greedy_fold(spark):
    rnd = random.Random(8)
    rows = [(f"c{i}", rnd.choice("xyz"), rnd.choice([1, 1, 2, 3, 7])) for i in range(80)]
    quota, want = {"x": 9, "y": 23, "z": 0}, set()
    left = dict(quota)
    for c, s, n in sorted(rows, key=lambda r: (hashlib.sha256(f"g\x00{r[0]}".encode()).hexdigest(), r[0])):
        if n <= left[s]:
            left[s] -= n
            want.add(c)
    got = splits.grouped_quota(spark.createDataFrame(rows, "component string, src string, n int"), quota, "g", strict=False)
    assert got.count() == 80 and {r.component for r in got.where("chosen").collect()} == want
    none = splits.grouped_quota(spark.createDataFrame([], "component string, src string, n int"), quota, "g", strict=False)
    assert none.count() == 0


def test_query_components_follow_shared_documents(spark):
    qs = spark.createDataFrame([(q,) for q in "cbade"], "query_id string")
    rel = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "query_id string, doc_id string")
    assert {r.query_id: r.component for r in splits.query_components(qs, rel).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_qrels_of_queries_with_few_tokens(spark):
    docs = [("1", "a foo bar here"), ("2", "привет мир"), ("3", "foobar, foo ba"), ("4", None), ("5", "one two three four")]
    qs = [("a", "foo"), ("b", "foo ba"), ("c", "привет"), ("d", "two three fo"), ("e", "none"), ("f", None), ("g", "e two three f")]
    got = derived_qrels(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(qs, "query_id string, query string")).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for q, x in qs for d, t in docs if x and t and x in t)


def test_parts_of_an_index_hold_as_much_text_at_any_size(spark):
    from tessera.operators.bm25 import dealt

    docs = spark.range(100).selectExpr("string(id) AS doc_id", "repeat('word ', 20) AS text")
    assert dealt(docs, 500).rdd.getNumPartitions() == 20 and dealt(docs).count() == 100
    assert dealt(docs.where("false"), 500).count() == 0
