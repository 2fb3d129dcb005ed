import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import checks, failures, features, fusion, history, latency, metrics, policies, router, splits, stats, vector
from tessera.sources import tables

RANKED = "method string, query_id string, doc_id string, rank int"


def ranked(spark, rows):
    """rows: {(method, query): ids}"""
    return spark.createDataFrame([(m, q, d, i + 1) for (m, q), ids in rows.items() for i, d in enumerate(ids)], RANKED)


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "query_id string")


def qrels(spark, gold):
    return spark.createDataFrame([(q, d) for q, ds in gold.items() for d in ds], "query_id string, doc_id string")


def test_metrics_against_plain_ones(spark):
    r = random.Random(4)
    docs, qs = [f"d{i}" for i in range(30)], [f"q{i}" for i in range(15)]
    runs = {(m, q): r.sample(docs, r.randint(0, 25)) for m in "ab" for q in qs if r.random() < 0.8}
    gold = {q: r.sample(docs, r.randint(1, 14)) for q in qs if r.random() < 0.8}
    got = {(x.method, x.query_id, x.k): x for x in metrics.evaluate(ranked(spark, runs), qrels(spark, gold), ids(spark, qs), [0, 1, 5, 10]).collect()}
    assert len(got) == 2 * len(qs) * 4
    for (m, q, k), x in got.items():
        run, rel = runs.get((m, q), []), set(gold.get(q, ()))
        hit = [i + 1 for i, d in enumerate(run) if d in rel]
        top = [i for i in hit if i <= k]
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(rel), k) + 1))
        want = (len(top) / len(rel) if rel else 0, 1 / top[0] if top else 0, 1 / hit[0] if hit else 0, sum(1 / math.log2(i + 1) for i in top) / ideal if ideal else 0, float(bool(rel) and len(top) == len(rel)))
        assert (x.recall, x.mrr, x.rr, x.ndcg, x.coverage) == pytest.approx(want) and x.first_rank == (hit[0] if hit else None) and x.gold == len(rel)
    assert metrics.evaluate(ranked(spark, runs), qrels(spark, {}), ids(spark, qs)).agg(F.sum("ndcg") + F.sum("rr")).first()[0] == 0


def test_effects_and_transitions(spark):
    pairs = [(None, None, "unchanged_missing", "absent"), (None, 3, "improved", None), (3, None, "hurt", None), (3, 3, "unchanged", "kept"), (4, 3, "improved", "raised"), (3, 4, "hurt", "lowered"), (9, 11, "hurt", "left_top10"), (11, 10, "improved", "entered_top10"), (12, 15, "hurt", "outside_top10")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "i int, a int, b int")
    got = df.select(metrics.rank_effect(F.col("a"), F.col("b")), metrics.transition(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [(e, t) for _, _, e, t in pairs]


def test_features_against_plain_ones(spark):
    r = random.Random(2)
    docs = [f"d{i}" for i in range(60)]
    legs = {(m, f"q{i}"): r.sample(docs, r.choice([1, 3, 25, 40])) for i in range(12) for m in "ab"}
    legs["a", "same"] = legs["b", "same"] = docs[:20]
    legs["a", "one"], legs["b", "one"] = docs[:1], docs[:1]
    words = {"same": "a\tb  c\n d", "one": ""}
    names = sorted({q for _, q in legs})
    qs = spark.createDataFrame([(q, words.get(q, "x y")) for q in names], "query_id string, query string")
    both = ranked(spark, legs)
    got = {x.query_id: x for x in features.router_features(qs, both.where("method = 'a'"), both.where("method = 'b'")).collect()}
    for q in names:
        a, b = legs["a", q], legs["b", q]
        jac = lambda k: len(set(a[:k]) & set(b[:k])) / len(set(a[:k]) | set(b[:k]))
        union = set(a[:20]) | set(b[:20])
        at = lambda x, d: x[:20].index(d) + 1 if d in x[:20] else None
        w = [(1 / at(a, d) if at(a, d) else 0, 1 / at(b, d) if at(b, d) else 0) for d in union]
        fused = Counter()
        for leg in (a, b):
            for i, d in enumerate(leg):
                fused[d] += 1 / (61 + i)
        s = sorted((round(v, 9) for v in fused.values()), reverse=True)
        want = (float(a[0] != b[0]), jac(10), jac(20), sum(map(min, w)) / sum(map(max, w)), 1 - sum(abs((at(a, d) or 21) - (at(b, d) or 21)) for d in union) / len(union) / 20,
                math.log1p(len(words.get(q, "x y").split())), 1.0 if len(s) == 1 else (s[0] - s[1]) / s[0])
        assert tuple(got[q][f] for f in router.FEATURES) == pytest.approx(want)


def test_word_counts_are_those_of_str_split(spark):
    texts = ["", "a", " a  b\tc\nd ", "a b c　d", "a\x1cb\x1fc\x85d", "​ x", None]
    got = [x.n for x in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.word_count(F.col("t")).alias("n")).collect()]
    assert got == [len((t or "").split()) for t in texts]


def test_published_router_and_its_way_through_json():
    m = router.PUBLISHED
    assert router.Ridge.from_json(m.to_json()) == m and len(m.coefficients) == 7
    body = json.loads(m.to_json())
    for wrong in ({"features": body["features"][::-1]}, {"scales": [0.0] * 7}, {"means": [1.0]}, {"intercept": float("nan")}):
        with pytest.raises(ValueError):
            router.Ridge.from_json(json.dumps(body | wrong))


def test_fit_refuses_targets_outside_its_range(spark):
    row = [0.0] * 7
    for ys in ([0.5], [0.5, 1.5], [0.5, None]):
        with pytest.raises(ValueError):
            router.fit(spark.createDataFrame([(*row, y) for y in ys], ", ".join(f"{f} double" for f in (*router.FEATURES, "y"))), "y")


def decided(spark, seed=5, n=40):
    r = random.Random(seed)
    rows = [(f"q{i:02d}", r.choice("xy"), float(r.random() < 0.5), r.random(), round(r.gauss(0, 1), 3)) for i in range(n)]
    gain = [(q, s, b := round(r.random(), 3), a := r.choice([b, round(r.random(), 3)]), a - b) for q, s, *_ in rows]
    return rows, gain, spark.createDataFrame(rows, "query_id string, src string, top1_disagreement double, jaccard10 double, p double"), spark.createDataFrame(gain, "query_id string, src string, base double, after double, d double")


def test_policies_against_plain_loops(spark):
    rows, gain, pred, g = decided(spark)
    th = {x.budget: x.threshold for x in policies.calibrate(pred, [0.25, 0.5, 0.75]).collect()}
    p = sorted(x[4] for x in rows)

    def quantile(q):
        at = q * (len(p) - 1)
        return p[int(at)] + (p[min(int(at) + 1, len(p) - 1)] - p[int(at)]) * (at - int(at))

    assert th == {b: pytest.approx(quantile(1 - b)) for b in (0.25, 0.5, 0.75)}
    d = policies.decide(pred, policies.calibrate(pred, [0.25, 0.5, 0.75]))
    rule = {"never": lambda x: False, "always": lambda x: True, "fixed_disagreement": lambda x: x[2] > 0, "cheap_jaccard": lambda x: x[3] < 0.5} | {f"utility_{int(b * 100)}": lambda x, t=t: x[4] > t for b, t in th.items()}
    chosen = {name: {x[0] for x in rows if f(x)} for name, f in rule.items()}
    got = defaultdict(set)
    for x in d.collect():
        if x.rerank:
            got[x.policy].add(x.query_id)
    assert dict(got) == {k: v for k, v in chosen.items() if v}
    both = d.join(g.drop("src"), "query_id")
    for x in policies.summarise(both, True).collect():
        mine = [v for v in gain if x.src in ("all", v[1])]
        assert x.ndcg10 == pytest.approx(sum(v[3] if v[0] in chosen[x.policy] else v[2] for v in mine) / len(mine))
        assert x.calls == sum(v[0] in chosen[x.policy] for v in mine) and x.pairs == 20 * x.calls
    for x in policies.effects(both).collect():
        skip, run = [v[4] for v in gain if v[0] not in chosen[x.policy]], [v[4] for v in gain if v[0] in chosen[x.policy]]
        assert (x.harmful_skips, x.beneficial_skips, x.harmful_reranks, x.beneficial_reranks) == (sum(v > 1e-12 for v in skip), sum(v < -1e-12 for v in skip), sum(v < -1e-12 for v in run), sum(v > 1e-12 for v in run))
        assert (x.forgone, x.avoided) == pytest.approx((sum(v for v in skip if v > 0), -sum(v for v in skip if v < 0)))
    for x in policies.oracle_ceiling(both, g).collect():
        best = sorted(gain, key=lambda v: (-round(v[4], 9), v[0]))[: len(chosen[x.policy])]
        assert x.ndcg10 == pytest.approx((sum(v[2] for v in gain) + sum(v[4] for v in best)) / len(gain))
    for by in (False, True):
        for x in policies.random_controls(both, g, ["0", "1", "2"], by).collect():
            seen = []
            for seed in "012":
                drawn = set()
                for s in "xy" if by else [None]:
                    pool = sorted((v[0] for v in gain if s in (None, v[1])), key=lambda q: (hashlib.sha256(f"{seed}|{q}".encode()).hexdigest(), q))
                    drawn |= set(pool[: sum(v[0] in chosen[x.policy] for v in gain if s in (None, v[1]))])
                seen.append(sum(v[3] if v[0] in drawn else v[2] for v in gain) / len(gain))
            assert (x["mean"], x.low, x.high) == pytest.approx((sum(seen) / 3, min(seen), max(seen)))
    assert policies.non_inferior([-0.005, 0.0], 3, 5) and not policies.non_inferior([-0.01], 3, 5) and not policies.non_inferior([0.1], 5, 5) and not policies.non_inferior([], 1, 2)


def plain_weight(seed, unit, rep):
    h = lambda x: int(hashlib.md5(f"{seed}|{x}".encode()).hexdigest()[:8], 16) % stats.PRIME
    x = (h(unit) + h(rep)) % stats.PRIME
    x = (pow(x, 5, stats.PRIME) + stats.ADDED) % stats.PRIME
    x = (pow((x + h(unit)) % stats.PRIME, 5, stats.PRIME) + stats.ADDED) % stats.PRIME
    total, w = math.exp(-1), 0
    while x >= int(stats.PRIME * total):
        w += 1
        total += math.exp(-1) / math.factorial(w)
    return w


def test_weighted_bootstrap_against_plain_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("pq"), r.choice("xy"), f"c{r.randrange(9)}", r.gauss(0, 1), r.random()) for _ in range(90)] + [("p", "z", "alone", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "b string, g string, c string, v double, w double").repartition(3)
    got = {(x.b, x.r): (x.v, x.w) for x in stats.weighted_bootstrap(df, "g", "c", ["v", "w"], 70, "s", ["b"]).collect()}
    assert len(got) == 140
    for b in "pq":
        for rep in range(70):
            means = []
            for g in sorted({x[1] for x in rows if x[0] == b}):
                own = [x for x in rows if x[:2] == (b, g)]
                w = {x[2]: plain_weight("s", x[2], rep) for x in own}
                w = w if any(w.values()) else dict.fromkeys(w, 1)
                means.append([sum(w[x[2]] * x[k] for x in own) / sum(w[x[2]] for x in own) for k in (3, 4)])
            assert got[b, rep] == pytest.approx(tuple(sum(m[k] for m in means) / len(means) for k in (0, 1)))
    assert stats.weighted_bootstrap(df.where("false"), "g", "c", ["v"], 5, "s").count() == 0
    for n in (0, True, 1.5):
        with pytest.raises(ValueError, match="positive"):
            stats.weighted_bootstrap(df, "g", "c", ["v"], n, "s")


def test_weights_are_poisson_draws_that_units_and_replicates_share_nothing_of():
    r = np.random.default_rng(1)
    w = stats.unit_weights(r.integers(0, stats.PRIME, 400), r.integers(0, stats.PRIME, 3000)).astype(float)
    for k in range(6):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.002)
    assert w.mean() == pytest.approx(1, abs=0.003) and w.var() == pytest.approx(1, abs=0.01)
    for x in (w[:60], w.T[:60]):
        off = np.corrcoef(x) - np.eye(60)
        assert np.abs(off).max() < 5 / math.sqrt(x.shape[1])


def test_intervals_of_means_are_near_those_of_draws_with_replacement(spark):
    r = random.Random(5)
    v = [r.gauss(0.2, 1) for _ in range(300)]
    df = spark.createDataFrame([("a", f"u{i}", x, 0.125, 2 * x) for i, x in enumerate(v)], "g string, u string, v double, k double, v2 double")
    got = stats.weighted_bootstrap(df, "g", "u", ["v", "k", "v2"], 20_000, "seed")
    one, const, two = (stats.interval(got, c).first() for c in ("v", "k", "v2"))
    x = np.random.default_rng(3).choice(v, (20_000, 300)).mean(axis=1)
    assert (one.low, one.high) == pytest.approx(tuple(np.quantile(x, [0.025, 0.975])), abs=0.006) and one.resamples == 20_000
    assert (const.low, const.high) == pytest.approx((0.125, 0.125)) and (two.low, two.high) == pytest.approx((2 * one.low, 2 * one.high))
    again = stats.interval(stats.weighted_bootstrap(df.repartition(5), "g", "u", ["v"], 20_000, "seed"), "v").first()
    assert (again.low, again.high) == pytest.approx((one.low, one.high), abs=1e-12)


def test_percentile_interval(spark):
    one = stats.interval(spark.createDataFrame([(float(i),) for i in range(101)], "v double"), "v").first()
    assert (one.low, one.high, one.resamples) == (pytest.approx(2.5), pytest.approx(97.5), 101)


def test_latency_of_repeated_queries(spark):
    ev = spark.createDataFrame([(q, p, float(10 * q + (p == "b") + t), t, f"{q}{p}{t}") for q in range(6) for p in "ab" for t in range(3)], "q int, p string, ms double, t int, id string")
    rows = latency.repetitions(ev, "q", "p", "ms", "t", "id")
    assert rows.agg(F.min("repetition"), F.max("repetition"), F.count("*")).first()[:] == (1, 3, 36)
    per = latency.against(rows, "a")
    got = latency.reductions(per).collect()
    assert [(x.policy, x.units) for x in got] == [("b", 6)] and got[0].delta_ms == pytest.approx(1) and got[0].reduction == pytest.approx(-1 / 26)
    ci = latency.reduction_intervals(per, 200, "z").collect()
    assert [x.policy for x in ci] == ["b"] and ci[0].delta_low == ci[0].delta_high == pytest.approx(1) and ci[0].reduction_low < -1 / 26 < ci[0].reduction_high < 0
    lone = latency.against(rows.where("NOT (query_id = 3 AND policy = 'a')"), "a")
    assert latency.reductions(lone).first().units == 5
    bad = [("a", "p", 0, 1.0, False, 0, "s"), ("a", "p", 1, -1.0, False, 0, "s"), ("b", "p", 0, 1.0, True, 0, "s"), ("b", "p", 1, 1.0, False, 0, "t"), ("c", "p", 0, 1.0, False, 0, "s"), ("d", "p", 0, 2.0, True, 3, "s"), ("d", "p", 1, 2.0, True, 3, "s")]
    rules = latency.violations(spark.createDataFrame(bad, "query_id string, policy string, repetition int, total_ms double, reranked boolean, scored_pairs int, src string"), 2).collect()
    assert sorted((x.id, x.rule) for x in rules) == [("a", "latency not positive and finite"), ("b", "calls and pairs disagree"), ("b", "routing changes"), ("b", "sources disagree"), ("c", "repetitions incomplete")]


def test_failure_records_and_strata(spark):
    docs = spark.createDataFrame([("a", "alpha beta gamma", "x"), ("b", "beta", "x"), ("c", "Get Image Screenshot", "y"), ("d", "delta " * 80, "x")], "doc_id string, text string, src string")
    qs = spark.createDataFrame([("1", "beta", "x"), ("2", "delta alpha", "x"), ("3", "none", "y")], "query_id string, query string, src string")
    run = ranked(spark, {("h", "1"): "abcd", ("h", "2"): "cadb", ("h", "3"): "abcd", ("r", "1"): "bacd", ("r", "2"): "cdab", ("r", "3"): "abcd"})
    h, a = (run.where(f"method = '{m}'").drop("method") for m in "hr")
    gold = qrels(spark, {"1": ["b"], "2": ["a", "d"]})
    gain = metrics.gains(metrics.evaluate(run, gold, qs), "h", "r")
    rec = failures.records(qs, docs, gold, h, a, gain, ids(spark, ["2"]), tx.tokenize, depth=3, budget=12, special=3, name=lambda x, y: F.lit(True))
    got = {x.query_id: x for x in rec.collect()}
    assert set(got) == {"1", "2"}
    one, two = got["1"], got["2"]
    assert (one.outcome, one.positives, one.in_prefix, one.cross_source, one.gate, one.pairs, one.pairs_truncated) == ("win", 1, 1, False, False, 3, 0)
    assert (two.positives, two.in_prefix, two.top1, two.cross_source, two.counterpart, two.gate, two.positive_pairs_truncated, two.query_tokens) == (2, 2, "c", True, True, True, 1, 2)
    assert two.doc_tokens == 41.5 and two.recall_prefix == 1.0
    s = {(x.stratum, x.value): x for x in failures.strata(rec, "X").collect()}
    assert len(s[("all", "all")]) == 25 and s["all", "all"].queries == 2 and s["source", "x"].positives == 3 and s["focus_outcome", one.outcome].queries >= 1 and s["gate", "selected"].cross_source == 1
    assert {k for k, _ in s} == {"source", "positives", "query_tokens", "positive_truncated", "doc_tokens", "coverage", "focus_outcome", "focus_truncated", "gate", "all"}


def test_missing_and_odd_scores_fail(spark):
    r = ranked(spark, {("h", "q"): "abc"}).drop("method")
    for rows in ([("q", "a", 1.0)], [("q", "a", 1.0), ("q", "b", float("nan"))], [("q", "a", 1.0), ("q", "a", 2.0), ("q", "b", 0.0)]):
        with pytest.raises(Exception, match="one finite score"):
            fusion.rerank_prefix(r, spark.createDataFrame(rows, "query_id string, doc_id string, pair_score double"), 2).collect()


def test_models_score_pairs_and_encode_texts(spark):
    qs = spark.createDataFrame([("q", "a b")], "query_id string, query string")
    docs = spark.createDataFrame([("x", "a"), ("y", "a b"), ("z", None)], "doc_id string, text string")
    scorer = fusion.model_scorer(qs, docs, lambda: lambda q, t: [len(set(a.split()) & set((b or "").split())) for a, b in zip(q, t)])
    r = ranked(spark, {("h", "q"): "xyz"}).drop("method")
    assert [x.doc_id for x in fusion.rerank_prefix(r, scorer(r), 3).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [x.doc_id for x in fusion.rerank(r, scorer, 2).orderBy("rank").collect()] == ["y", "x"] and fusion.rerank(r, scorer, 0).count() == 0
    assert fusion.ranking_differences(r, r).count() == 0 and fusion.ranking_differences(r, r.where("rank > 1")).collect()[0][:] == ("q", "x", 1, 1)
    v = {x.doc_id: list(x.v) for x in vector.encode(docs, "doc_id", "text", lambda: lambda ts: [[len(t) + 1.0, 0.0] for t in ts]).collect()}
    assert v == {"x": [1.0, 0.0], "y": [1.0, 0.0], "z": [1.0, 0.0]}
    with pytest.raises(Exception, match="not finite, or zero"):
        vector.encode(docs, "doc_id", "text", lambda: lambda ts: [[0.0]] * len(ts)).collect()


def test_fingerprints_names_and_splits(spark):
    rows = [["a", "b"], [], ["é", 'q"x', "back\\slash"], ["\U0001f600"], [None, "a"], None]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in rows], "ids array<string>").select(tx.ranking_fingerprint(F.col("ids"))).collect()]
    assert got == [None if x is None else hashlib.sha256(json.dumps(x).encode()).hexdigest() for x in rows]
    got = [x[0] for x in spark.createDataFrame([('{"name": "n", "x": 1}',), ("[1]",), (None,)], "b string").select(tx.tool_name(F.col("b"))).collect()]
    assert got == ["n", "", ""]
    df = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(20)], "id int, g string")
    order = lambda seed, some: sorted(some, key=lambda i: hashlib.sha256(f"{seed}{i}".encode()).hexdigest())
    split = {x.id: x.split for x in splits.holdout(df, "g", "id", "h|", {"a": 2, "b": 3}).collect()}
    for g in range(2):
        at = order("h|", range(g, 20, 2))
        assert [split[i] for i in at] == ["a"] * 2 + ["b"] * 3 + ["reserve"] * 5
    split = {x.id: x.split for x in splits.ratio_split(df, "id", "r|", {"train": 0.7, "dev": 0.15}, "test").collect()}
    assert [split[i] for i in order("r|", range(20))] == ["train"] * 14 + ["dev"] * 3 + ["test"] * 3
    rot = splits.rotated(df, "id", "z|", ["p", "q", "s"]).collect()
    assert Counter((x.policy, x.position) for x in rot if x.pos < 18) == Counter({(p, k): 6 for p in "pqs" for k in range(3)})
    got = sorted(x[:] for x in splits.overlaps(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("b", 2), ("c", 2), ("a", 3)], "s string, k int"), "s", "k").collect())
    assert got == [("a", "b", 1), ("a", "c", 1), ("b", "c", 2)]


def test_id_lists_and_rank_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿query_id,x\n1,2\n1,3\n,4\n")
    (tmp_path / "b.jsonl").write_text('{"id": "u"}\n\n{"qid": 7}\n"plain"\n')
    (tmp_path / "c.json").write_text('﻿["m", "n", "m"]')
    (tmp_path / "d.txt").write_text("﻿first\n\n second \nfirst\n")
    got = {n: {x.id for x in tables.read_ids(spark, str(tmp_path / n)).collect()} for n in ("a.csv", "b.jsonl", "c.json", "d.txt")}
    assert got == {"a.csv": {"1"}, "b.jsonl": {"u", "7", "plain"}, "c.json": {"m", "n"}, "d.txt": {"first", "second"}}
    (tmp_path / "r.csv").write_text("query_id,s_rank,s_rr\na,2,0.5\nb,,0.0\n")
    rows = tables.read_ranks_csv(spark, str(tmp_path / "r.csv"), "query_id string, s_rank int, s_rr double").collect()
    assert [tuple(x) for x in rows] == [("a", 2, 0.5), ("b", None, 0.0)]


def test_an_empty_corpus_has_no_index(spark):
    from tessera.operators.bm25 import Index

    docs = spark.createDataFrame([], "doc_id string, text string")
    with pytest.raises(ValueError, match="empty corpus"):
        Index(docs).search(spark.createDataFrame([("q", "a")], "query_id string, query string"), 3)


def test_rank_tables_are_audited(spark):
    ranks = spark.createDataFrame([("a", 1, 2), ("b", None, 4), ("c", 2, None), ("d", None, None), ("e", 5, 5)], "query_id string, x_rank int, y_rank int")
    rr = {"x": [1, 0, 0.5, 0, 0.2], "y": [0.5, 0.25, 0, 0, 0.2]}
    got = {r.system: r for r in history.system_summary(ranks, ["x", "y"], 200, "s").collect()}
    assert got["x"].mrr == pytest.approx(sum(rr["x"]) / 5) and got["x"].found == 3 and got["x"].low < got["x"].mrr < got["x"].high
    c = history.comparisons(ranks, [("x", "y")], 200, "s").first()
    assert c.delta == pytest.approx((sum(rr["y"]) - sum(rr["x"])) / 5) and (c.wins, c.losses, c.ties) == (1, 2, 2) and c.p_value == stats.sign_test(1, 2)
    summary = history.system_summary(ranks, ["x", "y"], 10, "s")
    assert [r.system for r in history.claim_differences(summary, {"x": 0.3401, "y": 0.191, "z": 0.5}).orderBy("system").collect()] == ["y", "z"]
    assert [(r.query_id, r.effect) for r in history.effects_by_step(ranks, ["x", "y"]).orderBy("place", "query_id").collect()] == [("a", "hurt"), ("c", "hurt"), ("b", "improved"), ("e", "unchanged"), ("d", "unchanged_missing")]


def test_caches_are_checked_in_full(spark):
    s = "query_id string, src string, split string, relevant_ids array<string>, bm25 array<string>, dense array<string>, hybrid array<string>, rerank_k int, ms map<string,double>"
    rows = [("ok", "x", "t", ["a"], list("ab"), list("ba"), list("ab"), 2, {"bm25": 1.0}), ("bad", "y", "u", ["b"], list("ab"), list("ab"), list("ba"), 1, {"bm25": -1.0}), ("short", "x", "t", ["b"], list("a"), list("ab"), list("ab"), 2, {"dense": 1.0})]
    cache = spark.createDataFrame(rows, s)
    found = lambda df: sorted((r.id, r.rule) for r in df.collect())
    assert found(checks.fusion_violations(cache)) == [("bad", "fusion differs")]
    assert found(checks.timing_violations(cache, "ms", ["bm25"])) == [("bad", "timing negative or not finite"), ("short", "timing missing")]
    assert found(checks.count_violations(cache, "src", {"x": 2, "z": 1})) == [("y", "number differs"), ("z", "number differs")]
    prepared = spark.createDataFrame([("ok", "x", ["a", "a"]), ("bad", "y", ["c"]), ("new", "x", [])], "query_id string, src string, relevant_ids array<string>")
    assert found(checks.alignment_violations(cache, prepared)) == [("bad", "differs from the prepared query"), ("new", "not in the cache"), ("short", "not prepared")]
    assert found(checks.cohort_violations(cache, 2, 2, "t")) == [("bad", "another split"), ("bad", "prefix of another depth"), ("short", "legs of another depth")]
