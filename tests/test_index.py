import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.functions.text import plain_tokens, term_counts
from tessera.operators import bm25, vector
from tessera.operators.ranking import best_columns
from tessera.operators.vector import dense_search, hashed_embedding


def _plain(docs, queries):
    """BM25 of each pair with a common term, by loops."""
    tokens = {d: plain_tokens(t or "") for d, t in docs}
    df, avg = Counter(w for ts in tokens.values() for w in set(ts)), sum(map(len, tokens.values())) / len(docs)
    out = defaultdict(float)
    for q, text in queries:
        for w, n in Counter(plain_tokens(text)).items():
            for d, ts in tokens.items():
                if tf := ts.count(w):
                    out[q, d] += n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    docs = [(f"d{i:03}", " ".join(rnd.choice("Aa bb cc dd ee ff gg hh é_1 x-y".split()) for _ in range(rnd.randrange(30)))) for i in range(90)]
    return docs + [("none", None), ("d", "zz")], [(f"q{i}", " ".join(rnd.choice("aa bb cc x zz nowhere".split()) for _ in range(4))) for i in range(7)]


def test_documents_are_scored_where_they_lie(spark, corpus, monkeypatch):
    docs, queries = spark.createDataFrame(corpus[0], "doc_id string, text string"), spark.createDataFrame(corpus[1], "query_id string, query string")
    monkeypatch.setattr(bm25, "CELLS", 70)
    monkeypatch.setattr(bm25, "ROWS", 16)
    index, want = bm25.Index(docs), _plain(*corpus)
    found = index.scores(queries)
    assert not re.search("Exchange|Aggregate", found._jdf.queryExecution().executedPlan().toString())
    assert {(r.query_id, r.doc_id): r.score for r in found.collect()} == pytest.approx(want)
    best = {q: sorted(((-round(s, 9), d) for (p, d), s in want.items() if p == q))[:9] for q, _ in corpus[1]}
    got = defaultdict(list)
    for r in index.search(queries, 9, pad=False).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    assert {q: b for q, b in best.items() if b} == got
    monkeypatch.setattr(bm25, "QUERIES", 3)
    assert {(r.query_id, r.doc_id): r.score for r in index.scores(queries).collect()} == pytest.approx(want)


def test_texts_of_one_id_are_scored_together(spark):
    docs = spark.createDataFrame([("a", "x y"), ("a", "x y"), ("a", "x y z"), ("b", "x"), (None, "z")], "doc_id string, text string")
    index = bm25.Index(docs)
    rows = {(r.doc_id, r.dl, r.term): r.tf for r in index.postings.collect()}
    assert rows == {("a", 2, "x"): 2, ("a", 2, "y"): 2, ("a", 3, "x"): 1, ("a", 3, "y"): 1, ("a", 3, "z"): 1, ("b", 1, "x"): 1, (None, 1, "z"): 1}
    assert not index.one_each and index.stats.first().asDict() == {"n": 5, "avgdl": pytest.approx(9 / 5)}
    found = index.scores(spark.createDataFrame([("q", "x z")], "query_id string, query string")).collect()
    assert sorted(str(r.doc_id) for r in found) == ["None", "a", "b"]


def test_terms_are_counted_as_they_are_cut():
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("aAzZ_09 -\n\x00éKß\U0001f600") for _ in range(40))
        assert {w.decode(): n for w, n in term_counts([t, t]).items()} == {w: 2 * n for w, n in Counter(plain_tokens(t)).items()}


def test_best_columns_break_ties_by_place():
    s = np.array([[1.0, 2, 2, -np.inf, 2], [-np.inf] * 5, [0, 0, 0, 0, 0]])
    for k, want in [(2, [(0, 1), (0, 2), (2, 0), (2, 1)]), (9, [(0, 1), (0, 2), (0, 4), (0, 0), *[(2, i) for i in range(5)]]), (0, [])]:
        assert list(zip(*map(list, best_columns(s, k)))) == want


def test_vectors_of_ids_and_searches_without_oneself(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "y y"), ("b", "x y y"), ("c", "x"), ("d", ""), ("e", None)], "doc_id string, text string")
    v = {r.doc_id: r.v for r in hashed_embedding(docs, "doc_id", "text").collect()}
    assert v["a"] == v["b"] and sorted(v) == ["a", "b", "c"] and len(v["c"]) == 64
    e = spark.createDataFrame(list(v.items()), "doc_id string, v array<double>")
    got = dense_search(e.withColumnRenamed("doc_id", "query_id"), e, 2, own=False).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]


def test_an_index_of_asked_terms_gives_the_same(spark, corpus):
    docs, queries = spark.createDataFrame(corpus[0], "doc_id string, text string"), spark.createDataFrame(corpus[1], "query_id string, query string")
    index = bm25.Index(docs)
    only, terms = index.only(queries), {w for _, t in corpus[1] for w in plain_tokens(t)}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(only.postings) == [r for r in rows(index.postings) if r[2] in terms]
    assert rows(only.search(queries, 95)) == rows(index.search(queries, 95)) and rows(only.stats) == rows(index.stats)
    assert rows(only.idf()) == [r for r in rows(index.idf()) if r[0] in terms]


def test_one_cut_of_the_texts_gives_asked_terms_and_vectors(spark, corpus, monkeypatch):
    twice = [("d001", "gg hh"), ("d002", None), ("two", "aa zz"), ("two", "é"), ("-", "--")]
    docs, queries = spark.createDataFrame(corpus[0] + twice, "doc_id string, text string"), spark.createDataFrame(corpus[1], "query_id string, query string")
    index = bm25.Index(docs)
    want = index.only(queries)
    got = bm25.Index(docs, queries, 64)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for of in ("postings", "term_stats", "stats", "one_each"):
        a, b = getattr(got, of), getattr(want, of)
        assert a == b if of == "one_each" else rows(a) == rows(b)
    assert rows(got.search(queries, 95)) == rows(want.search(queries, 95))
    assert rows(got.vectors) == rows(hashed_embedding(docs, "doc_id", "text"))
    monkeypatch.setattr(bm25, "fits", lambda *_: False)
    assert rows(bm25.Index(docs, queries).postings) == rows(index.postings)


def test_an_evaluation_cuts_texts_once_for_both_legs(spark, tmp_path, monkeypatch):
    from tessera.plans import evaluation

    spark.createDataFrame([(i, f"aa b{i} cc", "en") for i in range(30)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"aa b{i}") for i in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cuts, real = [], bm25.texts_by_id
    for module in (bm25, vector):
        monkeypatch.setattr(module, "texts_by_id", lambda docs: cuts.append(1) or real(docs))
    e = evaluation.evaluation(spark, str(tmp_path))
    assert e.hybrid.count() == 90 and len(cuts) == 2  # documents and queries
