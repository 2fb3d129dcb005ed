import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import checks, router
from tessera.sources import files, npy
from tessera.streaming.latency import drain, latency_windows, read_events


def test_corpus_rejects_bad_lines_and_ids(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": 10, "name": "é"}\n\n  {"id": "b"}  \n')
    assert {r.doc_id: json.loads(r.body).get("name") for r in files.load_corpus(spark, str(p)).collect()} == {"10": "é", "b": None}
    for body, why in (('{"id": 1}\n{"id": "1"}\n', "repeated id: 1"), ('{"x": 1}\n', "without id"), ('{"id": 1}\n\n{"id": \n', "line 3")):
        p.write_text(body)
        with pytest.raises(ValueError, match=why):
            files.load_corpus(spark, str(p))
    p.write_text("")
    assert files.load_corpus(spark, str(p)).count() == 0


def test_queries_prefer_given_ids_over_labels(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    rows = [{"id": 1, "query": "x", "labels": [{"id": "a", "relevance": 1}, {"id": "b", "relevance": 0}, {"id": 3, "relevance": "2.5"}, {"id": "a", "relevance": 1}, {"relevance": 1}]},
            {"id": "2", "query": "y", "relevant_ids": ["z", "k", "z"], "labels": [{"id": "a", "relevance": 1}]}, {"id": "3", "query": "w"}, {"id": "4", "query": "v", "relevant_ids": []}, {"id": "5", "query": "u", "labels": '[{"id": "g", "relevance": 1}, {"id": "h", "relevance": 0}]'}]
    p.write_text("\n".join(map(json.dumps, rows)))
    assert {r.query_id: list(r.relevant_ids) for r in files.load_queries(spark, str(p)).collect()} == {"1": ["3", "a"], "2": ["k", "z"], "3": [], "4": [], "5": ["g"]}
    p.write_text('{"id": 1}')
    with pytest.raises(ValueError):
        files.load_queries(spark, str(p))


def test_npy_shards(spark, tmp_path):
    x = np.eye(4, dtype=np.float32)[[0, 1, 2, 3, 0]]
    np.save(tmp_path / "s0.npy", x[:3])
    np.save(tmp_path / "s1.npy", x[3:])
    got = files.read_npy(spark, str(tmp_path), 4).orderBy("file", "row").collect()
    assert [list(r.v) for r in got] == x.tolist() and [r.row for r in got] == [0, 1, 2, 0, 1]
    np.save(tmp_path / "s2.npy", 2 * x)
    with pytest.raises(Exception, match="unit length"):
        files.read_npy(spark, str(tmp_path), 4).count()
    assert files.read_npy(spark, str(tmp_path), 4, unit=None).count() == 10
    with pytest.raises(Exception, match="columns expected"):
        files.read_npy(spark, str(tmp_path), 5).count()


def test_npy_ranges_types_and_pruning(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(1000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for name, part, kind in (("a", x[:600], "<f4"), ("b", x[600:900], ">f8"), ("c", x[900:], "<f8"), ("none", x[:0], "<f4")):
        np.save(tmp_path / f"{name}.npy", part.astype(kind))
    df = files.read_npy(spark, str(tmp_path), 8, rows=128)
    assert df.rdd.getNumPartitions() == 5 + 3 + 1
    got = df.orderBy("file", "row").collect()
    assert np.allclose([q.v for q in got], x, atol=1e-7) and [q.row for q in got] == [*range(600), *range(300), *range(100)]
    np.save(tmp_path / "broken.npy", np.ones((3, 5), np.float32))  # a filter keeps it from being opened
    with pytest.raises(Exception, match="columns expected"):
        files.read_npy(spark, str(tmp_path), 8).count()
    name = str(tmp_path / "b.npy")
    for only, n in ((F.col("file") == name, 300), (F.col("file").isin(name, str(tmp_path / "c.npy")), 400), ((F.col("file") == name) & (F.col("row") >= 290), 10), (F.col("file") == "nowhere", 0)):
        assert files.read_npy(spark, str(tmp_path), 8).where(only).count() == n
    uri = files.read_npy(spark, f"file://{tmp_path}/c.npy", 8)
    assert {q.file for q in uri.select("file").distinct().collect()} == {f"file://{tmp_path}/c.npy"} and uri.count() == 100
    with pytest.raises(Exception, match="No such|NotFound|nothing-here"):
        files.read_npy(spark, str(tmp_path / "nothing-here"), 8).count()


def test_npy_shards_over_two_gigabytes(tmp_path):
    """By the reader alone: a sparse file of 3 GB, of which only the last range is read."""
    at, n, dim = tmp_path / "large.npy", 12_000_000, 64
    with open(at, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n, dim)})
        first = f.tell()
        last = np.zeros((3, dim), np.float32)
        last[:, 5] = 1
        f.seek(first + (n - 3) * dim * 4)
        f.write(last.tobytes())
    assert at.stat().st_size > 1 << 31
    reader = npy.NpyReader({"path": str(at), "dim": "64"})
    parts = reader.partitions()
    assert len(parts) == -(-n // npy.TASK_ROWS) and parts[-1].stop == n and sum(p.stop - p.start for p in parts) == n
    tail = list(reader.read(npy.Rows(str(at), n - 3, n, first, "<f4")))
    assert [b.num_rows for b in tail] == [3] and tail[0].column(1).to_pylist() == [n - 3, n - 2, n - 1]
    with pytest.raises(ValueError, match="unit length"):
        next(reader.read(parts[0]))
    with open(at, "r+b") as f:
        f.truncate(1 << 20)
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions()


def test_sinks_do_not_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], None), ("a", [], 1)], "z string, ids array<string>, n int")
    out = str(tmp_path / "o")
    files.refuse_full(spark, out)
    files.write_json_lines(df, out, "z")
    assert spark.read.text(out).collect()[0].value == '{"ids":[],"n":1,"z":"a"}'
    with pytest.raises(Exception):
        files.write_json_lines(df, out)
    with pytest.raises(FileExistsError):
        files.refuse_full(spark, out)
    files.write_csv(df, str(tmp_path / "c"))
    assert {r.ids for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"x,y", None}


def test_reports_and_manifests(spark, tmp_path):
    p = str(tmp_path / "r.md")
    got = files.write_report(p, files.markdown(spark.createDataFrame([("a|b", 0.5)], "k string, v double"), "T"))
    assert files.file_digest(p) == got and open(p).read() == "# T\n\n| k | v |\n| --- | --- |\n| a\\|b | 0.500000 |\n"
    with pytest.raises(FileExistsError):
        files.write_report(p, "other")
    with pytest.raises(ValueError):
        files.write_report(str(tmp_path / "n"), "x", "0" * 64)
    made = files.manifest({"r": p})
    assert files.changed(made, {"r": p}) == [] and files.changed(made, {}) == ["r"] and files.changed({}, {"r": p}) == ["r"]
    open(p, "a").write("!")
    assert files.changed(made, {"r": p}) == ["r"]
    assert files.canonical({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    with pytest.raises(ValueError):
        files.digest(float("nan"))


def test_cache_rules(spark):
    s = "query_id string, relevant_ids array<string>, bm25 array<string>, dense array<string>, hybrid array<string>, reranked array<string>, rerank_k int"
    abc, corpus = list("abc"), spark.createDataFrame([(c,) for c in "abc"], "doc_id string")
    rows = [("ok", ["a"], abc, abc, abc, list("bac"), 2), ("gold", [], abc, abc, abc, abc, 2), ("twice", ["a"], list("aab"), abc, abc, abc, 2), ("far", ["a"], abc, abc, abc, list("cba"), 2),
            ("deep", ["a"], abc, abc, abc, abc, 4), ("strange", ["x"], abc, abc, abc, abc, 1), ("same", ["a"], abc, abc, abc, abc, 1), ("same", ["a"], abc, abc, abc, abc, 1)]
    got = checks.cache_violations(spark.createDataFrame(rows, s), corpus)
    assert sorted((r.id, r.rule) for r in got.collect()) == [("deep", "depth out of range"), ("far", "prefix is no permutation"), ("far", "tail differs"), ("gold", "no gold"), ("same", "repeated query"), ("strange", "unknown document"), ("twice", "repeated in bm25")]
    with pytest.raises(ValueError, match="deep"):
        checks.require_none(got)
    checks.require_none(got.where("false"))


def test_prediction_rank_and_split_rules(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    p = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("x", 0.0)], "query_id string, p double")
    assert sorted((r.id, r.rule) for r in checks.prediction_violations(q, p).collect()) == [("b", "not finite"), ("c", "no prediction"), ("x", "no such query")]
    r = spark.createDataFrame([("a", 2, 0.5), ("b", None, 0.0), ("c", 3, 0.3), ("d", 0, 0.0)], "query_id string, s_rank int, s_rr double")
    assert sorted((x.id, x.rule) for x in checks.rank_violations(r, "s").collect()) == [("c", "reciprocal differs"), ("d", "rank below 1")]
    s = spark.createDataFrame([("u", "1"), ("v", "1"), ("v", "2"), ("u", None), ("v", None)], "split string, k string")
    assert [(x.id, x.rule) for x in checks.shared_between_splits(s, "split", ["k"]).collect()] == [("1", "k in several splits")]


def test_pair_tokens_cut_the_longest_side_first(spark):
    sizes = [(5, 7), (0, 20), (20, 0), (3, 3), (9, 2), (2, 9), (6, 6), (7, 4)]
    qs = spark.createDataFrame([(str(i), " ".join("w" * a)) for i, (a, _) in enumerate(sizes)], "query_id string, query string")
    ds = spark.createDataFrame([(str(i), " ".join("w" * b)) for i, (_, b) in enumerate(sizes)], "doc_id string, text string")
    pairs = spark.createDataFrame([(str(i), str(i)) for i in range(len(sizes))], "query_id string, doc_id string")

    def brute(a, b, room):
        while a + b > room:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        return a, b

    got = {int(r.query_id): (r.kept_query, r.kept_doc) for r in checks.pair_tokens(qs, ds, pairs, 9, 3, tokenize).collect()}
    assert got == {i: brute(a, b, 6) for i, (a, b) in enumerate(sizes)}


def test_ridge_against_least_squares(spark):
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(30, 7)), rnd.uniform(-1, 1, 30)
    x[:, 3] = 2.0
    m = router.fit(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], [*router.FEATURES, "y"]), "y", 10.0)
    sd = x.std(0)
    sd[sd <= 1e-12] = 1
    z = (x - x.mean(0)) / sd
    w = np.linalg.lstsq(np.r_[z, np.sqrt(10) * np.eye(7)], np.r_[y - y.mean(), np.zeros(7)], rcond=None)[0]
    assert np.allclose(m.coefficients, w) and np.isclose(m.intercept, y.mean()) and m.coefficients[3] == 0


def test_stream_equals_the_batch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 5000).alias("ts"), F.concat(F.lit("p"), F.col("id") % 3).alias("event_type"), (F.col("id") * 1.0).alias("value"))
    folder = str(tmp_path / "ev")
    rows.repartition(5).write.parquet(folder)
    got = drain(latency_windows(read_events(spark, folder, "*.parquet", 2), late=None), spark)
    want = latency_windows(rows, late=None)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want) and got.count() == 36
