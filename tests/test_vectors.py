import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import vectors


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def counting(spark, fails=None):
    """A model that counts the texts it gets, and fails on one of them."""
    seen = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            if fails in texts:
                raise RuntimeError("killed")
            seen.add(len(texts))
            return [[len(t) + 1.0, 1.0, float("a" in t)] for t in texts]

        return encode

    return seen, load


@pytest.fixture
def texts():
    return {f"d{i}": None if i == 7 else f"text {i} " + "a" * (i % 3) for i in range(200)}


def got(spark, texts, path):
    rows = vectors.read_store(frame(spark, texts), path, "m1").collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.id] or ""
        want = np.array([len(t) + 1.0, 1.0, float("a" in t)])
        assert np.allclose(r.v, want / np.linalg.norm(want), atol=1e-6)


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, texts):
    path, docs = f"file://{tmp_path}/store", frame(spark, texts)
    shards = {r.id: r.s for r in docs.select(F.col("doc_id").alias("id"), vectors.shard_of(F.col("doc_id"), 20).alias("s")).collect()}
    late = next(i for i, s in shards.items() if s % 4 == 2)  # in the third of four jobs
    seen, load = counting(spark, texts[late])
    with pytest.raises(Exception, match="killed"):
        vectors.encode_store(docs, path, "m1", load, rows=10, jobs=4)
    done = sum(s % 4 < 2 for s in shards.values())
    with pytest.raises(ValueError, match="encode them first"):
        vectors.read_store(docs, path, "m1")
    assert {r.rule for r in vectors.store_violations(docs, path, "m1").collect()} == {"not encoded"}
    seen, load = counting(spark)
    out = vectors.encode_store(docs, path, "m1", load, rows=999, jobs=4)
    assert seen.value == len(texts) - done and out == {"shards": 20, "encoded": len({s for s in shards.values() if s % 4 >= 2})}
    got(spark, texts, path)
    seen, load = counting(spark)
    assert vectors.encode_store(docs, path, "m1", load)["encoded"] == 0 and seen.value == 0
    assert vectors.store_violations(docs, path, "m1").count() == 0


def test_a_changed_text_encodes_one_shard(spark, tmp_path, texts):
    path = f"file://{tmp_path}/store"
    _, load = counting(spark)
    vectors.encode_store(frame(spark, texts), path, "m1", load, rows=10, jobs=3)
    for change in ({"d5": "another text"}, {"new": "a new one"}):
        now = texts | change
        key = next(iter(change))
        mine = frame(spark, now).where(vectors.shard_of(F.col("doc_id"), 20) == frame(spark, {key: ""}).select(vectors.shard_of(F.col("doc_id"), 20)).first()[0]).count()
        seen, load = counting(spark)
        assert vectors.encode_store(frame(spark, now), path, "m1", load)["encoded"] == 1 and seen.value == mine < 40
        got(spark, now, path)
    fewer = {k: v for k, v in texts.items() if k != "d9"}
    _, load = counting(spark)
    assert vectors.encode_store(frame(spark, fewer), path, "m1", load)["encoded"] == 1
    got(spark, fewer, path)
    seen, load = counting(spark)  # back to what was: nothing to encode
    assert vectors.encode_store(frame(spark, texts), path, "m1", load)["encoded"] == 0 and seen.value == 0
    got(spark, texts, path)


def test_identity_ids_and_lengths_are_checked(spark, tmp_path, texts):
    path = f"file://{tmp_path}/store"
    _, load = counting(spark)
    vectors.encode_store(frame(spark, texts), path, "m1", load, rows=50, jobs=1)
    with pytest.raises(ValueError, match="holds vectors of m1"):
        vectors.encode_store(frame(spark, texts), path, "m2", load)
    with pytest.raises(ValueError, match="no vectors of m2"):
        vectors.read_store(frame(spark, texts), path, "m2")
    twice = frame(spark, texts).unionByName(frame(spark, {"d3": "x"}))
    with pytest.raises(Exception, match="repeated ids"):
        vectors.encode_store(twice, path, "m1", load)
    with pytest.raises(Exception, match="without id"):
        vectors.encode_store(frame(spark, texts).unionByName(frame(spark, {None: "x"})), path, "m1", load)
    for bad in ([0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="not finite, or zero"):
            vectors.encode_store(frame(spark, {"x": "y"}), f"{path}-{bad[0]}", "m1", lambda b=bad: lambda ts: [b] * len(ts))
    # Vectors spoilt behind the store's back.
    part = next((tmp_path / "store/data").iterdir())
    was = spark.read.parquet(f"file://{part}").withColumn("v", F.when(F.col("id") == "d4", F.transform("v", lambda x: x * F.lit(1.001).cast("float"))).otherwise(F.col("v"))).where("id <> 'd6'")
    rows = was.collect()
    spark.createDataFrame(rows, was.schema).write.mode("overwrite").parquet(f"file://{part}")
    spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, vectors.store_violations(frame(spark, texts), path, "m1").collect())) == [("d4", "not of unit length"), ("d6", "no vector")]
    with pytest.raises(Exception, match="not of unit length: d4"):
        vectors.read_store(frame(spark, texts), path, "m1").collect()


def test_an_empty_corpus(spark, tmp_path):
    path, docs = f"file://{tmp_path}/store", frame(spark, {"x": ""}).where("false")
    assert vectors.encode_store(docs, path, "m1", lambda: None) == {"shards": 0, "encoded": 0}
    assert vectors.read_store(docs, path, "m1").count() == vectors.store_violations(docs, path, "m1").count() == 0
