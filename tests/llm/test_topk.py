import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def test_added_bitmaps_against_whole_numbers():
    r = np.random.default_rng(1)
    for bits, d in ((1, 3), (7, 20), (12, 9)):
        v = r.integers(-(1 << bits), 1 << bits, (200, d))
        b = topk.Block(*topk.sliced(np.arange(200), v))
        for q in (r.integers(-300, 300, d), np.zeros(d, np.int64), np.full(d, -1), np.full(d, 5)):
            slices, fixed = b.score_slices(q)
            got = [fixed + sum(1 << j for j, s in enumerate(slices) if s is not None and int(s[i >> 6]) >> (i & 63) & 1) for i in range(200)]
            assert got == (v @ q).tolist()


def plain(rows, asks, k, scale=1024):
    fine = {}
    for i, v in rows:
        if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append(v)
    whole = lambda v: [math.floor(scale * x) for x in v]
    out = []
    for q in fine:
        if asks(q):
            w = whole(min(fine[q]))
            scored = sorted((-sum(a * b for a, b in zip(w, whole(v))), i) for i in fine if i != q for v in fine[i])
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query_bytes", [(64, 64), (100, 1 << 20), (1 << 15, 200)])
def test_search_against_plain_loops(spark, block, query_bytes):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.5, 0.25, r.random()]) for _ in range(4)]) for i in range(-20, 300)]
    rows += [(i, [0.5, 0.5, -0.5, 0.0]) for i in range(400, 600)] + [(700, [0.0] * 4), (800, [1e6, -1e6, 3.0, 1e-9])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [None, 1.0, 1.0, 1.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (0, [0.125] * 4), (5, [9.0] * 4), (5, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).withColumn("rank", F.lit(1)).withColumn("id", F.lit("x")).withColumn("v", F.lit(0))
    got = topk.top_inner(df.repartition(3), F.col("vec_id") % 20 == 0, k=7, block=block, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 20 == 0, 7)


def test_few_candidates_empty_tables_and_large_numbers(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 100 == 0
    assert topk.top_inner(make([]), asks).collect() == [] and topk.top_inner(make([(1, [1.0])]), asks).collect() == []
    assert topk.top_inner(make([(100, [1.0])]), asks).collect() == []
    assert sorted(map(tuple, topk.top_inner(make([(100, [1.0]), (3, [-2.0]), (2, [-2.0])]), asks).collect())) == [(100, 1, 2, -2048 * 1024), (100, 2, 3, -2048 * 1024)]
    with pytest.raises(Exception, match="62 bits"):
        topk.top_inner(make([(100, [1e30]), (3, [-2.0])]), asks).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.top_inner(make([(100, [1e10]), (3, [1e10])]), asks).collect()


def test_query_against_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = duckdb.sql(topk.op12_sql()).fetchall()
    assert sorted(map(tuple, topk.op12_topk(spark, d).collect())) == sorted(want) and len(want) == 50
