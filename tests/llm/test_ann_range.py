import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


@pytest.mark.parametrize("query_bytes", [1 << 20, 64])
@pytest.mark.parametrize("size", [1e200, 1.0, 1e307])
def test_large_components_against_plain_distances(spark, size, query_bytes):
    """Squares that pass the range of doubles drop no candidate."""
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 5)) * size
    x[::7] /= 1e6
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in ann.nearest(rows, F.col("vec_id") % 20 == 0, 4, query_bytes=query_bytes, candidates=25).collect()}
    assert len(got) == 12
    for q in (0, 20, 40):
        far = sorted((math.dist(x[q] / size, x[i] / size), i) for i in range(60) if i != q)
        for n, (d, i) in enumerate(far[:4], 1):
            assert got[q, n][0] == i and got[q, n][1] == pytest.approx(d * size, rel=1e-12)


def test_distances_out_of_range_are_infinite_and_kept(spark):
    rows = spark.createDataFrame([(0, [1.7e308, 0.0]), (1, [-1.7e308, 0.0]), (2, [1.7e308, 1.0])], "vec_id long, embedding array<double>")
    got = [(g.rank, g.vec_id, g.score) for g in ann.nearest(rows, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 1, math.inf)]
