"""Exact nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed in double precision.

x = s q + e with |e| measured, so the distance of two quantised vectors is within |e1| + |e2| of the true one. In each tile,
a product of the int8 codes gives all distances; pairs whose lower bound passes the k-th upper bound so far are dropped and
the rest recomputed. Query blocks and candidate blocks of bounded size meet in a join on their numbers, and heaps merge what
the tiles leave; where all queries are one block, it is broadcast and the candidates stay in place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.plans.lineage import cut

K, EVERY = 10, 100
#: Rows of a tile's queries and candidates; bytes of a block of query vectors; rows of a block of candidates.
QUERY_TILE, CANDIDATE_TILE, QUERY_BYTES, CANDIDATES = 256, 4096, 16 << 20, 1 << 18
FOUND = "query_id long, rank int, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, bound of the norm of the error) by row; the bound allows for the rounding of x - s q."""
    s = np.abs(x).max(1) / 127.0
    q = np.rint(x / np.where(s > 0, s, 1)[:, None]).astype(np.int8)
    with np.errstate(over="ignore"):
        return q, s, np.linalg.norm(x - s[:, None] * q, axis=1) * (1 + 1e-9) + np.linalg.norm(x, axis=1) * 2.0**-50


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by row; components are added in order. Where squares pass the range of doubles, differences are scaled by
    the largest; a distance that passes it itself is infinite."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for i in range(a.shape[1]):
            d = a[:, i] - b[:, i]
            total += d * d
        out, over = np.sqrt(total), np.isinf(total)
        if over.any():
            half = np.abs(a[over] / 2 - b[over] / 2)
            most = half.max(1)
            out[over] = np.sqrt(((half / most[:, None]) ** 2).sum(1)) * most * 2
    return out


@dataclass
class Tile:
    """A block of candidates with its codes, scales and error norms."""

    ids: np.ndarray
    x: np.ndarray
    q: np.ndarray
    s: np.ndarray
    e: np.ndarray


class Heaps:
    """The k nearest so far of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.s, self.e = quantise(x)
        self.d, self.at = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def tile(self, t: Tile) -> None:
        ids, x, q, s, e = t.ids, t.x, t.q, t.s, t.e
        # Sums of products of int8 codes are whole numbers that float32 holds up to 1,040 components, float64 beyond.
        kind = np.float32 if x.shape[1] <= 1040 else np.float64
        dot = (self.q.astype(kind) @ q.astype(kind).T).astype(np.float64)
        sq = lambda c, f: (c.astype(np.float64) ** 2).sum(1) * f * f
        with np.errstate(over="ignore", invalid="ignore"):
            mine, theirs = sq(self.q, self.s)[:, None], sq(q, s)
            near = mine + theirs - 2 * (self.s[:, None] * s) * dot
            # The sum of squares cancels: its rounding is bounded by their size, not by what is left of it.
            lost, slack = (mine + theirs) * 2.0**-47, self.e[:, None] + e
            low, high = np.sqrt(np.maximum(near - lost, 0)) - slack, np.sqrt(np.maximum(near, 0) + lost) + slack
        # Squares out of range bound nothing: such pairs are recomputed.
        fine = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(fine, low, -np.inf), np.where(fine, high, np.inf)
        high = np.where(ids == self.ids[:, None], np.inf, high)
        kth = np.minimum(np.partition(high, self.k - 1, axis=1)[:, self.k - 1] if len(ids) >= self.k else np.inf, self.d[:, -1])
        qi, ci = np.nonzero((low * (1 - 1e-12) <= kth[:, None] * (1 + 1e-12)) & (ids != self.ids[:, None]))
        for at in range(0, len(qi), 1 << 16):
            i, j = qi[at : at + (1 << 16)], ci[at : at + (1 << 16)]
            self.merge(i, ids[j], exact(self.x[i], x[j]))

    def merge(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        rows = np.unique(i)
        i = np.r_[np.repeat(rows, self.k), i]
        ids, d = np.r_[self.at[rows].ravel(), ids], np.r_[self.d[rows].ravel(), d]
        order = np.lexsort((ids, d, i))
        i, ids, d = i[order], ids[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        first = nth < self.k
        self.d[i[first], nth[first]], self.at[i[first], nth[first]] = d[first], ids[first]


def usable(rows: DataFrame, is_query: Column, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, v array of float or double, asks) of the vectors that take part, their length (0 if there are none) and number.

    They have an id and components that are not null, finite and not all zero, and are of the commonest length.
    """
    kind = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where("id IS NOT NULL AND v IS NOT NULL").where(fine)
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (size.n if size else 0)), size.n if size else 0, size["count"] if size else 0


def matrix(ids: pa.Array, vecs: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(), vecs.flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, d)


class Search:
    """The heaps of a block of queries, which takes candidates and gives what is nearest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.heaps = [Heaps(ids[at : at + QUERY_TILE], x[at : at + QUERY_TILE], k) for at in range(0, len(ids), QUERY_TILE)]

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), CANDIDATE_TILE):
            part = ids[at : at + CANDIDATE_TILE], x[at : at + CANDIDATE_TILE]
            tile = Tile(*part, *quantise(part[1]))
            for h in self.heaps:
                h.tile(tile)

    def give(self):
        for h in self.heaps:
            i, j = np.nonzero(np.isfinite(h.d) | (h.at < np.iinfo(np.int64).max))
            yield pa.RecordBatch.from_arrays([pa.array(h.ids[i]), pa.array(h.at[i, j]), pa.array(h.d[i, j])], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows (all, if fewer) of each row for which is_query holds.

    Vectors null, zero, of another length than the commonest, or with null or non-finite components take no part, nor do rows
    with a null id. Rows of one id are one another's own: none is a candidate for the other, and several query rows of one id
    are answered as one, the smallest. Ties go to the smaller id. No queries or no candidates: an empty result.

    Blocks of about query_bytes of queries meet blocks of about `candidates` rows; no task holds more than one of each.
    """
    spark = rows.sparkSession
    cands, d, n = usable(rows, is_query, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], FOUND)
    asked = cut(cands.where("asks").groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() * d * 8 // query_bytes)
    if not blocks:
        return spark.createDataFrame([], FOUND)
    found = one_block(cands, asked, d, k) if blocks == 1 else block_join(cands, asked, d, k, blocks, -(-n // candidates))
    # k rows a query are left of each block; the limit on the rank is applied before and after they are shuffled.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def one_block(cands: DataFrame, asked: DataFrame, d: int, k: int) -> DataFrame:
    """Queries of one block, QUERY_BYTES at most, are broadcast."""
    got = asked.select("id", "v").orderBy("id").toArrow().combine_chunks()
    sent = cands.sparkSession.sparkContext.broadcast(matrix(got.column("id").combine_chunks(), got.column("v").combine_chunks(), d))

    def run(batches):
        s = Search(*sent.value, k)
        for b in batches:
            s.take(*matrix(b.column(0), b.column(1), d))
        yield from s.give()

    return cands.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def block_join(cands: DataFrame, asked: DataFrame, d: int, k: int, blocks: int, parts: int) -> DataFrame:
    """Each block of queries meets each block of candidates, as the rows of one key: the queries first, then the candidates."""
    deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.select(deal("q", blocks).alias("i"), every(parts).alias("j"), F.lit(0).alias("side"), "id", "v")
    right = cands.select(every(blocks).alias("i"), deal("c", parts).alias("j"), F.lit(1).alias("side"), "id", "v")

    def run(batches):
        at, held, search = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * (2 * parts) + b.column(1).to_numpy() * 2 + b.column(2).to_numpy()
            ids, x = matrix(b.column(3), b.column(4), d)
            ends = np.r_[np.nonzero(key[1:] != key[:-1])[0] + 1, len(key)] if len(key) else []
            start = 0
            for end in ends:
                now, side = divmod(int(key[start]), 2)
                if now != at:
                    if search is not None:
                        yield from search.give()
                    at, held, search = now, [], None
                if side == 0:
                    held.append((ids[start:end].copy(), x[start:end].copy()))
                elif held:
                    search = Search(*(np.concatenate(c) for c in zip(*held)), k) if search is None else search
                    search.take(ids[start:end], x[start:end])
                start = end
        if search is not None:
            yield from search.give()

    keys = ["i", "j"]
    met = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side")
    return met.select(*keys, "side", "id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op9_sql() -> str:
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b)) AS score
      FROM e AS q JOIN e ON q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= {K}"""
