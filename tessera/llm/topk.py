"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. A row of the index holds a block of vectors: of each attribute (component), the smallest
value and the bits of what is above it, as bitmaps over the block's rows, from the least significant slice on. Weighting an
attribute by an integer adds its slices, shifted, once for each bit of the weight; a negative weight takes the complements.
All slices of one significance are added by full adders on whole bitmaps, three to a sum and a carry, so that the bits of every
row's score appear as bitmaps. The best rows are selected from the most significant slice downward: rows with the bit go before
rows without it. Where the k-th place falls among rows of equal score, these are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.plans.lineage import cut, stored

K, EVERY, SCALE = 10, 100, 1024
#: Vectors of a block of the index; bytes of a block of queries, which is broadcast.
BLOCK, QUERY_BYTES = 1 << 15, 64 << 20
INDEX = "n int, bits int, ids binary, base binary, slices binary"
FOUND = "query_id long, rank int, vec_id long, score long"
#: Quantised components are below 2^62 in magnitude.
LARGEST = 2.0**62


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    v = np.floor(x * float(scale))
    if len(v) and not (np.abs(v) < LARGEST).all():
        raise ValueError("a component times the scale passes 62 bits")
    return v.astype(np.int64)


def sliced(ids: np.ndarray, v: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """A row of the index: rows by id; slices[attribute, bit] are bitmaps of 64 rows a word, least significant first."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    base = v.min(0)
    above = (v - base).view(np.uint64)
    bits = int(above.max()).bit_length()
    words = -(-len(ids) // 64)
    maps = np.zeros((v.shape[1], bits, words * 8), np.uint8)
    for j in range(bits):
        maps[:, j, : -(-len(ids) // 8)] = np.packbits(((above >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T
    return len(ids), bits, ids.tobytes(), base.tobytes(), maps.tobytes()


def added(pending: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The bitmaps of the sum, least significant first. pending: arrays of bitmaps by significance."""
    out, at = [], 0
    while pending:
        rows = pending.pop(at, [])
        x = np.concatenate(rows) if rows else None
        while x is not None and len(x) > 1:
            third = len(x) // 3
            if third:
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                x = np.concatenate([half ^ c, x[3 * third :]])
            else:
                carry, x = x[:1] & x[1:], x[:1] ^ x[1:]
            pending.setdefault(at + 1, []).append(carry)
        out.append(x[0] if x is not None else None)
        at += 1
    return out


class Block:
    """A row of the index, opened."""

    def __init__(self, n: int, bits: int, ids: bytes, base: bytes, slices: bytes):
        self.n, self.bits = n, bits
        self.ids, self.base = np.frombuffer(ids, np.int64), np.frombuffer(base, np.int64)
        self.words = -(-n // 64)
        self.maps = np.frombuffer(slices, np.uint64).reshape(len(self.base) * bits, self.words)
        self.live = np.frombuffer(np.packbits(np.arange(self.words * 64) < n, bitorder="little").tobytes(), np.uint64)

    def score_slices(self, q: np.ndarray) -> tuple[list, int]:
        """The bitmaps of every row's inner product with q less a constant, and the constant."""
        pending: dict[int, list[np.ndarray]] = {}
        for sign in (1, -1):
            dims = np.nonzero(q * sign > 0)[0]
            if not len(dims) or not self.bits:
                continue
            weight = np.abs(q[dims])
            of_weight = [dims[(weight >> t) & 1 > 0] for t in range(int(weight.max()).bit_length())]
            for s in range(len(of_weight) + self.bits - 1):
                rows = np.concatenate([of_weight[t] * self.bits + (s - t) for t in range(max(0, s - self.bits + 1), min(s + 1, len(of_weight)))])
                if len(rows):
                    got = self.maps[rows]
                    pending.setdefault(s, []).append(got if sign > 0 else np.invert(got, out=got))
        fixed = sum(int(a) * int(b) for a, b in zip(q, self.base)) - sum(-int(a) for a in q[q < 0]) * ((1 << self.bits) - 1)
        return added(pending), fixed

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """(ids, scores) of the k best rows, but for those whose id is own."""
        slices, fixed = self.score_slices(q)
        level = self.live
        a, b = np.searchsorted(self.ids, [own, own + 1])
        if b > a:
            level = level.copy()
            for i in range(a, b):
                level[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, n_sure = np.zeros_like(level), 0
        for s in reversed(slices):
            if s is None:
                continue
            ones = level & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n >= k:
                level = ones
            else:
                sure, n_sure, level = sure | ones, n_sure + n, level & ~s
        rows = [*places(sure), *places(level)[: k - n_sure]]  # rows of one score stand by id
        scores = [fixed + sum(1 << j for j, s in enumerate(slices) if s is not None and int(s[i >> 6]) >> (int(i) & 63) & 1) for i in rows]
        return [int(self.ids[i]) for i in rows], scores


def places(bitmap: np.ndarray) -> np.ndarray:
    at = np.nonzero(bitmap)[0]
    bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    i, j = np.nonzero(bits)
    return at[i] * 64 + j


def usable(rows: DataFrame, is_query: Column, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v, asks) of the vectors that take part, and their length (0 if there are none)."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    v = v.where("id IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (size.n if size else 0)), size.n if size else 0


def matrix(ids: pa.Array, vecs: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(), vecs.flatten().to_numpy().reshape(-1, d)


def sliced_index(vectors: DataFrame, d: int, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """vectors: (id, v) -> rows of INDEX, of at most `block` vectors each, made where the vectors lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if n >= least:
                ids, v = (np.concatenate(c) for c in zip(*held))
                while len(ids) >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) if isinstance(x, bytes) else pa.array([x], pa.int32()) for x in sliced(ids[:block], v[:block])], names=["n", "bits", "ids", "base", "slices"])
                    ids, v = ids[block:], v[block:]
                held, n = [(ids, v)] if len(ids) else [], len(ids)

        for b in batches:
            ids, x = matrix(b.column(0), b.column(1), d)
            held.append((ids.copy(), whole(x, scale)))
            n += len(ids)
            yield from full(block)
        yield from full(1)

    return vectors.select("id", "v").mapInArrow(run, INDEX)


def search(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of the index for each row of q."""
    sent = index.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = sent.value
        for b in batches:
            for i in range(b.num_rows):
                block = Block(*(c[i].as_py() for c in b.columns))
                found = [(own, *block.top(w, own, k)) for own, w in zip(asked.tolist(), weights)]
                scores = [s for _, _, x in found for s in x]
                if any(abs(s) >= 1 << 63 for s in scores):
                    raise OverflowError("an inner product passes 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array([own for own, x, _ in found for _ in x], pa.int64()), pa.array([j for _, x, _ in found for j in x], pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def top_inner(rows: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows (all, if fewer) of highest inner product of floor(scale * x), in integers, for
    each row for which is_query holds.

    Vectors null, empty, of another length than the commonest, or with null or non-finite components take no part, nor do rows
    with a null id. Rows of one id are one another's own: none is a candidate for the other, and several query rows of one id
    are answered as one, the smallest. Ties go to the smaller id. No queries or no candidates: an empty result. Quantised
    components of 2^62 or more, and scores that a long can't hold, are errors.

    The index of all vectors is written once, to the shared checkpoint folder, where it stays as long as the result may be read. It
    is scanned in place for each block of about query_bytes of queries, which is broadcast; it is never shuffled or copied.
    """
    spark = rows.sparkSession
    vectors, d = usable(rows, is_query, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], FOUND)
    asked = cut(vectors.where("asks").groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() * d * 8 // query_bytes)
    if not blocks:
        return spark.createDataFrame([], FOUND)
    index, _ = stored(sliced_index(vectors, d, scale, block), "slices")
    found = []
    for i in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if got.num_rows:
            ids, x = matrix(got.column("id").combine_chunks(), got.column("v").combine_chunks(), d)
            found.append(search(index, ids, whole(x, scale), k))
    # k rows a query are left of each block; the limit on the rank is applied before and after they are shuffled.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, found).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op12_sql() -> str:
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM e AS q JOIN e ON q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= {K}"""
