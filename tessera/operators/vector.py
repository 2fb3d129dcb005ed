"""Hashed embeddings and exact dense search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tessera.functions.hashing import DIM, Sums, unit_lists
from tessera.functions.text import term_counts
from tessera.operators.bm25 import CELLS, texts_by_id
from tessera.operators.ranking import DIGITS, best_columns, top_k

#: Queries that one pass over the corpus scores; more queries take more passes.
QUERIES = 4096


def _components(docs: DataFrame, id_col: str, text_col: str, dim: int, columns: str, give: Callable[[Sums], list[pa.Array]]) -> DataFrame:
    """Rows of (id, *columns): what give makes of the components of some ids, the first of its columns being the places of those ids."""

    more = StructType.fromDDL(columns)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                sums = Sums(dim)
                for texts in b.column(1).slice(i, 1024).to_pylist():
                    sums.add(term_counts(texts))
                at, *cols = give(sums)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1024).take(at), *cols], names=[id_col, *more.names])

    each = texts_by_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return each.mapInArrow(run, StructType([docs.schema[id_col], *more]))


def hashed_components(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, i, x): signed token counts by hashed component, summed where the text lies, without a shuffle of sums."""

    def give(sums):
        x, some = sums.rows()
        at, i = np.nonzero(some)
        return [pa.array(at), pa.array(i, pa.int32()), pa.array(x[at, i])]

    return _components(docs, id_col, text_col, dim, "i int, x double", give)


def hashed_embedding(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, v array<double>): the components as vectors of length 1; texts without tokens, or whose counts cancel, have none."""

    def give(sums):
        at, v = unit_lists(sums.rows()[0])
        return [pa.array(at), v]

    return _components(docs, id_col, text_col, dim, "v array<double>", give)


def hashing_model(dim: int = DIM) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """`hashed_embedding` as a model for workers; texts without a vector get the first unit vector."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            sums = Sums(dim)
            for t in texts:
                sums.add(term_counts([t]))
            x = sums.rows()[0]
            x[~x.any(1), 0] = 1.0
            return x

        return encode

    return load


def encode(docs: DataFrame, id_col: str, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, v array<double>): unit vectors of a model over Arrow batches; load is called once in each task's worker.

    Raises where the model's vectors are not finite or all zero. Store the result to encode a corpus once.
    """

    def run(batches):
        model = load()
        for b in batches:
            x = np.asarray(model(["" if t is None else t for t in b.column(1).to_pylist()]), float).reshape(b.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            if not np.isfinite(x).all() or (norm == 0).any():
                raise ValueError("a vector is not finite, or zero")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((x / norm).tolist(), pa.list_(pa.float64()))], names=[id_col, "v"])

    schema = docs.select(id_col).schema.add("v", ArrayType(DoubleType()))
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def dense_search(queries: DataFrame, docs: DataFrame, k: int, own: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest dot products, ties to the smaller id.

    queries: (query_id string, v); docs: (doc_id string, v). Blocks of documents meet blocks of queries in a matrix product, and
    only a block's k best leave it. own=False leaves out documents whose id is the query's.
    """
    rows = queries.select("query_id", "v").toLocalIterator()
    parts, block = [], []

    def run(ids, mat):
        known = ids.unique()
        place = pc.index_in(ids, value_set=known).to_numpy(zero_copy_only=False)

        def search(batches):
            step = max(CELLS // len(ids), 1)
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    b = batch.slice(i, step)
                    b = b.take(pc.array_sort_indices(b.column(0), null_placement="at_start"))
                    doc = b.column(0)
                    s = np.round(mat @ b.column(1).flatten().to_numpy().reshape(len(doc), -1).T, DIGITS)
                    if not own:
                        s[place[:, None] == pc.index_in(doc, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)] = -np.inf
                    q, d = best_columns(s, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), doc.take(pa.array(d)), pa.array(s[q, d])], names=["query_id", "doc_id", "score"])

        return docs.select("doc_id", "v").mapInArrow(search, "query_id string, doc_id string, score double")

    def flush():
        if block:
            parts.append(run(pa.array([r.query_id for r in block], pa.string()), np.array([r.v for r in block], float)))
            block.clear()

    for r in rows:
        block.append(r)
        if len(block) == QUERIES:
            flush()
    flush()
    if not parts:
        return docs.sparkSession.createDataFrame([], "query_id string, doc_id string, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, ["query_id"], k)


def embedding_quality(vectors: DataFrame, id_col: str, vec_col: str, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows, distinct ids, sizes, vectors not finite, vectors not of unit length."""
    d = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall(d, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids"), F.min(F.size(vec_col)).cast("long").alias("min_dim"), F.max(F.size(vec_col)).cast("long").alias("max_dim"), F.count_if(~finite).alias("not_finite"), F.count_if(F.abs(norm - 1) > tolerance).alias("not_unit"))
