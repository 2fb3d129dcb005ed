"""BM25 over an inverted index that is kept by document."""

from __future__ import annotations

from collections import Counter
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.hashing import DIM, Sums, unit_lists
from tessera.functions.text import term_counts, tokenize
from tessera.operators.ranking import DIGITS, best_columns, top_k
from tessera.plans.lineage import cut, stored
from tessera.plans.skew import fits

K1, B = 1.5, 0.75
#: Bytes of text that a task counts the terms of.
TEXT_BYTES = 32 << 20
#: Queries up to which documents are scored where they lie; scores that a worker holds at once; postings or rows that leave it at once.
QUERIES, CELLS, ROWS = 4096, 1 << 21, 1 << 18
#: Documents whose vectors leave a worker at once.
DOCS = 1 << 13


def dealt(docs: DataFrame, size: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, text) dealt by id to as many parts as the session has for shuffles, or to more, so that a part holds about size
    bytes of text however large the input: what is counted by document is counted where it lies."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, docs = -(-total // size), docs.select("doc_id", "text")
    return docs.repartition(parts, "doc_id") if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else docs.repartition("doc_id")


def texts_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, texts): the texts of an id, of which there is one as a rule, dealt by `dealt`. This takes no further shuffle."""
    return dealt(docs).groupBy("doc_id").agg(F.collect_list("text").alias("texts"))


def _asked(queries: DataFrame) -> list[str] | None:
    """The terms of queries (query_id, query), or None where they are too many to be broadcast."""
    asked = queries.select(F.explode(tokenize(F.col("query"))).alias("term")).distinct()
    return [r.term for r in asked.collect()] if fits(asked) else None


def _counter(asked: list[str] | None, dim: int | None):
    """A function of (doc_id, texts) to (doc_id, dl, tokens, entries, v); the texts of an id that have the same length are one row.

    With asked, entries are of these terms only. tokens counts the row's; with dim, v is the hashed unit vector of all of the id's
    texts, in the first of its rows.
    """
    keep = None if asked is None else {t.encode() for t in asked}

    def run(batches):
        at, dls, tokens, terms, tfs, ends, sums = [], [], [], [], [], [0], Sums(dim or DIM)

        def flush(ids):
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], names=["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            v = pa.nulls(len(at), pa.list_(pa.float64()))
            if dim:
                some, v = unit_lists(sums.rows()[0])
                place = np.full(len(at), -1)
                place[some] = np.arange(len(some))
                v = v.take(pa.array(place, mask=place < 0))
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(dls, pa.int32()), pa.array(tokens, pa.int64()), lists, v], names=["doc_id", "dl", "tokens", "entries", "v"])
            for x in (at, dls, tokens, terms, tfs):
                x.clear()
            ends[:] = [0]
            sums.__init__(dim or DIM)
            return out

        for b in batches:
            for i, texts in enumerate(b.column(1).to_pylist()):
                by_length: dict[int, Counter] = {}
                for t in texts:
                    n = term_counts([t])
                    by_length.setdefault(n.total(), Counter()).update(n)
                by_length.pop(0, None)
                if dim and by_length:
                    sums.add(sum(by_length.values(), Counter()) if len(by_length) > 1 else next(iter(by_length.values())))
                    sums.sizes += [0] * (len(by_length) - 1)
                for dl, n in by_length.items():
                    at.append(i)
                    dls.append(dl)
                    tokens.append(n.total())
                    kept = list(n) if keep is None else [t for t in n if t in keep]
                    terms.extend(kept)
                    tfs.extend(n.values() if keep is None else [n[t] for t in kept])
                    ends.append(len(terms))
                if max(len(terms), len(sums.places)) >= ROWS or len(at) >= DOCS:
                    yield flush(b.column(0))
            if at:
                yield flush(b.column(0))

    return run


class Index:
    """postings(term, doc_id, tf, dl), term_stats(term, df), stats(n, avgdl); lists(doc_id, dl, entries of term and tf);
    with dim vectors(doc_id, v), which are those of `hashed_embedding`.

    Texts are cut once: lists and vectors are written as a table beside the checkpoints; postings are its entries, df and avgdl
    sums over it. With queries (query_id, query) it has entries of their terms only, which keep their statistics; more terms than
    can be broadcast are all kept. An empty corpus raises where a score is asked for.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame | None = None, dim: int | None = None):
        self.docs = docs.select("doc_id")
        schema = StructType([*self.docs.schema, *StructType.fromDDL("dl int, tokens bigint, entries array<struct<term:string,tf:bigint>>, v array<double>")])
        rows, self.folder = stored(texts_by_id(docs).mapInArrow(_counter(None if queries is None else _asked(queries), dim), schema), "bm25")
        self.lists, self.vectors = rows.select("doc_id", "dl", "entries"), rows.where("v IS NOT NULL").select("doc_id", "v")
        self.postings = self.lists.select("doc_id", "dl", F.inline("entries"))
        self.term_stats = self._counted(self.postings)
        size = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        self.stats = cut(docs.agg(F.count("*").alias("n")).join(size).select("n", F.when(F.col("n") > 0, F.col("tokens") / F.col("n")).alias("avgdl")))

    @cached_property
    def one_each(self) -> bool:
        """Whether each document is one row of the lists; ids that stand for several texts may not be."""
        n = self.lists.agg(F.count("*").alias("n"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("ids")).first()
        return n.n == 0 or n.n == n.ids

    def only(self, queries: DataFrame) -> Index:
        """The index of the terms that queries ask for, as a table of its own: these terms keep their statistics, so that the queries
        have the same scores over fewer entries. More terms than can be broadcast leave the index as it is."""
        asked = _asked(queries)
        if asked is None:
            return self
        terms = pa.array(asked, pa.string())

        def run(batches):
            for b in batches:
                entries = b.column(2).flatten()
                keep = pc.is_in(entries.field("term"), value_set=terms)
                ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
                kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), entries.filter(keep))], names=["doc_id", "dl", "entries"])

        out = copy(self)
        out.one_each = self.one_each
        out.lists, out.folder = stored(self.lists.mapInArrow(run, self.lists.schema), "bm25")
        out.postings = out.lists.select("doc_id", "dl", F.inline("entries"))
        out.term_stats = self._counted(out.postings)
        return out

    def _counted(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("term").agg(F.count("*").alias("df"))

    def idf(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, idf), of the given terms or of all."""
        n = F.broadcast(self.stats.select("n"))  # one row
        if terms is not None:
            terms = terms.select("term").distinct()
            terms = F.broadcast(terms) if fits(terms) else terms
        stats = self.term_stats if terms is None else self._counted(self.postings.join(terms, "term", "left_semi"))
        return stats.join(n).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def scores(self, queries: DataFrame, k1: float = K1, b: float = B, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score) of documents with a query term; repeated query terms count as often as they stand.

        With k only documents that may be among a query's k best by rounded score, ties to the smaller id, and rounded scores.
        Up to QUERIES queries pass through the driver, and each document is scored where it lies; beyond that terms are joined.
        """
        q = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        if not self.docs.take(1):
            raise ValueError("an empty corpus has no index")
        wanted = q.join(self.idf(q), "term")
        if fits(queries, QUERIES) and fits(q) and self.one_each:
            return self._in_place(wanted.select("query_id", "term", "qtf", "idf"), k1, b, k)
        hit = self.postings.join(F.broadcast(wanted) if fits(q) else wanted, "term").join(F.broadcast(self.stats.select("avgdl")))
        tf, norm = F.col("tf"), 1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-12))
        part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * norm)
        return hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))

    def _in_place(self, wanted: DataFrame, k1: float, b: float, k: int | None) -> DataFrame:
        """`scores` without a shuffle: blocks of documents against all of wanted (query_id, term, qtf, idf)."""
        avgdl, rows = max(self.stats.first().avgdl, 1e-12), wanted.toArrow().combine_chunks()
        ids, terms = (rows[c].combine_chunks().unique() for c in ("query_id", "term"))
        term = pc.index_in(rows["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        query = pc.index_in(rows["query_id"].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        weight = (rows["qtf"].to_numpy() * rows["idf"].to_numpy())[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int64)
        n_queries = len(ids)

        def block(part):
            """Scores of a block of documents, a row a query, and which of them have a query term."""
            n = part.num_rows
            entries = part.column(2).flatten()
            code = pc.index_in(entries.field("term"), value_set=terms)
            at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            code = code.take(pa.array(at)).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))[at]
            tf = entries.field("tf").to_numpy(zero_copy_only=False)[at]
            norm = (1 - b + b * part.column(1).to_numpy() / avgdl)[doc]
            value = tf * (k1 + 1) / (tf + k1 * norm)
            # A term's documents meet its queries; a document has one entry of a term, and a query one row.
            by_term = np.argsort(code, kind="stable")
            doc, value = doc[by_term], value[by_term]
            found, start = np.unique(code[by_term], return_index=True)
            scores, seen = np.zeros((n_queries, n)), np.zeros((n_queries, n), bool)
            for c, i, j in zip(found, start, [*start[1:], len(doc)]):
                own = slice(first[c], first[c + 1])
                cells = np.ix_(query[own], doc[i:j])
                scores[cells] += weight[own, None] * value[i:j]
                seen[cells] = True
            return scores, seen

        def run(batches):
            for batch in batches:
                step = max(CELLS // n_queries, 1)
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    part = part.take(pc.array_sort_indices(part.column(0), null_placement="at_start"))
                    s, seen = block(part)
                    if k is None:
                        q, d = np.nonzero(seen)
                    else:
                        s = np.where(seen, np.round(s, DIGITS), -np.inf)
                        q, d = best_columns(s, k)
                    for j in range(0, len(q), ROWS):
                        x, y = q[j : j + ROWS], d[j : j + ROWS]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), part.column(0).take(pa.array(y)), pa.array(s[x, y])], names=["query_id", "doc_id", "score"])

        schema = StructType([wanted.schema["query_id"], self.docs.schema["doc_id"], StructField("score", DoubleType())])
        return self.lists.mapInArrow(run, schema) if n_queries else self.docs.sparkSession.createDataFrame([], schema)

    def search(self, queries: DataFrame, k: int = 10, pad: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best; with pad, documents of score 0 by rising id fill up to k."""
        found = top_k(self.scores(queries, k=max(k, 0)), ["query_id"], k)
        if not pad:
            return found
        # If m < k documents match, all are found, and at most m of the k first ids are among them: k - m are left at least.
        found = cut(found.drop("rank"))
        first = F.broadcast(self.docs.orderBy("doc_id").limit(max(k, 0)))
        zero = queries.select("query_id").join(first).join(found, ["query_id", "doc_id"], "left_anti")
        return top_k(found.unionByName(zero.withColumn("score", F.lit(0.0))), ["query_id"], k)
