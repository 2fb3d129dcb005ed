"""Readers and the retrieval roles of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.plans.lineage import cut
from tessera.plans.skew import among, fits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id string, text, src): ids as strings, whose order breaks ties."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("src"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), src.alias("src"))


def derived_qrels(docs: DataFrame, qs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id): documents that hold the whole query; found by the query's longest inner token, then compared.

    With postings (term, doc_id), such as an index's, only the documents that these propose are read.

    The first and last token may be parts of longer words, so queries of fewer than three tokens are compared with all documents.
    """
    n = F.size(tokenize(F.col("query")))
    t = F.slice(tokenize(F.col("query")), 2, F.greatest(n - 2, F.lit(1)))
    longest = F.aggregate(t, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    q = qs.where(n > 2).select("query_id", "query", longest.alias("t"))
    d = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("t")) if postings is None else postings.select("doc_id", F.col("term").alias("t"))
    asked = q.select("query_id", "t")
    hit = d.join(F.broadcast(asked) if fits(asked) else asked, "t").select("query_id", "doc_id")
    hit = cut(hit)
    long = hit.join(qs.select("query_id", "query"), "query_id").join(among(docs.select("doc_id", "text"), hit, "doc_id"), "doc_id").where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")
    few = qs.where(n < 3).select("query_id", "query")
    short = docs.select("doc_id", "text").join(F.broadcast(few) if fits(few) else few, F.col("text").contains(F.col("query")))
    return long.unionByName(short.select("query_id", "doc_id"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_ranks_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a .csv (query_id, id or qid), .jsonl, .json list or one-per-line file; a byte-order mark is skipped."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        col = F.coalesce(*[F.col(c) for c in ("query_id", "id", "qid") if c in df.columns])
    elif path.endswith((".jsonl", ".json")):
        raw = spark.read.option("wholetext", path.endswith(".json")).text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
        if path.endswith(".json"):
            raw = raw.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
        df, col = raw, F.coalesce(*[F.get_json_object("value", f"$.{c}") for c in ("query_id", "id", "qid")], F.trim(F.regexp_replace("value", '^"|"$', "")))
    else:
        df = spark.read.text(path)
        col = F.trim(F.regexp_replace("value", "^﻿", ""))
    return df.select(col.cast("string").alias("id")).where("id IS NOT NULL AND id <> ''").distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in order; refuses to overwrite."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)
