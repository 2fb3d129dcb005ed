"""Files of the evaluation: JSON lines, NPY shards, sinks that don't overwrite, and digests of small files.

Reading and checking rows is distributed; only reports and manifests, which are small, are written by the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.npy import TASK_ROWS, NpyDataSource

_QUERY = "id string, query string, relevant_ids array<string>"
_LABELS = "array<struct<id: string, relevance: string>>"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at): the lines that aren't blank, trimmed, and where they stand."""
    raw = spark.read.text(path).select(F.trim("value").alias("value"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return raw.toDF("value", "file", "block", "at")


def first_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line of each file that isn't JSON, numbered from 1; empty if all are."""
    rows = json_lines(spark, path)
    bad = rows.where("value <> '' AND try_parse_json(value) IS NULL").groupBy("file").agg(F.min(F.struct("block", "at")).alias("stop"))
    upto = rows.join(F.broadcast(bad), "file").where(F.struct("block", "at") <= F.col("stop"))
    return upto.groupBy("file").agg(F.count("*").alias("line"))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    bad = first_bad_lines(spark, path).orderBy("file").first()
    if bad:
        raise ValueError(f"not JSON: line {bad.line} of {bad.file}")
    return json_lines(spark, path).where("value <> ''").select("value")


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, body): ids as strings, rows as JSON. Raises on a missing, null or repeated id."""
    docs = _parsed(spark, path).select(F.get_json_object("value", "$.id").alias("doc_id"), F.col("value").alias("body"))
    wrong = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").first()
    if wrong:
        raise ValueError("a document without id" if wrong.doc_id is None else f"repeated id: {wrong.doc_id}")
    return docs


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_ids): the given relevant_ids, or where that key is missing the labels of positive relevance,
    which may be a list or a string that holds one.

    Sorted and distinct. Raises where id or query is missing.
    """
    rows = _parsed(spark, path).select(F.from_json("value", _QUERY).alias("r"), F.array_contains(F.json_object_keys("value"), "relevant_ids").alias("given"), F.from_json(F.get_json_object("value", "$.labels"), _LABELS).alias("labels"))
    if rows.where("r.id IS NULL OR r.query IS NULL").take(1):
        raise ValueError("a query without id or query")
    labelled = F.expr("transform(filter(labels, x -> x.id IS NOT NULL AND coalesce(try_cast(x.relevance AS double), 0) > 0), x -> x.id)")
    ids = F.coalesce(F.when(F.col("given"), F.col("r.relevant_ids")).otherwise(labelled), F.array().cast("array<string>"))
    return rows.select(F.col("r.id").alias("query_id"), "r.query", F.array_sort(F.array_distinct(ids)).alias("relevant_ids"))


def read_npy(spark: SparkSession, path: str, dim: int, unit: float | None = 1e-5, rows: int = TASK_ROWS) -> DataFrame:
    """(file, row, v): the rows of NPY shards, tasks of `rows` rows. Raises unless they are finite floats of `dim` columns and, with
    unit, of length 1. Filters of `file` keep other files from being opened; this allows Python data sources to take filters in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("path", path).option("dim", dim).option("unit", "none" if unit is None else unit).option("rows", rows).load()


def refuse_full(spark: SparkSession, path: str) -> None:
    """Raises if the folder or file exists and holds something."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getContentSummary(at).getLength() > 0:
        raise FileExistsError(path)


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines with sorted keys and nulls; with order, one file sorted by that column, for small results."""
    lines = df if order is None else df.repartition(1).sortWithinPartitions(order)
    lines.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by commas."""
    flat = [F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_report(path: str, text: str, expected: str | None = None) -> str:
    """Writes a small report at once or not at all, and returns its SHA-256.

    Raises if that isn't the expected one, or if the file is there with other bytes; the same bytes are left as they are.
    """
    body = text.encode()
    got = hashlib.sha256(body).hexdigest()
    if expected is not None and got != expected:
        raise ValueError(f"{path}: digest {got}, {expected} expected")
    if os.path.exists(path):
        if file_digest(path) != got:
            raise FileExistsError(f"{path} holds other bytes")
        return got
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "wb") as f:
        f.write(body)
    os.replace(part, path)
    return got


def manifest(paths: Mapping[str, str]) -> dict[str, dict]:
    """Size and SHA-256 by name."""
    return {n: {"bytes": os.path.getsize(p), "sha256": file_digest(p)} for n, p in sorted(paths.items())}


def changed(made: Mapping[str, Mapping], paths: Mapping[str, str]) -> list[str]:
    """Names whose file is missing or differs from the manifest, or that only one side has."""
    here = {n: p for n, p in paths.items() if os.path.isfile(p)}
    now = manifest(here)
    return sorted(n for n in made.keys() | paths.keys() if n not in made or now.get(n) != dict(made[n]))


def markdown(df: DataFrame, title: str) -> str:
    """A small summary as a Markdown table."""
    rows = df.collect()
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])
