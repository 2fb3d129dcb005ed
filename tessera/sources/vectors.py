"""A store of a corpus's vectors that is filled shard by shard, can be taken up again after a stop, and encodes only what changed.

A document's shard is a hash of its id. A shard's digest covers its ids in order and their texts. Vectors are written in a few
jobs; once a job's vectors are there and have been checked, its shards are entered in the store's manifest with their digests.
What a stopped run left without an entry is never read. A shard whose digest has an entry isn't encoded again.

    identity/   one line of JSON: model, number of shards, format; a store serves one model
    data/       job=<name>/: shard, digest, id, v
    manifest/   shard, digest, n, job
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import cut
from tessera.plans.skew import lookup_join

#: Documents of a shard about, jobs that a run takes, how far a length may be from 1, vectors that are encoded at once.
ROWS, JOBS, UNIT, BATCH = 1024, 8, 2e-5, 256
MANIFEST = "shard int, digest string, n long, job string"
DATA = "shard int, digest string, id string, v array<float>, job string"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shard_of(id_: Column, shards: int) -> Column:
    return (F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("long") % shards).cast("int")


def identity(spark: SparkSession, path: str) -> dict | None:
    """What the store is of, or None where there is none."""
    return json.loads(spark.read.text(f"{path}/identity").first().value) if _there(spark, f"{path}/identity/_SUCCESS") else None


def _claim(spark: SparkSession, path: str, model: str, shards: int) -> dict:
    """The store's identity, which is written first where the store is new. Raises if the store is another model's."""
    have = identity(spark, path)
    if have is None:
        have = {"format": 1, "model": model, "shards": shards}
        spark.createDataFrame([(json.dumps(have, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/identity")
    if (have["format"], have["model"]) != (1, model):
        raise ValueError(f"{path} holds vectors of {have['model']}, not of {model}; use a new folder")
    return have


def _documents(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("shard", shard_of(F.coalesce("id", F.lit("")), shards))


def _digests(rows: DataFrame) -> DataFrame:
    """(shard, digest, n); raises on null and repeated ids as it runs. A shard's list holds an id and a digest for each of its documents."""
    each = F.sort_array(F.collect_list(F.struct(F.col("id"), F.sha2(F.col("text").cast("binary"), 256).alias("t"))))
    text = F.array_join(F.transform("each", lambda x: F.concat(F.octet_length(x.id).cast("string"), F.lit(":"), x.id, F.lit(" "), x.t)), "\n")
    per = rows.groupBy("shard").agg(each.alias("each"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("none"))
    ok = F.when(F.col("none") > 0, F.raise_error(F.lit("a document without id")).cast("string")).when(F.size(F.array_distinct(F.transform("each", lambda x: x.id))) < F.col("n"), F.raise_error(F.concat(F.lit("repeated ids in shard "), "shard")).cast("string"))
    return per.select("shard", ok.otherwise(F.sha2(text, 256)).alias("digest"), "n")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries, one for each shard and digest."""
    if not _there(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.groupBy("shard", "digest").agg(F.min(F.struct("job", "n")).alias("e")).select("shard", "digest", "e.n", "e.job")


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def encode_store(docs: DataFrame, path: str, model: str, load: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, jobs: int = JOBS) -> dict[str, int]:
    """Brings the store at path up to date with docs: {"shards": those that docs have, "encoded": those that were written now}.

    model names what load gives, in full (with its version and length limit): a store of another name is refused. load is called
    once in each task's worker and returns a function of texts to their vectors, which are scaled to length 1 and kept as floats;
    vectors not finite or zero fail the run. Ids are unique and not null; null texts are empty. A new store gets a shard for every
    `rows` documents; later runs keep that number. Shards are entered after each of `jobs` jobs.
    """
    spark = docs.sparkSession
    have = identity(spark, path)
    have = _claim(spark, path, model, have["shards"] if have else max(1, -(-docs.count() // rows)))
    own = _documents(docs, id_col, text_col, have["shards"])
    wanted = cut(_digests(own))
    missing = cut(wanted.join(_manifest(spark, path), ["shard", "digest"], "left_anti"))

    def run(batches):
        encode = load()
        for b in batches:
            texts, found = b.column(3).to_pylist(), []
            for at in range(0, len(texts), BATCH):
                x = np.asarray(encode(texts[at : at + BATCH]), float).reshape(min(BATCH, len(texts) - at), -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                if not np.isfinite(x).all() or (norm == 0).any():
                    raise ValueError("a vector is not finite, or zero")
                found.append((x / norm).astype(np.float32))
            if found:
                x = np.concatenate(found)
                v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), v], names=["shard", "digest", "id", "v"])

    done = 0
    for i in range(jobs):
        part = missing.where(F.pmod("shard", F.lit(jobs)) == i)
        if n := part.count():
            job = uuid.uuid4().hex
            texts = lookup_join(own, part.select("shard", "digest"), ["shard"]).select("shard", "digest", "id", "text")
            texts.mapInArrow(run, "shard int, digest string, id string, v array<float>").write.parquet(f"{path}/data/job={job}")
            made = spark.read.schema(DATA).parquet(f"{path}/data/job={job}")
            checked = made.groupBy("shard", "digest").agg(F.count("*").alias("n"), F.max(F.abs(_norm() - 1)).alias("off"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))
            entries = cut(part.join(checked.withColumnRenamed("n", "have"), ["shard", "digest"], "left"))
            if wrong := entries.where(f"have IS NULL OR have <> n OR isnan(off) OR off > {UNIT} OR low <> high").first():
                raise ValueError(f"shard {wrong.shard}: {wrong.have} of {wrong.n} vectors, lengths off by {wrong.off}")
            entries.select("shard", "digest", "n", F.lit(job).alias("job")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
            done += n
    return {"shards": wanted.count(), "encoded": done}


def _live(docs: DataFrame, path: str, model: str, id_col: str, text_col: str) -> DataFrame:
    """(shard, digest, n, have, job): the shards that docs have, and their entries (nulls where there is none)."""
    spark = docs.sparkSession
    have = identity(spark, path)
    if have is None or have["model"] != model:
        raise ValueError(f"{path} holds no vectors of {model}")
    wanted = _digests(_documents(docs, id_col, text_col, have["shards"]))
    return wanted.join(_manifest(spark, path).withColumnRenamed("n", "have"), ["shard", "digest"], "left")


def read_store(docs: DataFrame, path: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v array<float>): the vectors of docs. Raises where the store is another model's, or lacks a shard of docs as they are now;
    a vector that isn't finite and of length 1 fails the query as it runs."""
    spark = docs.sparkSession
    live = cut(_live(docs, path, model, id_col, text_col))
    if lacking := live.where("job IS NULL").count():
        raise ValueError(f"{lacking} shards aren't in the store as the documents are now: encode them first")
    if not live.take(1):
        return spark.createDataFrame([], "id string, v array<float>")
    got = lookup_join(spark.read.schema(DATA).parquet(f"{path}/data"), live.select("shard", "digest", "job"), ["shard", "digest", "job"])
    off = F.raise_error(F.concat(F.lit("not of unit length: "), "id")).cast("array<float>")
    return got.select("id", F.when(F.abs(_norm() - 1) <= UNIT, F.col("v")).otherwise(off).alias("v"))


def store_violations(docs: DataFrame, path: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule): shards of docs that the store lacks, and documents whose vectors are missing, repeated, not theirs or not of length 1."""
    spark = docs.sparkSession
    have = identity(spark, path)
    live = cut(_live(docs, path, model, id_col, text_col))
    lacking = live.where("job IS NULL").select(F.concat(F.lit("shard "), "shard").alias("id"), F.lit("not encoded").alias("rule"))
    entered = live.where("job IS NOT NULL").select("shard", "digest", "job")
    if not entered.take(1):
        return lacking
    stored = lookup_join(spark.read.schema(DATA).parquet(f"{path}/data"), entered, ["shard", "digest", "job"])
    vectors = stored.groupBy("id").agg(F.count("*").alias("n"), F.max(F.abs(_norm() - 1)).alias("off"))
    due = lookup_join(_documents(docs, id_col, text_col, have["shards"]), entered.select("shard"), ["shard"], "left_semi").select("id", F.lit(True).alias("due"))
    both = due.join(vectors, "id", "full_outer")
    rule = F.when(F.col("due").isNull(), "no such document").when(F.col("n").isNull(), "no vector").when(F.col("n") > 1, "repeated vector").when(F.isnan("off") | (F.col("off") > UNIT), "not of unit length")
    return lacking.unionByName(both.select("id", rule.alias("rule")).where("rule IS NOT NULL"))
