"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves on a local master; on a cluster, whose machines would not share it, this raises.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        have = spark.conf.get("spark.checkpoint.dir", None)
        if have is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            have = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint (replicated storage, never executor-local blocks)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a folder of its own beside the checkpoints and read again, and that folder.

    Unlike a checkpoint it is columnar: later passes read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder that `stored` made, once nothing is to be read from it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
