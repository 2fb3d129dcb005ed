"""Steps that are kept under a digest of what they are made from, and made again only where that has changed.

    <folder>/<step>/<key>/   Parquet; its _SUCCESS file is the entry, so that what a stopped run left is written anew
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.lineage import forget
from tessera.sources.files import digest


@dataclass(frozen=True)
class Step:
    """A table that build makes of its inputs (names of sources or earlier steps) and parameters; these name the code's version, too."""

    name: str
    inputs: Sequence[str]
    build: Callable[..., DataFrame]
    params: Mapping[str, object] = field(default_factory=dict)


def contents(spark: SparkSession, path: str) -> list:
    """Paths, lengths and times of the files at or under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    files = fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def keys(spark: SparkSession, steps: Sequence[Step], sources: Mapping[str, str]) -> dict[str, str]:
    """The key of each step: a digest of its name, its parameters and its inputs' keys (of a source, its files). Raises on names given
    twice and on inputs that are neither sources nor earlier steps."""
    known, out = {}, {}
    for s in steps:
        if s.name in out or s.name in sources:
            raise ValueError(f"two of the name {s.name}")
        for i in s.inputs:
            if i not in known:
                if i not in sources:
                    raise ValueError(f"{s.name} needs {i}, which isn't made before")
                known[i] = digest(contents(spark, sources[i]))
        out[s.name] = known[s.name] = digest([s.name, dict(s.params), [known[i] for i in s.inputs]])
    return out


def run(spark: SparkSession, folder: str, steps: Sequence[Step], sources: Mapping[str, str], keep: int = 2) -> tuple[dict[str, DataFrame], list[str]]:
    """The steps' tables by name, and the names of those that were made now. Sources are folders or files of Parquet.

    build gets its inputs as DataFrames, in order, and the parameters by name. Each step is written before the next one starts:
    after a failure, a later run goes on behind the last one written. Of each step the `keep` tables written last stay, the
    present one among them; no two runs may share a folder at a time.
    """
    if keep < 1:
        raise ValueError("keep must be positive")
    key, tables, made = keys(spark, steps, sources), {}, []
    at = lambda name: f"{folder.rstrip('/')}/{name}/{key[name]}"
    for s in steps:
        if not _there(spark, f"{at(s.name)}/_SUCCESS"):
            given = [tables[i] if i in tables else spark.read.parquet(sources[i]) for i in s.inputs]
            s.build(*given, **s.params).write.mode("overwrite").parquet(at(s.name))
            made.append(s.name)
        tables[s.name] = spark.read.parquet(at(s.name))
    for s in steps:
        _evict(spark, f"{folder.rstrip('/')}/{s.name}", key[s.name], keep)
    return tables, made


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _evict(spark: SparkSession, folder: str, present: str, keep: int) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    others = [f for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName() != present]
    for f in sorted(others, key=lambda f: f.getModificationTime(), reverse=True)[keep - 1 :]:
        forget(spark, f.getPath().toString())
