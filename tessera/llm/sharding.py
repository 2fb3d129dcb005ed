"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

#: Over a hundred slots a shard keep shares within a percent or so of each other.
TABLE_SIZE = 8191
N_SHARDS = 64


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(names: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard. Each shard's preference order is (offset + j * skip) mod size, from a hash of its name.

    size must be prime (so that each order visits all slots) and at least the number of shards. Adding or removing one shard
    moves little more than its own share of the slots.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, one at least")
    if size < len(names) or size < 3 or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be prime and no less than the number of shards")
    offset, skip = [], []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        offset.append(int.from_bytes(h[:8], "big") % size)
        skip.append(int.from_bytes(h[8:16], "big") % (size - 1) + 1)
    out, at, left = [-1] * size, [0] * len(names), size
    while True:
        for i in range(len(names)):
            while out[slot := (offset[i] + at[i] * skip[i]) % size] >= 0:
                at[i] += 1
            out[slot] = i
            at[i] += 1
            left -= 1
            if not left:
                return out


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot and shard added (existing columns of these names are replaced); no shuffle.

    The broadcast table has `size` rows whatever the input. A row's slot hashes its id; rows with a null id use their text (so
    that they spread), null text counts as ''. Repeated rows meet in one shard.
    """
    rows = list(enumerate(lookup_table(shard_names(n_shards), size)))
    lut = F.broadcast(docs.sparkSession.createDataFrame(rows, "slot int, shard int"))
    docs = docs.drop("slot", "shard")
    (slot,) = fresh(docs, "at_slot")
    key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), F.md5(F.col(text_col))), F.lit("t"))
    placed = docs.withColumn(slot, (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % size).cast("int"))
    return placed.join(lut, placed[slot] == lut.slot).drop(slot)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, parts: int = 1, **kw) -> None:
    """Parquet under path/shard=N; `parts` tasks a shard, dealt by a hash of the row, keep any one task small.

    Every row is written once, with null ids and texts, repeated rows and all columns but slot; an empty table writes no shard.
    """
    placed = assign_shards(docs, n_shards, **kw).drop("slot")
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(parts))
    placed.repartition(n_shards * parts, "shard", salt).write.partitionBy("shard").parquet(path)


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "slot", "shard")


def op4_sql() -> str:
    lut = ",".join(map(str, lookup_table(shard_names(N_SHARDS))))
    return f"""
WITH d AS (SELECT doc_id, length(text)::BIGINT AS n_chars, coalesce('i' || doc_id::VARCHAR, 't' || md5(text), 't') AS k FROM documents),
s AS (SELECT doc_id, n_chars, (('0x' || substr(md5(k), 1, 12))::BIGINT % {TABLE_SIZE})::INT AS slot FROM d)
SELECT doc_id, n_chars, slot, [{lut}][slot + 1]::INT AS shard FROM s"""
