"""Size-checked broadcasts and salted joins for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side (tens of bytes a row) is broadcast: some tens of MB.
BROADCAST_ROWS = 500_000
#: A key with one in so many of the rows is hot, of which there are no more than so many; its rows are dealt to SALTS parts.
HOT_SHARE, SALTS = 1000, 64


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """Working column names that clash with none of df's (or of the given ones)."""
    taken, out = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most max_rows rows; stops counting right after the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def among(df: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key asked has; few keys are broadcast, so that the other rows, and what is computed of them, are never moved."""
    keys = asked.select(key).distinct()
    return df.join(F.broadcast(keys) if fits(keys) else keys, key, "left_semi")


def _part(df: DataFrame, n: int) -> Column:
    """A part from 0 to n - 1 for each row of df, from its content and the number of the partition that it lies in.

    Recomputed tasks, which hold the same rows in whatever order, deal them alike. Equal rows go apart as far as they come from
    several partitions: a part gets no more of them than its share of those partitions holds. Maps can't be hashed and are left out.
    """
    cols = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[df[c] for c in cols]), F.lit(n)).cast("int")


def split_join(big: DataFrame, small: DataFrame, keys: str | list[str], n: str, max_rows: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Inner or left join on keys of which small has one row each; small[n], dropped here, is the key's number of rows in big.

    Broadcast if small is within the bound. Beyond it, one join by shuffle, in which the rows of hot keys are dealt to several
    parts by their content and partition; the list of hot keys, HOT_SHARE at most, is broadcast. small is read several times: cut it before.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if fits(small, max_rows):
        return big.join(F.broadcast(small.drop(n)), keys, how)
    total = small.agg(F.sum(n)).first()[0] or 0
    salt, mark = fresh([*big.columns, *small.columns], "salt_of_key", "is_hot")
    hot = F.col(n) * HOT_SHARE >= total
    dealt = big.join(F.broadcast(small.where(hot).select(*keys, F.lit(True).alias(mark))), keys, "left")
    dealt = dealt.withColumn(salt, F.when(F.col(mark), _part(dealt.drop(mark), SALTS)).otherwise(0)).drop(mark)
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join big to small on keys (null-safe): broadcast if small is within the bound, else salted, so that no key is one task.

    The salt comes from the big side's row content and partition, so that recomputed tasks deal rows the same way.
    """
    cols = [c for c in small.columns if c not in keys]
    salt, copy, *renamed_keys = fresh([*big.columns, *cols], "salt_of_row", "salt_of_copy", *[f"key_{i}" for i in range(len(keys))])
    renamed = small.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed_keys)], *cols)
    cond = F.lit(True)
    for k, r in zip(keys, renamed_keys):
        cond = cond & big[k].eqNullSafe(F.col(r))
    if fits(small, max_rows):
        return big.join(F.broadcast(renamed), cond, how).drop(*renamed_keys)
    salted = big.withColumn(salt, _part(big, salts))
    cond = F.col(salt) == F.col(copy)
    for k, r in zip(keys, renamed_keys):
        cond = cond & salted[k].eqNullSafe(F.col(r))
    copies = renamed.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, cond, how).drop(salt, copy, *renamed_keys)
