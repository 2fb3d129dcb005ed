"""A gate of completion: rules over relations that depend on one another, each with its status, counts and a digest of its evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import digest

RESULT = "check string, over string, status string, broken long, rows long, digest string"


@dataclass(frozen=True)
class Check:
    """A rule that rows of the relation `over` break where `breaks` is true or null. It counts only if the checks that it needs
    passed. A relation of fewer rows than `at_least` is missing: nothing shows nothing."""

    name: str
    over: str
    breaks: Column | str
    needs: tuple[str, ...] = ()
    at_least: int = 1


def _ordered(checks: Sequence[Check]) -> list[Check]:
    by = {c.name: c for c in checks}
    if len(by) < len(checks):
        raise ValueError("checks of one name")
    if unknown := sorted({n for c in checks for n in c.needs} - by.keys()):
        raise ValueError(f"needed, but not there: {unknown}")
    try:
        return [by[n] for n in TopologicalSorter({c.name: c.needs for c in checks}).static_order()]
    except CycleError as e:
        raise ValueError(f"checks that need one another: {e.args[1]}") from None


def _measure(df: DataFrame, checks: Sequence[Check]) -> tuple[int, str, dict[str, int]]:
    """Rows, digest and broken rows by check of a relation, in one pass. Rows are hashed as text, so that maps are, too."""
    text = F.to_json(F.struct(*[df[c] for c in sorted(df.columns)])) if df.columns else F.lit("")
    sums = [F.sum(F.xxhash64(F.lit(s), text).cast("decimal(38,0)")) for s in ("a", "b")]
    rule = lambda c: F.expr(c.breaks) if isinstance(c.breaks, str) else c.breaks
    n, a, b, *broken = df.agg(F.count("*"), *sums, *[F.count_if(F.coalesce(rule(c), F.lit(True))) for c in checks]).first()
    return n, digest([n, str(a), str(b)]), {c.name: k for c, k in zip(checks, broken)}


def gate(spark: SparkSession, relations: Mapping[str, DataFrame | None], checks: Sequence[Check]) -> DataFrame:
    """(check, over, status, broken, rows, digest), a row a check: passed, failed, missing (no such relation, None or too few rows),
    or blocked, where a check that it needs didn't pass.

    A digest covers the relation's rows in any order, the outcome and the digests of the needed checks: it changes with any of
    them. Each relation is read once for all of its rules. Raises on checks of one name, unknown needs and cycles.
    """
    order, seen, done = _ordered(checks), {}, {}
    for c in order:
        if c.over not in seen:
            df = relations.get(c.over)
            seen[c.over] = (0, None, {}) if df is None else _measure(df, [x for x in checks if x.over == c.over])
    for c in order:
        rows, of, broken = seen[c.over]
        n = broken.get(c.name, 0)
        status = "blocked" if any(done[x][2] != "passed" for x in c.needs) else "missing" if of is None or rows < c.at_least else "failed" if n else "passed"
        done[c.name] = (c.name, c.over, status, n, rows, digest([c.name, c.over, of, status, n, [done[x][5] for x in c.needs]]))
    return spark.createDataFrame([done[c.name] for c in checks], RESULT)


def require_complete(results: DataFrame) -> str:
    """The digest of all checks. Raises with those that didn't pass, if there are any; no checks are no evidence."""
    rows = results.orderBy("check").collect()
    if open_ := [f"{r.check}: {r.status}" for r in rows if r.status != "passed"]:
        raise ValueError("; ".join(open_))
    if not rows:
        raise ValueError("no checks")
    return digest([r.digest for r in rows])
