"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint a document; correlated bits share a partition; each fingerprint gets its own threshold for each
partition, by dynamic programming over estimated candidate counts, such that the thresholds sum to tau - parts + 1: two
fingerprints within tau bits are then within some partition's threshold. Probes meet the index in buckets, where pairs are
verified in numpy and only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.operators.components import connected_components
from tessera.plans.lineage import cut
from tessera.plans.skew import fits, lookup_join

BITS = 64
TAU = 3
SHINGLE = 3
SEED = 42
#: Rows that are compared with one another at most; larger buckets are dealt as pairs of blocks.
BUCKET = 1024
#: Shingles counted at a time, so that memory doesn't grow with the text.
BLOCK = 1 << 16
#: Buckets that hold a thousandth of the rows or more are counted exactly: a thousand a partition at most.
HOT_SHARE = 1000


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Bit set where over half the hashes of the word k-shingles (repeats included) have it; no words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(k, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    n, counts, h = len(words) - k + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        starts = ([0] if at == 0 else [ends[at - 1]]) + ends[at : stop - 1]
        got = np.array([h(joined[s : e - 1], SEED) for s, e in zip(starts, ends[at + k - 1 : stop + k - 1])], ">u8")
        counts += np.unpackbits(got.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, keep: list[str], name: str = "fp") -> DataFrame:
    """keep columns and the fingerprint as a signed long."""
    fields = [f for f in docs.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*[f.name for f in fields], name])

    out = docs.select(*keep).schema.add(name, "long")
    (t_,) = fresh(docs, "whole_text")
    return docs.select(*keep, F.col(text_col).cast("string").alias(t_)).mapInArrow(run, out)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8)).reshape(-1, BITS)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def correlation(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 absolute correlations of the bits), summed over all fingerprints."""

    def run(batches):
        s, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy()).astype(np.float32)
            s += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.ravel().astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    part = fps.select("fp").mapInArrow(run, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "v"))
    rows = part.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # 4096 whatever the input
    if not rows or not rows[0].n:
        return 0, np.eye(BITS)
    n, s = rows[0].n, np.zeros(BITS * BITS)
    for r in rows:
        s[r.i] = r.v
    s = s.reshape(BITS, BITS) / n
    p = np.diag(s)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, np.abs((s - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each grows from the most correlated free bit by the bit most correlated with it."""
    free, out = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        f = sorted(free)
        group = [max(f, key=lambda b: (corr[b, f].sum(), -b))]
        while len(group) < width:
            f = sorted(free - set(group))
            group.append(max(f, key=lambda b: (corr[b, group].sum(), -b)))
        out.append(sorted(group))
        free -= set(group)
    return out


def choose_parts(n: int, tau: int = TAU) -> int:
    """Number of partitions with the least expected probes and comparisons for n evenly spread fingerprints."""

    def cost(m: int) -> float:
        per, extra = divmod(tau - m + 1, m)
        probes = sum(sum(comb(BITS // m, r) for r in range(per + (i < extra) + 1)) for i in range(m))
        return probes * (1 + 0.02 * n / 2 ** (BITS // m))

    return min(range(2, tau + 2), key=cost) if tau else 1


class Plan:
    """Partitions, counts of their 8-bit chunks and exact counts of hot values: all of bounded size."""

    def __init__(self, groups: list[list[int]], n: int, tau: int = TAU):
        self.groups, self.n, self.tau = groups, n, tau
        self.chunks = [[g[i : i + 8] for i in range(0, len(g), 8)] for g in groups]
        self.freq = [[np.zeros(1 << len(c)) for c in cs] for cs in self.chunks]
        self.hot = [(np.zeros(0, np.int64), np.zeros(0)) for _ in groups]

    def value(self, bits: np.ndarray, which: list[int]) -> np.ndarray:
        out = np.zeros(len(bits), np.int64)
        for b in which:
            out = out << 1 | bits[:, b]
        return out

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """(parts, tau + 2, rows): cost of thresholds -1 .. tau: candidates expected, and a share for each probe."""
        n, out = len(bits), np.full((len(self.groups), self.tau + 2, len(bits)), 0.0)
        for p, g in enumerate(self.groups):
            ball = np.zeros((self.tau + 1, n))
            ball[0] = max(self.n, 1)
            for c, freq in zip(self.chunks[p], self.freq[p]):
                v, w, f = self.value(bits, c), len(c), freq / max(self.n, 1)
                near = np.stack([sum((f[v ^ sum(1 << i for i in flip)] for flip in combinations(range(w), r)), np.zeros(n)) for r in range(self.tau + 1)])
                ball = np.stack([sum(ball[r - q] * near[q] for q in range(r + 1)) for r in range(self.tau + 1)])
            values, counts = self.hot[p]
            if len(values):
                v = self.value(bits, g)
                at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                ball[0] = np.maximum(ball[0], np.where(values[at] == v, counts[at], 0))
            reach = np.cumsum(ball, 0)
            for t in range(self.tau + 1):
                out[p, t + 1] = reach[t] + 25.0 * sum(comb(len(g), r) for r in range(1, t + 1))
        return out

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """(parts, rows): the cheapest thresholds from -1 to tau that sum to tau - parts + 1."""
        cost, m, n = self.costs(bits), len(self.groups), len(bits)
        total = self.tau + 1  # sum of (threshold + 1)
        best = [np.where(s == 0, 0.0, np.inf) * np.ones(n) for s in range(total + 1)]
        picks = []
        for p in range(m):
            nxt, pick = [], []
            for s in range(total + 1):
                options = np.stack([best[s - t] + cost[p, t] for t in range(min(s, self.tau + 1) + 1)])
                nxt.append(options.min(0))
                pick.append(options.argmin(0))
            best, picks = nxt, [*picks, np.stack(pick)]
        left, out = np.full(n, total), np.zeros((m, n), np.int64)
        for p in reversed(range(m)):
            out[p] = picks[p][left, np.arange(n)]
            left = left - out[p]
        return out - 1

    def rows(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(partition, value, fp, asks): an index row a partition, which asks if its threshold isn't -1, and the other probes."""
        bits = bits_of(fp)
        taus, out = self.thresholds(bits), []
        for p, g in enumerate(self.groups):
            v = self.value(bits, g)
            out.append((np.full(len(fp), p, np.int32), v, fp, taus[p] >= 0))
            for r in range(1, int(taus[p].max(initial=0)) + 1):
                far = np.nonzero(taus[p] >= r)[0]
                for flip in combinations(range(len(g)), r) if len(far) else ():
                    out.append((np.full(len(far), p, np.int32), v[far] ^ sum(1 << i for i in flip), fp[far], np.ones(len(far), bool)))
        return tuple(np.concatenate(x) for x in zip(*out))


def make_plan(fps: DataFrame, tau: int = TAU) -> Plan:
    n, corr = correlation(fps)
    plan = Plan(group_bits(corr, choose_parts(n, tau)), n, tau)

    def run(batches):
        for b in batches:
            bits = bits_of(b.column(0).to_numpy())
            got = [(p, c, plan.value(bits, which)) for p, cs in enumerate(plan.chunks) for c, which in enumerate(cs)]
            got += [(p, -1, plan.value(bits, g)) for p, g in enumerate(plan.groups)]
            for p, c, v in got:
                u, k = np.unique(v, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), p, np.int32)), pa.array(np.full(len(u), c, np.int32)), pa.array(u), pa.array(k.astype(np.int64))], names=["p", "c", "v", "k"])

    counts = fps.select("fp").mapInArrow(run, "p int, c int, v long, k long").groupBy("p", "c", "v").agg(F.sum("k").alias("k"))
    counts = counts.where((F.col("c") >= 0) | (F.col("k") >= max(8, -(-n // HOT_SHARE))))  # chunks: 256 values each
    hot: dict[int, list] = {}
    for r in counts.collect():
        if r.c >= 0:
            plan.freq[r.p][r.c][r.v] = r.k
        else:
            hot.setdefault(r.p, []).append((r.v, r.k))
    for p, got in hot.items():
        got.sort()
        plan.hot[p] = (np.array([v for v, _ in got], np.int64), np.array([float(k) for _, k in got]))
    return plan


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links a-b connect."""
    if not len(a):
        return a, b
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ix[: len(a)], ix[len(a) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        m = np.minimum(label[x], label[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
        np.minimum.at(low, label, low)  # the old root follows its members
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def bucket_links(key: np.ndarray, fp: np.ndarray, asks: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within runs of equal key (one sort key per bucket)."""
    a, b, held, d = [], [], 0, 1
    live = np.arange(len(key))
    while True:
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        x, y = live, live + d
        ok = (asks[x] | asks[y]) & (fp[x] != fp[y])
        x, y = x[ok], y[ok]
        ok = popcount(fp[x] ^ fp[y]) <= tau
        a.append(fp[x[ok]])
        b.append(fp[y[ok]])
        held += int(ok.sum())
        if held > 500_000:
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [u], [v], len(u)
        d += 1
    return forest(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints connected by pairs of tau or fewer differing bits.

    fps: distinct fp long. No pair within tau bits is lost; no group is emitted as all its pairs.
    """
    plan = make_plan(fps, tau)

    def probe(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                p, v, f, q = plan.rows(fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(v), pa.array(f), pa.array(q)], names=["p", "v", "fp", "asks"])

    rows = fps.select("fp").mapInArrow(probe, "p int, v long, fp long, asks boolean")
    big = rows.groupBy("p", "v").agg(F.count("*").alias("n"), F.max("asks").alias("any")).where(F.col("n") > BUCKET)
    big = cut(big.select(F.col("p").alias("bp"), F.col("v").alias("bv"), F.when(F.col("any"), F.ceil(F.col("n") * 2 / BUCKET)).otherwise(0).cast("int").alias("blocks")))
    dealt = rows.join(F.broadcast(big) if fits(big) else big, (F.col("p") == F.col("bp")) & (F.col("v") == F.col("bv")), "left").drop("bp", "bv")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(mine, x).alias("i"), F.greatest(mine, x).alias("j")))
    dealt = dealt.where("blocks IS NULL OR blocks > 0").withColumn("ij", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    dealt = dealt.select("p", "v", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "fp", "asks")

    def verify(batches):
        rest = None
        for b in _last(batches):
            cols = None if b is None else [b.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            if rest is not None:
                cols = rest if cols is None else [np.concatenate(x) for x in zip(rest, cols)]
            rest = None
            if cols is None or not len(cols[0]):
                continue
            p, v, i, j, fp, asks = cols
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            end = len(p) if b is None else int(np.nonzero(new)[0][-1])  # the last bucket may go on in the next batch
            if end < len(p):
                rest = [c[end:] for c in cols]
            x, y = bucket_links(np.cumsum(new)[:end], fp[:end], asks[:end], tau)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["src", "dst"])

    keys = ["p", "v", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "src long, dst long").distinct()


def _last(batches):
    yield from batches
    yield None


def fingerprint_components(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """fps: (fp, id) rows of any number a fingerprint -> (fp, component_id): the smallest id reachable, a row a fingerprint."""
    each = cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    comp = connected_components(links(each, tau))
    tied = each.join(comp, each.fp == comp.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    low = tied.groupBy("root").agg(F.min("id").alias("component_id"))
    return tied.join(low, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tau: int = TAU) -> DataFrame:
    """The kept columns (default: the id) with fingerprint and component_id (columns of these names are replaced), one row an
    input row.

    Null and empty texts have fingerprint zero, linked like any other. Null ids link but never name a component: a component
    of null ids only has a null component_id. Repeated rows come out repeated; an empty table gives an empty result.
    """
    keep = [id_col] if keep is None else [c for c in keep if c not in ("fingerprint", "component_id")]
    (fp,) = fresh(docs, "fp")
    got = cut(with_fingerprint(docs, text_col, keep, fp))
    comp = fingerprint_components(got.select(F.col(fp).alias("fp"), F.col(id_col).alias("id")), tau).withColumnRenamed("fp", fp)
    # A large group of exact copies is one fingerprint: broadcast or salted, it is not one task.
    (c_,) = fresh(got, "component_of")
    out = lookup_join(got, comp.withColumnRenamed("component_id", c_), [fp])
    return out.select(*keep, F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), F.col(c_).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """docs with one row of each group: the one of the smallest id, null ids last, equal ids by a hash of the text.

    Equal rows count as one. Only ids, hashes and fingerprints take part in the search; whole rows are shuffled once.
    """
    k_id, k_text = fresh(docs, "key_id", "key_text")
    keyed = docs.withColumn(k_id, F.col(id_col)).withColumn(k_text, F.coalesce(F.xxhash64(text_col), F.lit(0)))
    got = cut(with_fingerprint(keyed, text_col, [k_id, k_text], "fp"))
    each = cut(got.groupBy("fp").agg(F.min(F.struct(F.col(k_id).isNull().alias("n"), F.col(k_id).alias("id"), F.col(k_text).alias("t"))).alias("first")))
    comp = connected_components(links(each, tau))
    tied = each.join(comp, each.fp == comp.node, "left").select("first", F.coalesce("component", "fp").alias("root"))
    stay = cut(tied.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.id").alias(k_id), F.col("f.t").alias(k_text)))
    return lookup_join(keyed, stay, [k_id, k_text], "left_semi").dropDuplicates([k_id, k_text]).select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
