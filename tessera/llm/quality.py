"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the logit of a classifier on its style; hosts and the paths below them get beta posteriors
from grouped sums over all documents, sparse sites shrinking toward the host and hosts toward the global prior. A labelled
document counts there with its label, any other with its classifier's probability. The posterior log-odds are the document's,
moved from the global prior to its path's, where the document's own share is left out, so that no evidence counts twice.
Toxicity is judged by the document's words alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, fresh, table
from tessera.plans.lineage import cut, stored
from tessera.plans.skew import lookup_join

#: Bound of the labelled sample that the two classifiers are fitted on.
TRAIN_ROWS = 12_000
#: Logit of good and of not toxic where no label says anything, so that such documents stay.
UNLABELLED = 3.0
#: Stands for an endless prior strength: groups that vary no more than chance would have it take their parent's rate.
POOLED = 1e12
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PLAIN = bytes(range(97, 123)) + _UPPER + _DIGIT + b" \t\r\n\x0b\x0c.,;:'\"()-?" + bytes(range(128, 256))
_BLOCK = 1 << 20


def style(text: bytes) -> list[float]:
    """Shares of capitals, odd symbols, digits; repeated words; compressibility; lengths. Whole text, a block at a time."""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * 9
    size, z = 0, zlib.compressobj(1)
    for at in range(0, n, _BLOCK):
        size += len(z.compress(text[at : at + _BLOCK]))
    size += len(z.flush())
    upper, odd, digits = (n - len(text.translate(None, x)) for x in (_UPPER, b"", _DIGIT))
    odd = len(text.translate(None, _PLAIN))
    again = sum(map(bytes.__eq__, words, words[1:])) / k
    marked = sum(1 for w in words if w[-1] in b"!%$#*&@|") / k
    return [upper / n, odd / n, digits / n, again, marked, size / n, np.log1p(k) / 5, (n / k) / 10, len(set(words)) / k]


@dataclass
class Head:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w + self.b


@dataclass
class Model:
    quality: Head
    toxic: Head
    lexicon: dict[bytes, float] = field(default_factory=dict)

    def features(self, text: bytes | None) -> tuple[list[float], list[float]]:
        """Of the style; and of the lexicon: its words' odds and their number, which level off, and their share."""
        text = text or b""
        lex, hits, total, words = self.lexicon, 0, 0.0, ()
        if lex:
            words = set(text.lower().translate(_PUNCT).split())
            for w in words:
                if w in lex:
                    hits += 1
                    total += lex[w]
        return style(text), [float(np.sign(total) * np.log1p(abs(total))), float(np.log1p(hits)), hits / max(len(words), 1)]

    def logits(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.features(t) for t in texts]
        q, t = np.array([g[0] for g in got]).reshape(len(got), 9), np.array([g[1] for g in got]).reshape(len(got), 3)
        return self.quality.logit(q), self.toxic.logit(t)


_PUNCT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def constant(d: int, b: float) -> Head:
    return Head(np.zeros(d), np.ones(d), np.zeros(d), b)


def fit_head(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> Head:
    """Newton steps on the ridge-penalised likelihood; without rows of both kinds, the smoothed log-odds alone."""
    d = x.shape[1] if x.ndim == 2 else 0
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = constant(d, float(np.log(rate / (1 - rate))))
    if len(y) < 4 or y.min() == y.max():
        return base
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, pen = np.zeros(d + 1), np.diag([*[ridge * len(x)] * d, 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - pen @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen + 1e-6 * np.eye(d + 1), g)
        w += step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-8:
            break
    return Head(mean, scale, w[:d], float(w[d]))


def one_label(labels: DataFrame, id_col: str) -> DataFrame:
    """(lid, quality, toxic): a row an id; of several labels the lowest quality and the highest toxicity hold."""
    lab = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return lab.where("quality IS NOT NULL OR toxic IS NOT NULL")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = TRAIN_ROWS) -> Model:
    """Fit both classifiers on at most n labelled documents, chosen by a hash of the id.

    Null labels are not used. Of several rows of an id, the one whose text has the smallest hash is taken, so that no more
    than n reach the driver; only their features do. Without labels, or without labelled documents, both heads are constant.
    """
    lab = one_label(labels, id_col).orderBy(F.xxhash64("lid"), "lid").limit(n)
    pick = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), F.col("id") == F.col("lid"))
    pick = pick.groupBy("lid").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    pick = cut(pick.select("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")))
    word = F.explode(F.array_distinct(F.filter(F.split(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")))
    per = pick.where("toxic IS NOT NULL").select(word.alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    totals = pick.where("toxic IS NOT NULL").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    lexicon = {}
    if 0 < totals.t < totals.n:
        base = totals.t / totals.n
        z = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
        odds = F.log((F.col("t") + 0.1) / (F.col("n") - F.col("t") + 0.1)) - float(np.log(base / (1 - base)))
        # Words of a hundredth of the toxic texts that come mostly with these, beyond what chance would give among so many words:
        # no more than a hundred times the distinct words of a mean toxic text of the sample.
        found = per.where((F.col("t") >= max(5, totals.t / 100)) & (F.col("t") * 2 > F.col("n"))).select("w", z.alias("z"), odds.alias("o")).where("z > 5")
        lexicon = {r.w.encode(): float(r.o) for r in found.collect()}
    m = Model(constant(9, UNLABELLED), constant(3, -UNLABELLED), lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [m.features(t.as_py()) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] + x[1] for x in got], pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "quality", "toxic"])

    rows = pick.mapInArrow(run, "x array<double>, quality int, toxic int").collect()
    rows.sort(key=lambda r: tuple(r.x))
    x = np.array([r.x for r in rows]).reshape(len(rows), 12)
    q, t = (np.array([r[c] is not None for r in rows], bool) for c in ("quality", "toxic"))
    if q.any():
        m.quality = fit_head(x[q, :9], np.array([r.quality for r in rows if r.quality is not None], float))
    if t.any():
        m.toxic = fit_head(x[t, 9:], np.array([r.toxic for r in rows if r.toxic is not None], float))
    return m


def score(docs: DataFrame, model: Model, text_col: str, keep: list[str], names: tuple[str, str]) -> DataFrame:
    """keep columns and the two logits. Null and empty texts score as texts without words; an empty table gives an empty result."""
    (t_,) = fresh(docs, "scored_text")
    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, t = model.logits(x.as_py() for x in b.column(b.num_columns - 1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q), pa.array(t)], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias(t_)).mapInArrow(run, schema)


def strength(mean: str, level: str, n: str) -> Column:
    """Prior strength of a beta around `mean` by the method of moments over groups: total variance less the binomial's share."""
    var = F.sum(F.col(n) * (F.col(level) - F.col(mean)) ** 2) / F.sum(n)
    unit = F.sum(F.col(n) * F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    excess = var - unit * F.count("*") / F.sum(n)
    return F.when(excess > unit / POOLED, F.greatest(unit / excess - 1, F.lit(0.0))).otherwise(POOLED)


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """scored: (host, path, p) -> (host, path, s, n, hs, hn), a row a path: sums of p and counts of the path and of its host;
    and mu, the global rate, with m1 and m2, the prior strengths of hosts around it and of paths around their hosts."""
    paths = cut(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").cast("double").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    if not total.n:
        return paths.withColumn("hs", F.col("s")).withColumn("hn", F.col("n")), {"mu": 0.5, "m1": POOLED, "m2": POOLED}
    mu = min(max(round(total.s / total.n, 9), 1e-3), 1 - 1e-3)
    m1 = round(hosts.withColumn("mu", F.lit(mu)).withColumn("r", F.col("hs") / F.col("hn")).agg(strength("mu", "r", "hn").alias("m")).first().m, 6)
    both = cut(lookup_join(paths, hosts, ["host"]))
    rates = both.withColumn("host_rate", (F.col("hs") + m1 * mu) / (F.col("hn") + m1)).withColumn("r", F.col("s") / F.col("n"))
    m2 = round(rates.agg(strength("host_rate", "r", "n").alias("m")).first().m, 6)
    return both, {"mu": mu, "m1": m1, "m2": m2}


def without(own: Column | float, s: str, n: str, m: float, parent: Column | float) -> Column:
    """Posterior mean of a site's rate, the document's own share left out; the parent's where nothing else says anything."""
    left = F.greatest(F.col(n) - 1 + m, F.lit(0.0))
    return F.when(left > 0, (F.greatest(F.col(s) - own, F.lit(0.0)) + m * parent) / left).otherwise(parent)


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5, n: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) with p_document, host_rate, path_rate, p_quality, p_toxic and keep added (columns of
    these names are replaced).

    keep: p_quality >= cutoff and p_toxic < cutoff. host_rate and path_rate are the posterior means for the document's site
    without the document itself. Null and empty texts score as texts without words; null hosts and paths are sites like any
    other; repeated rows get equal results; an empty table gives an empty result. Without labels the document evidence is the
    same for all and everything is kept. Texts are scored twice where they are kept, which costs less than to store or shuffle
    them; without them the scores are stored and everything is scored once.
    """
    docs = docs.drop("p_document", "host_rate", "path_rate", "p_quality", "p_toxic", "keep")
    keep = docs.columns if keep is None else keep
    model = fit(docs, labels, id_col, text_col, n)
    ql, tl, h_, p_, i_, own, y_, hr, pr = fresh(docs.columns + ["s", "n", "hs", "hn", "quality"], "quality_logit", "toxic_logit", "site_host", "site_path", "label_id", "own_share", "label_quality", "rate_of_host", "rate_of_path")
    squash = lambda c: 1 / (1 + F.exp(-c))
    keyed = docs.withColumn(h_, F.col(host_col)).withColumn(p_, F.col(path_col)).withColumn(i_, F.col(id_col))
    kept = list(dict.fromkeys([*keep, h_, p_, i_]))
    scored = score(keyed, model, text_col, kept, (ql, tl))
    if text_col not in keep:
        scored = stored(scored, "scores")[0]
    lab = one_label(labels, id_col).where("quality IS NOT NULL").select(F.col("lid").alias(i_), F.col("quality").cast("double").alias(y_))
    lab = cut(lab)
    labelled = lookup_join(scored, lab, [i_], "left").withColumn(own, F.coalesce(y_, squash(F.col(ql)))).drop(y_)
    sums, at = site_sums(labelled.select(F.col(h_).alias("host"), F.col(p_).alias("path"), F.col(own).alias("p")))
    names = fresh(labelled, "site_s", "site_n", "site_hs", "site_hn")
    out = lookup_join(labelled, sums.select(F.col("host").alias(h_), F.col("path").alias(p_), *[F.col(c).alias(x) for c, x in zip(("s", "n", "hs", "hn"), names)]), [h_, p_])
    s_, n_, hs_, hn_ = names
    out = out.withColumn(hr, F.round(without(F.col(own), hs_, hn_, at["m1"], F.lit(at["mu"])), 6))
    out = out.withColumn(pr, F.round(without(F.col(own), s_, n_, at["m2"], F.col(hr)), 6))
    held = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(pr)))
    moved = F.col(ql) - float(np.log(at["mu"] / (1 - at["mu"]))) + F.log(held / (1 - held))
    out = out.select(*keep, squash(F.col(ql)).alias("p_document"), F.col(hr).alias("host_rate"), F.col(pr).alias("path_rate"), squash(moved).alias("p_quality"), squash(F.col(tl)).alias("p_toxic"))
    return out.withColumn("keep", (F.col("p_quality") >= cutoff) & (F.col("p_toxic") < cutoff))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", *[F.round(c, 6).alias(c) for c in ("p_document", "host_rate", "path_rate", "p_quality", "p_toxic")], "keep")
