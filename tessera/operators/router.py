"""Ridge router: one pass for moments, a small solve on the driver, prediction as a projection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from math import isfinite

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("top1_disagreement", "jaccard10", "jaccard20", "rank_overlap", "coherence", "log_words", "margin")


@dataclass(frozen=True)
class Ridge:
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    alpha: float
    rows: int

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, c in zip(FEATURES, self.means, self.scales, self.coefficients):
            out = out + (F.col(f) - m) / s * c
        return out

    def __post_init__(self):
        sizes = {len(self.means), len(self.scales), len(self.coefficients)}
        numbers = [*self.means, *self.scales, *self.coefficients, self.intercept, self.alpha]
        if sizes != {len(FEATURES)} or not all(map(isfinite, numbers)) or min(self.scales) <= 0 or self.alpha < 0:
            raise ValueError("a mean, positive scale and coefficient for each feature, all finite, and alpha >= 0 are needed")

    def to_json(self) -> str:
        return json.dumps({"features": FEATURES, **asdict(self)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Ridge:
        """Raises where the features are others, or in another order, than this module's."""
        values = json.loads(text)
        if tuple(values.pop("features", ())) != FEATURES:
            raise ValueError(f"a model of the features {FEATURES} is expected")
        return Ridge(**{f.name: tuple(values[f.name]) if isinstance(values[f.name], list) else values[f.name] for f in fields(Ridge)})


# The published router that decides the utility policies, in the order of FEATURES.
PUBLISHED = Ridge(
    means=(0.7233333333333334, 0.17455083616074404, 0.15648568826096998, 0.17296583628083034, 0.5638050844305434, 3.491505508892485, 0.0544823800558758),
    scales=(0.4473502232280897, 0.16446614926757744, 0.13511600985619635, 0.14284382718927002, 0.07827859901113421, 0.6343628659567867, 0.07018145210253492),
    coefficients=(0.0321728465882785, -0.016737271835451793, 0.007997653786804212, 0.02150994825051749, 0.01330148273932769, -0.02846241371642559, 0.003969206636099704),
    intercept=0.01581750312354722,
    alpha=10.0,
    rows=300,
)
#: Its thresholds, by the share of queries that a budget lets through.
PUBLISHED_THRESHOLDS = {0.25: 0.04356274839116504, 0.5: 0.010931372232104553, 0.75: -0.01178292867029655}


def fit(df: DataFrame, target: str, alpha: float = 10.0) -> Ridge:
    """Features scaled by population deviation (1 where it is at most 1e-12); the intercept, the target's mean, is not penalised.

    Raises for fewer than two rows, and for targets that are null or outside -1 .. 1.
    """
    cols = [*FEATURES, target]
    first = df.agg(F.count("*").alias("n"), F.count_if(F.col(target).isNull() | F.isnan(target) | (F.abs(target) > 1)).alias("odd"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if first.n < 2:
        raise ValueError("two rows at least")
    if first.odd:
        raise ValueError(f"{first.odd} targets outside -1 .. 1")
    m = [first[f"m{i}"] for i in range(len(cols))]
    d = [F.col(c) - v for c, v in zip(cols, m)]
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(cols))]
    second = df.agg(*[F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    k = len(FEATURES)
    gram, cross = np.zeros((k, k)), np.zeros(k)
    for i, j in pairs:
        if j < k:
            gram[i, j] = gram[j, i] = second[f"s{i}_{j}"]
        else:
            cross[i] = second[f"s{i}_{j}"]
    scale = np.sqrt(np.diag(gram) / first.n)
    scale[scale <= 1e-12] = 1
    w = np.linalg.solve(gram / np.outer(scale, scale) + alpha * np.eye(k), cross / scale)
    return Ridge(tuple(m[:k]), tuple(scale), tuple(w), float(m[k]), float(alpha), first.n)
