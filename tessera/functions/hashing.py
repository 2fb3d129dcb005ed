"""Hashed counts of terms, for use inside of workers."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Mapping
from functools import cache

import numpy as np
import pyarrow as pa

DIM = 64


class Slots(dict):
    """A term's component, from its MD5, as the place 2 i for sign 1 and 2 i + 1 for sign -1; the last ones asked for are remembered."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = hashlib.md5(term).hexdigest()
        self[term] = found = int(h[:8], 16) % self.dim * 2 + (h[8] >= "8")
        return found


@cache
def slots_of(dim: int) -> Slots:
    """Those of the worker, which the tasks that it runs share."""
    return Slots(dim)


class Sums:
    """Signed counts by component, summed for many texts at once."""

    def __init__(self, dim: int):
        self.slots, self.places, self.counts, self.sizes = slots_of(dim), array("q"), array("q"), []

    def add(self, counts: Mapping[bytes, int]) -> None:
        self.places.extend(map(self.slots.__getitem__, counts))
        self.counts.extend(counts.values())
        self.sizes.append(len(counts))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """A row a text: its sums, and which components have terms."""
        n, dim = len(self.sizes), self.slots.dim
        place, count = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in (self.places, self.counts))
        cell = np.repeat(np.arange(n) * dim, self.sizes) + (place >> 1)
        sums = np.bincount(cell, np.where(place & 1, -count, count), n * dim)
        return sums.reshape(n, dim), np.bincount(cell, minlength=n * dim).reshape(n, dim) > 0


def unit_lists(x: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Rows as vectors of length 1, and the places of those that have one: rows of zeros have none."""
    at = np.flatnonzero(x.any(1))
    v = x[at] / np.sqrt((x[at] * x[at]).sum(1, keepdims=True))
    return at, pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(v.ravel()))
