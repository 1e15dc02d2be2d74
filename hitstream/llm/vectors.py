"""What the two vector operators share: which vectors take part, and seeded projections."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def length_of(vector: str = "embedding") -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@cache
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """n Gaussian directions."""
    return np.random.default_rng([seed, dim, n]).standard_normal((dim, n))


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, its signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
