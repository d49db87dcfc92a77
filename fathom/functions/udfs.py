"""What has no built-in counterpart, over small aggregated tables or per row in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _tail(x: int, n: int, p: float) -> float:
    """P(X >= x) for a binomial."""
    if p <= 0:
        return 1.0 if x <= 0 else 0.0
    if p >= 1:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x, n + 1)]
    return math.fsum(map(math.exp, log))


def _solve(x: int, n: int, target: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tail(x, n, mid) < target else (lo, mid)
    return (lo + hi) / 2


def interval(x: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact two-sided binomial interval by bisection of the tails; no trials give (0, 1)."""
    if n == 0:
        return 0.0, 1.0
    half = (1 - confidence) / 2
    return (0.0 if x == 0 else _solve(x, n, half)), (1.0 if x == n else _solve(x + 1, n, 1 - half))


def binomial_interval():
    """A column function of successes and trials: their 95 % interval."""

    @F.pandas_udf("struct<low double, high double>")
    def both(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([interval(int(a), int(b)) for a, b in zip(x, n, strict=True)], columns=["low", "high"])

    return both


def positions(seeds: np.ndarray, count: int) -> np.ndarray:
    """count fractions in [0, 1) per seed from the SplitMix64 stream. Its three constants are fixed values."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64)
        z = seeds.astype(np.uint64)[:, None] + steps * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(2**53)


def sample_fractions(count: int):
    """A column function: the first ``count`` (at least 1) challenge positions of a bigint seed."""

    @F.pandas_udf("array<double>")
    def fractions(seeds: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in seeds:
            yield pd.Series(list(positions(s.to_numpy(np.int64).view(np.uint64), max(1, count))))

    return fractions
