"""Statistics beyond Spark's own: proportion intervals, risk differences, quantile types, Fisher's test."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def qbeta(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of the beta distribution, by bisection to the last bit."""
    a, b = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(70):
        middle = (low + high) / 2
        small = betainc(a, b, middle) < p
        low, high = np.where(small, middle, low), np.where(small, high, middle)
    return (low + high) / 2


def proportion_ci_values(x: np.ndarray, n: np.ndarray, method: str = "clopper_pearson", level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Interval of a proportion; NaN where n is 0 or missing."""
    x, n = np.asarray(x, dtype=float), np.asarray(n, dtype=float)
    out = np.full((2, *x.shape), np.nan)
    ok = ~np.isnan(x) & ~np.isnan(n) & (n > 0)
    if not ok.any():
        return out[0], out[1]
    k, m, tail = x[ok], n[ok], (1 - level) / 2
    z = NormalDist().inv_cdf(1 - tail)
    if method in ("clopper_pearson", "jeffreys"):
        add = 0.0 if method == "clopper_pearson" else 0.5
        one = 1.0 if method == "clopper_pearson" else 0.5
        low = np.where(k <= 0, 0.0, qbeta(tail, np.maximum(k + add, 1e-9), m - k + one))
        high = np.where(k >= m, 1.0, qbeta(1 - tail, k + one, np.maximum(m - k + add, 1e-9)))
    elif method == "wilson":
        p, d = k / m, 1 + z * z / m
        half = z * np.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
        low, high = (p + z * z / (2 * m)) / d - half, (p + z * z / (2 * m)) / d + half
    elif method == "wald":
        p = k / m
        half = z * np.sqrt(p * (1 - p) / m)
        low, high = p - half, p + half
    elif method == "agresti_coull":
        m2 = m + z * z
        p = (k + z * z / 2) / m2
        half = z * np.sqrt(p * (1 - p) / m2)
        low, high = p - half, p + half
    else:
        raise ValueError(f"Unknown ci method: {method}")
    out[0][ok], out[1][ok] = np.clip(low, 0, 1), np.clip(high, 0, 1)
    return out[0], out[1]


def proportion_ci(x: Column, n: Column, method: str = "clopper_pearson", level: float = 0.95) -> tuple[Column, Column]:
    """The interval as two columns: closed forms natively, the exact and Jeffreys intervals over Arrow batches."""
    x, n = x.cast("double"), n.cast("double")
    usable = n > 0
    if method in ("wilson", "wald", "agresti_coull"):
        z = NormalDist().inv_cdf(1 - (1 - level) / 2)
        zz = F.lit(z * z)
        n = F.when(usable, n)
        p = x / n
        if method == "wilson":
            middle = (p + zz / (n * 2)) / (zz / n + 1)
            half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (n * n * 4)) / (zz / n + 1)
        elif method == "wald":
            middle, half = p, F.lit(z) * F.sqrt(p * (1 - p) / n)
        else:
            middle = (x + zz / 2) / (n + zz)
            half = F.lit(z) * F.sqrt(middle * (1 - middle) / (n + zz))
        return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))

    def end(which: int):
        @F.pandas_udf("double")
        def bound(k: pd.Series, m: pd.Series) -> pd.Series:
            values = proportion_ci_values(k.to_numpy(dtype=float), m.to_numpy(dtype=float), method, level)[which]
            return pd.Series(values).where(~np.isnan(values), None)

        return bound(x, n)

    return end(0), end(1)


def risk_difference(n1: Column, t1: Column, n2: Column, t2: Column, level: float = 0.95) -> dict[str, Column]:
    """Percent scale difference, its interval, and the p-value of the two-sample test without correction."""
    ok = (t1 > 0) & (t2 > 0) & (n1 <= t1) & (n2 <= t2)
    a, b = (F.when(ok, x.cast("double")) for x in (t1, t2))
    p, q = n1.cast("double") / a, n2.cast("double") / b
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    half = F.lit(z) * F.sqrt(p * (1 - p) / a + q * (1 - q) / b)
    pooled = (n1 + n2).cast("double") / (a + b)
    spread = pooled * (1 - pooled) * (F.lit(1.0) / a + F.lit(1.0) / b)
    chi = F.when(spread > 0, (p - q) * (p - q) / spread)

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(v / 2)))

    return {
        "rdiff": (p - q) * 100,
        "lower": F.greatest(p - q - half, F.lit(-1.0)) * 100,
        "upper": F.least(p - q + half, F.lit(1.0)) * 100,
        "p_value": tail(chi),
    }


def quantile_places(n: Column, p: float, kind: int) -> tuple[Column, Column]:
    """For a sample quantile of Hyndman and Fan's types 1 to 9: j, and the share of the value after the j-th smallest."""
    n = n.cast("double")
    if kind <= 3:
        np_ = n * p - (0.5 if kind == 3 else 0.0)
        j = F.floor(np_ + 4e-15)
        return j, F.when(np_ - j > 1e-14, 1.0).otherwise({1: F.lit(0.0), 2: F.lit(0.5), 3: F.when(j % 2 == 0, 0.0).otherwise(1.0)}[kind])
    a, b = {4: (0, 1), 5: (0.5, 0.5), 6: (0, 0), 7: (1, 1), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
    np_ = a + p * (n + 1 - a - b)
    j = F.floor(np_ + 4e-15)
    return j, F.when(F.abs(np_ - j) < 4e-15, 0.0).otherwise(np_ - j)


def quantile(value: Column, p: float, kind: int = 7) -> Column:
    """A quantile as one aggregate; types other than 7 hold the values of a group in a row, so it is for small groups."""
    if kind == 7:
        return F.percentile(value, p)
    v = F.sort_array(F.collect_list(value))
    j, step = quantile_places(F.size(v), p, kind)

    def at(k: Column) -> Column:
        return F.get(v, (F.least(F.greatest(k, F.lit(1)), F.size(v)) - 1).cast("int"))

    return F.when(F.size(v) > 0, at(j) * (1 - step) + at(j + 1) * step)


def fisher_exact_2x2(table) -> float:
    """Two-sided p-value of a 2x2 table: the sum of all hypergeometric probabilities up to the observed one, from logarithms."""
    (a, b), (c, d) = ((int(x) for x in row) for row in table)
    row, column, total = a + b, a + c, a + b + c + d

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    least, most = max(0, row + column - total), min(row, column)
    logs = {k: ways(column, k) + ways(total - column, row - k) for k in range(least, most + 1)}
    top, own = max(logs.values()), logs[a] + 1e-7
    part = math.fsum(math.exp(x - top) for x in logs.values() if x <= own)
    return min(1.0, part / math.fsum(math.exp(x - top) for x in logs.values()))
