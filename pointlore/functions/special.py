"""Distribution functions and the tiny solver (U1-U3): Arrow UDFs over one row per test or fit, never per sample."""

import functools
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def ks_p_asymptotic(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Kolmogorov's series, as a column expression."""
    en = F.sqrt(n * m / (n + m))
    t = en * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _ks_exact(d: float, n: int, m: int) -> float:
    """Share of lattice paths that leave the band of width d: path counting with a scale against overflow, a row at a time."""
    if n * m == 0:
        return float("nan")
    g = math.gcd(n, m)
    h = round(d * (n // g) * m)  # distance in units of 1 / lcm
    if h <= 0:
        return 1.0
    step_n, step_m = m // g, n // g
    inside, log_scale = np.zeros(m + 1), 0.0
    inside[: min(m, (h - 1) // step_m) + 1] = 1.0
    for i in range(1, n + 1):
        # The band of a row is a stretch of columns: a path reaches a column from below or along the row.
        lo, hi = max(0, (i * step_n - h) // step_m + 1), min(m, -((-i * step_n - h) // step_m) - 1)
        if lo > hi:
            return 1.0
        inside[:lo] = 0.0
        inside[lo : hi + 1] = np.cumsum(inside[lo : hi + 1])
        inside[hi + 1 :] = 0.0
        top = inside[lo : hi + 1].max()
        if top == 0:
            return 1.0
        if top > 1e200:
            inside /= top
            log_scale += math.log(top)
    if inside[m] == 0:
        return 1.0
    total = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(inside[m]) + log_scale - total)))


@F.pandas_udf(DoubleType())
def ks_p_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Two-sided exact p-value; falls back on the series beyond 10,000 values a side."""
    out = []
    for x, a, b in zip(d, n, m):
        if max(a, b) > 10_000:
            t = math.sqrt(a * b / (a + b)) * x
            out.append(min(1.0, max(0.0, sum((2.0 if k % 2 else -2.0) * math.exp(-2.0 * k * k * t * t) for k in range(1, 101)))) if t >= 0.2 else 1.0)
        else:
            out.append(_ks_exact(float(x), int(a), int(b)))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


@functools.lru_cache(maxsize=None)
def _signed_rank_counts(n: int) -> tuple[list[int], list[int]]:
    """In how many ways each sum, and each sum or less, arises from a subset of the ranks 1 .. n."""
    counts = [1]
    for rank in range(1, n + 1):
        more = counts + [0] * rank
        for i, c in enumerate(counts):
            more[i + rank] += c
        counts = more
    return counts, list(itertools.accumulate(counts))


@F.pandas_udf(DoubleType())
def signed_rank_p_exact(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of the lesser sum of ranks ``w`` of ``n`` (50 or fewer) untied differences; null where ``w`` is."""
    return pd.Series([None if pd.isna(x) else min(1.0, 2 * _signed_rank_counts(int(k))[1][int(x)] / (1 << int(k))) for x, k in zip(w, n)], dtype="float64")


def _rank_sum_tail(u: int, n: int, m: int) -> int:
    """In how many of the orders of n and m untied values at most ``u`` pairs are the wrong way round, n <= m.

    By the two-index recurrence over sizes, N(n, m, u) = N(n - 1, m, u - m) + N(n, m - 1, u), whose sum over m is a product: the
    counts of n parts of at most m each. A part of k columns more is a running sum with stride k, the bound m takes shifted counts off.
    """
    top = u + 1
    counts = np.zeros(top, dtype=object)
    counts[0] = 1
    for k in range(1, n + 1):
        pad = -top % k
        counts = np.cumsum(np.concatenate([counts, np.zeros(pad, dtype=object)]).reshape(-1, k), axis=0).ravel()[:top]
        if m + k < top:
            counts[m + k :] -= counts[: top - m - k].copy()
    return int(counts.sum())


@functools.lru_cache(maxsize=100_000)
def _rank_sum_p(u: int, n: int, m: int) -> float:
    return min(1.0, 2 * _rank_sum_tail(u, n, m) / math.comb(n + m, n))


@F.pandas_udf(DoubleType())
def rank_sum_p_exact(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Two-sided p-value of the lesser U of untied samples of ``n`` and ``m`` values; null where ``u`` is."""
    return pd.Series([None if pd.isna(x) else _rank_sum_p(int(x), int(min(a, b)), int(max(a, b))) for x, a, b in zip(u, n, m)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda x: None if pd.isna(x) else NormalDist().inv_cdf(min(max(x, 1e-300), 1 - 1e-16)))


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = lambda v: v if abs(v) > 1e-300 else 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for k in range(300):
        m = k // 2
        if k == 0:
            num = 1.0
        elif k % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / tiny(1.0 + num * d)
        c = tiny(1.0 + num / c)
        f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * (f - 1.0)


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(v) else _beta_tail(v / (v + x * x), v / 2, 0.5) for x, v in zip(t, df)], dtype="float64")


def nnls_small(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients from normal equations of a few columns: the best feasible active set."""
    k = len(right)
    best, best_value = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for active in itertools.combinations(range(k), size):
            idx = list(active)
            c = np.linalg.lstsq(gram[np.ix_(idx, idx)], right[idx], rcond=None)[0]
            if (c < -1e-12).any():
                continue
            c = np.maximum(c, 0)
            value = c @ gram[np.ix_(idx, idx)] @ c - 2 * c @ right[idx]  # RSS less a constant
            if value < best_value - 1e-15:
                best, best_value = np.zeros(k), value
                best[idx] = c
    return best


@F.pandas_udf(ArrayType(DoubleType()))
def nnls(gram: pd.Series, right: pd.Series) -> pd.Series:
    """Gram is the flattened k x k matrix of sums of products, right the k sums with the target."""
    return pd.Series([nnls_small(np.asarray(g, float).reshape(len(r), len(r)), np.asarray(r, float)).tolist() for g, r in zip(gram, right)])
