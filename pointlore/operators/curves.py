"""Grids, empirical distributions, densities, interpolation (D). Curves are long: keys, i, x, y."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.storage import running_before
from ..model import RATIO_FLOOR, STD_FLOOR


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of every key, exact, in two scans: a mergeable sketch brackets each, then the values in the brackets are counted.

    The sketch errs by a 10,000th of the ranks at most, and a bracket is five times as wide on either side; keys of up to 20,000
    values are bracketed by all of them. So no task holds the distinct values of a large key. ``at``: name -> share.
    """
    v = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ranks = [r for q in at.values() for r in (max(0.0, q - 5e-4), min(1.0, q + 5e-4))]
    ends = v.groupBy(*keys).agg(F.percentile_approx("_v", ranks, 10_000).alias("_e"), F.count("_v").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    few = F.col("_n") <= 20_000
    bracket = lambda k, q: F.struct(F.lit(k).alias("k"), F.lit(q).alias("q"), F.when(few, F.col("_a")).otherwise(F.col("_e")[2 * k]).alias("lo"), F.when(few, F.col("_z")).otherwise(F.col("_e")[2 * k + 1]).alias("hi"))
    ends = ends.select(*keys, "_n", F.explode(F.array(*[bracket(k, q) for k, q in enumerate(at.values())])).alias("_b"))
    near = v.join(_small(ends, keys), keys).filter("_v <= _b.hi").groupBy(*keys, F.col("_b.k").alias("_k"), F.col("_b.q").alias("_q"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    # What lies below a bracket is one row without a value, which comes first.
    so_far = F.sum("_c").over(W.partitionBy(*keys, "_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("_q") * (F.col("_n") - 1)
    first = lambda rank: F.min(F.when(F.col("_cum") > rank, F.col("_v")))
    g = near.withColumn("_cum", so_far).groupBy(*keys, "_k").agg(first(F.floor(place)).alias("_l"), first(F.ceil(place)).alias("_r"), F.max(place - F.floor(place)).alias("_f"))
    # Between equal neighbours this is their value itself, to the last bit.
    found = F.col("_l") + (F.col("_r") - F.col("_l")) * F.col("_f")
    return g.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, found)).alias(name) for k, name in enumerate(at)])


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """One of ``exact_quantiles``."""
    return exact_quantiles(df, keys, value, {out: q})


def r_grid(samples: DataFrame, keys: list[str], n: int | None = None, bin_width: float | None = None, eps: float = 1e-9) -> DataFrame:
    """Grid from 0 to 1.05 times the 99.5 % point of each key: keys, i, x, x0, step. One row a key before the explode.

    With ``bin_width`` the ends lie half a bin outside and the step is near the width, not equal to it.
    """
    top = samples.select(*keys).distinct().join(exact_quantile(samples, keys, "value", 0.995, "_p"), keys, "left")
    vmax = F.greatest(F.col("_p"), F.lit(eps)) * 1.05
    if bin_width is None:
        count, x0, x1 = F.lit(n), F.lit(0.0), F.when(F.col("_p").isNull(), 1.0).otherwise(vmax)
    else:
        count = F.when(F.col("_p").isNull(), n or 2).otherwise(F.floor(vmax / bin_width).cast("int") + 2)
        x0, x1 = F.lit(-bin_width / 2), vmax + bin_width / 2
        x0, x1 = F.when(F.col("_p").isNull(), 0.0).otherwise(x0), F.when(F.col("_p").isNull(), 1.0).otherwise(x1)
    return _grid(top.select(*keys, count.cast("int").alias("n"), x0.alias("x0"), x1.alias("x1")), keys)


def fixed_grid(df: DataFrame, keys: list[str], lo: float, hi: float, width: float, style: str = "pdf") -> DataFrame:
    """The same grid for every key, from limits: points on the limits (pdf), or bin centres (occupancy)."""
    if style == "pdf":
        n, a, b = int((hi - lo) / width) + 1, lo, hi
    else:
        n = max(1, round((hi - lo) / width))
        half = (hi - lo) / n / 2
        a, b = lo + half, hi - half
    return _grid(df.select(*keys).distinct().select(*keys, F.lit(n).alias("n"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")), keys)


def _small(df: DataFrame, keys: list[str]) -> DataFrame:
    """Grids per measure or mode are tiny and broadcast; those per cell grow with the cells and are left to the planner."""
    return F.broadcast(df) if set(keys) <= {"measure", "mode"} else df


def _grid(ends: DataFrame, keys: list[str]) -> DataFrame:
    step = F.when(F.col("n") > 1, (F.col("x1") - F.col("x0")) / (F.col("n") - 1)).otherwise(0.0)
    g = ends.withColumn("step", step).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return g.select(*keys, "i", (F.col("x0") + F.col("i") * F.col("step")).alias("x"), "x0", "step", "n")


def _ends(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.filter("i = 0").select(*keys, "x0", "step", "n")


def _index_below(value: Column, x0: Column, step: Column) -> Column:
    """Largest i with x0 + i * step <= value: the quotient, put right by one where rounding misled it."""
    i = F.when(step > 0, F.floor((value - x0) / step)).otherwise(F.when(value >= x0, F.lit(0)).otherwise(F.lit(-1))).cast("long")
    return F.when(x0 + (i + 1) * step <= value, i + 1).when(x0 + i * step > value, i - 1).otherwise(i)


def histogram(samples: DataFrame, grid: DataFrame, sample_keys: list[str], grid_keys: list[str], width: float | None = None) -> DataFrame:
    """Counts on the edges x - w/2 of every grid point and x + w/2 of the last; half-open bins, the last one closed, outside dropped.

    Bins are found by arithmetic, and a sample's counts are one row, as long as its grid: no product of samples and grid, and no join
    of the points. Every group of samples gets every grid point; one with a null among its keys counts nothing.
    """
    ends = _ends(grid, grid_keys)
    w = F.lit(width) if width is not None else F.col("step")
    s = samples.join(_small(ends, grid_keys), grid_keys) if grid_keys else samples.crossJoin(F.broadcast(ends))
    s = s.withColumn("_i", _index_below(F.col("value"), F.col("x0") - w / 2, F.col("step")))
    last = F.col("n") - 1
    top = F.col("x0") + last * F.col("step") + w / 2
    # The last bin ends half a width beyond its point, which is before the next edge where the step is wider.
    s = s.withColumn("_i", F.when(F.col("_i") < last, F.col("_i")).when(F.col("value") <= top, last))
    for k in sample_keys:
        s = s.withColumn("_i", F.when(F.col(k).isNotNull(), F.col("_i")))
    inside = F.when(F.col("_i") >= 0, F.col("_i")).cast("int")
    counted = s.groupBy(*sample_keys, inside.alias("i")).agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("x0", "step", "n")])
    # Values outside have no place but keep their sample.
    listed = lambda c: F.collect_list(F.when(F.col("i").isNotNull(), F.col(c)))
    packed = counted.groupBy(*sample_keys).agg(listed("i").alias("_at"), listed("_c").alias("_k"), *[F.first(c).alias(c) for c in ("x0", "step", "n")])
    laid = packed.select(*sample_keys, "x0", "step", F.posexplode(_counts("_at", "_k", "n")).alias("i", "y"))
    return laid.select(*sample_keys, "i", (F.col("x0") + F.col("i") * F.col("step")).alias("x"), "y")


@F.pandas_udf(ArrayType(DoubleType()))
def _counts(at: pd.Series, counts: pd.Series, n: pd.Series) -> pd.Series:
    """A sample's counts at each of its n points."""
    return pd.Series([np.bincount(a, weights=c, minlength=m) if len(a) else np.zeros(m) for a, c, m in zip(at, counts, n)])


def trapezoids(curves: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Area between each point and the next one (null at the last)."""
    by = W.partitionBy(*keys).orderBy("i")
    return curves.withColumn("_area", (F.lead("x").over(by) - F.col("x")) * (F.col(y) + F.lead(y).over(by)) / 2)


def normalize_pdf(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Over the trapezoid integral; an integral of 0 gives null."""
    total = F.coalesce(F.sum("_area").over(W.partitionBy(*keys)), F.lit(0.0))
    t = trapezoids(curves, keys).withColumn("_total", total)
    return t.withColumn("y", F.when(F.col("_total") != 0, F.col("y") / F.col("_total"))).drop("_area", "_total")


def bandwidth_factor(n: Column, bandwidth: str | float) -> Column:
    if bandwidth == "scott":
        return F.pow(n, F.lit(-0.2))
    if bandwidth == "silverman":
        return F.pow(n * 3.0 / 4.0, F.lit(-0.2))
    return F.lit(float(bandwidth))


def kde(samples: DataFrame, grid: DataFrame, sample_keys: list[str], grid_keys: list[str], bandwidth: str | float = "scott") -> DataFrame:
    """Gaussian density on the grid; equal values are folded first. Two points or fewer, or no spread, give 0."""
    folded = samples.groupBy(*sample_keys, "value").agg(F.count(F.lit(1)).alias("_w"))
    stats = samples.groupBy(*sample_keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.stddev_samp("value").alias("_sd"))
    stats = stats.withColumn("_h", bandwidth_factor(F.col("_n"), bandwidth) * F.col("_sd"))
    points = _small(grid.select(*grid_keys, "i", "x"), grid_keys)
    rows = folded.join(stats, sample_keys)
    rows = rows.join(points, grid_keys) if grid_keys else rows.crossJoin(points)
    u = F.try_divide(F.col("x") - F.col("value"), F.col("_h"))
    dense = F.sum(F.col("_w") * F.exp(-u * u / 2)) / (F.max("_n") * F.max("_h") * math.sqrt(2 * math.pi))
    ok = (F.max("_n") > 2) & (F.coalesce(F.max("_h"), F.lit(0.0)) > 0)
    return rows.groupBy(*sample_keys, "i").agg(F.max("x").alias("x"), F.when(ok, dense).otherwise(0.0).alias("y"))


def histogram_pdf(samples: DataFrame, grid: DataFrame, sample_keys: list[str], grid_keys: list[str], width: float | None = None, pseudo: float = 0.0) -> DataFrame:
    """Counts plus a pseudocount, normalised."""
    h = histogram(samples, grid, sample_keys, grid_keys, width)
    return normalize_pdf(h.withColumn("y", F.col("y") + pseudo), sample_keys)


def distance_pdfs(samples: DataFrame, method: str = "discrete", bin_width: float = 0.2, limits: tuple[float, float] | None = None, minimum: float | None = None, alpha: float = 0.05, pseudo: float = 1.0, bandwidth: str | float = "scott") -> tuple[DataFrame, DataFrame]:
    """One curve per (measure, mode, cell, seed) on a grid shared by all modes, and the envelope per (measure, mode)."""
    from .expressions import valid_samples
    from ..model import KEYS

    s = valid_samples(samples, minimum)
    grid = fixed_grid(s, ["measure"], *limits, bin_width) if limits else r_grid(s, ["measure"], bin_width=bin_width)
    if method in ("histogram", "discrete"):
        curves = histogram_pdf(s, grid, KEYS, ["measure"], bin_width, pseudo)
    elif method == "kde":
        curves = normalize_pdf(kde(s, grid, KEYS, ["measure"], bandwidth), KEYS)
    else:
        raise ValueError(f"unknown method {method}")
    return curves, pointwise_envelope(curves, ["measure", "mode"], alpha)


def ecdf(samples: DataFrame, grid: DataFrame, sample_keys: list[str], grid_keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """Share of values up to each grid point. Values go to their first grid point, and a running sum does the rest.

    ``groups``: the sample keys that get a curve, also where they have no value (a curve of 0); by default those of the samples.
    """
    ends = _small(_ends(grid, grid_keys), grid_keys)
    s = samples.join(ends, grid_keys) if grid_keys else samples.crossJoin(ends)
    below = _index_below(F.col("value"), F.col("x0"), F.col("step"))
    first = F.greatest(F.lit(0), F.when(F.col("x0") + below * F.col("step") == F.col("value"), below).otherwise(below + 1))
    counted = s.filter("value is not null").withColumn("i", first.cast("int")).groupBy(*sample_keys, "i").agg(F.count(F.lit(1)).alias("_c"))
    # A sample's counts are one row, as long as its grid: the running sum needs no join with the grid and no sort of the points.
    packed = counted.groupBy(*sample_keys).agg(F.collect_list("i").alias("_at"), F.collect_list("_c").alias("_k"), F.sum("_c").alias("_n"))
    wanted = samples.select(*sample_keys).distinct() if groups is None else groups.select(*sample_keys)
    packed = wanted.join(packed, sample_keys, "left")
    laid = (packed.join(ends, grid_keys) if grid_keys else packed.crossJoin(ends)).withColumn("_y", _running_shares("_at", "_k", "_n", "n"))
    return laid.select(*sample_keys, "x0", "step", F.posexplode("_y").alias("i", "y")).select(*sample_keys, "i", (F.col("x0") + F.col("i") * F.col("step")).alias("x"), "y")


@F.pandas_udf(ArrayType(DoubleType()))
def _running_shares(at: pd.Series, counts: pd.Series, total: pd.Series, n: pd.Series) -> pd.Series:
    """Share of a sample up to each of its n points; 0 throughout where it has no values. Places beyond the last point only count in the total."""
    out = []
    for a, c, t, m in zip(at, counts, total, n):
        if a is None or not len(a):
            out.append(np.zeros(m))
        else:
            out.append(np.cumsum(np.bincount(a, weights=c, minlength=m)[:m]) / t)
    return pd.Series(out)


def pdf_ratio(num: DataFrame, den: DataFrame, keys: list[str], floor: float = RATIO_FLOOR) -> DataFrame:
    """Ratio of two densities through logarithms with a floor; both are normalised first."""
    a = normalize_pdf(num, keys).select(*keys, "i", "x", F.col("y").alias("_a"))
    b = normalize_pdf(den, keys).select(*keys, "i", F.col("y").alias("_b"))
    y = F.exp(F.ln(F.greatest("_a", F.lit(floor))) - F.ln(F.greatest("_b", F.lit(floor))))
    return a.join(b, [*keys, "i"]).select(*keys, "i", "x", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), y).alias("y"))


def running_integral(curves: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys).orderBy("i")
    area = (F.col("x") - F.lag("x").over(by)) * (F.col("y") + F.lag("y").over(by)) / 2
    return curves.withColumn("_area", area).withColumn("y", F.coalesce(F.sum("_area").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))).drop("_area")


def cdf_ratio(num: DataFrame, den: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of the running integrals of the normalised densities; null where the denominator is 0."""
    a = running_integral(normalize_pdf(num, keys), keys).select(*keys, "i", "x", F.col("y").alias("_a"))
    b = running_integral(normalize_pdf(den, keys), keys).select(*keys, "i", F.col("y").alias("_b"))
    return a.join(b, [*keys, "i"]).select(*keys, "i", "x", F.try_divide("_a", "_b").alias("y"))


def ratio(num: DataFrame, den: DataFrame, keys: list[str], method: str = "pdf") -> DataFrame:
    return {"pdf": pdf_ratio, "cdf": cdf_ratio}[method](num, den, keys)


def pointwise_envelope(curves: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Quantiles, mean and standard deviation (0 becomes a small number) at every grid point.

    Equal values of a point are folded first: many curves share few values, and the quantiles then take counts.
    """
    folded = curves.groupBy(*keys, "i", "y").agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("_c")).withColumn("_k", F.when(F.col("y").isNotNull(), F.col("_c")))
    by = W.partitionBy(*keys, "i")
    folded = folded.withColumn("_m", F.sum(F.col("y") * F.col("_k")).over(by) / F.sum("_k").over(by))
    n, apart = F.sum("_k"), F.col("y") - F.col("_m")
    sd = F.when((n > 1) & (F.min("y") < F.max("y")), F.sqrt(F.sum(F.col("_k") * apart * apart) / F.when(n > 1, n - 1))).otherwise(0.0)
    at = lambda q: F.percentile("y", F.lit(q), F.col("_c"))
    return folded.groupBy(*keys, "i").agg(F.max("x").alias("x"), at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"), F.max("_m").alias("mean"), F.when(sd == 0, STD_FLOOR).otherwise(sd).alias("sd"))


def interp(curves: DataFrame, grid: DataFrame, curve_keys: list[str], grid_keys: list[str], outside: str = "clamp") -> DataFrame:
    """Linear interpolation. Points and curve are merged by x and windows bring the neighbours: no range join."""
    known = curves.filter(F.col("y").isNotNull()).select(*curve_keys, F.lit(None).cast("int").alias("i"), "x", "y", F.lit(0).alias("_t"))
    groups = curves.select(*curve_keys).distinct()
    points = grid.select(*grid_keys, "i", "x")
    asked = groups.join(points, grid_keys) if grid_keys else groups.crossJoin(F.broadcast(points))
    both = known.unionByName(asked.select(*curve_keys, F.col("i").cast("int").alias("i"), "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("_t")))
    here = F.when(F.col("_t") == 0, F.struct("x", "y"))
    before = W.partitionBy(*curve_keys).orderBy("x", "_t").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*curve_keys).orderBy("x", F.col("_t").desc()).rowsBetween(0, W.unboundedFollowing)
    both = both.withColumn("_p", here).withColumn("_l", F.last("_p", True).over(before)).withColumn("_r", F.first("_p", True).over(after))
    lx, ly, rx, ry = (F.col(c) for c in ("_l.x", "_l.y", "_r.x", "_r.y"))
    inside = F.when(lx == rx, ly).otherwise(ly + (ry - ly) * (F.col("x") - lx) / F.when(rx != lx, rx - lx))
    edge = F.coalesce(ly, ry) if outside == "clamp" else F.lit(0.0) if outside == "zero" else F.lit(None).cast("double")
    y = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), inside).otherwise(edge)
    return both.filter("_t = 1").select(*curve_keys, "i", "x", y.alias("y"))


def unit_curves(curves: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Every curve on a uniform grid of [0, 1]: keys, i, x, y. A curve of no x-range interpolates first to last.

    Values have twelve decimals, so that curves that agree at a point still do after the interpolation.
    """
    one = curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_p"))
    even = one.select(*keys, F.posexplode(_even("_p.x", "_p.y", F.lit(n))).alias("i", "y"))
    return even.select(*keys, "i", (F.col("i") / float(n - 1)).alias("x"), F.round("y", 12).alias("y"))


@F.pandas_udf(ArrayType(DoubleType()))
def _even(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
    """Each curve at n places of its range, from one end to the other; points without a value are passed over."""
    return pd.Series([even_curve(np.asarray(a, float), np.asarray(b, float), m) for a, b, m in zip(x, y, n)])


def even_curve(a: np.ndarray, b: np.ndarray, m: int):
    """One curve of ``_even``."""
    at, lo, hi = np.arange(m) / (m - 1), np.nanmin(a), np.nanmax(a)
    if hi > lo:
        a = (a - lo) / (hi - lo)
    else:
        a, b = np.arange(2.0), b[[0, -1]]
    known = ~np.isnan(a) & ~np.isnan(b)
    order = np.argsort(a[known], kind="stable")
    return np.interp(at, a[known][order], b[known][order]) if known.any() else [None] * m


def joint_curves(curves: DataFrame, keys: list[str], n: int = 100, measure: str = "measure") -> DataFrame:
    """Every curve on a uniform grid of [0, 1], measures one after the other."""
    even = unit_curves(curves, keys, n)
    rank = curves.select(measure).distinct().withColumn("_no", F.row_number().over(W.orderBy(measure)) - 1)  # one row a measure
    rest = [k for k in keys if k != measure]
    return even.join(rank, measure).select(*rest, (F.col("_no") * n + F.col("i")).cast("int").alias("i"), (F.col("_no") + F.col("x")).alias("x"), "y")


def rank_cdf(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled values with their rank over the count; equal values take the ranks of their place one after the other."""
    folded = running_before(samples.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n")), keys, "value", "_n", "_before")
    total = folded.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rank = F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n")))
    return folded.join(total, keys).withColumn("_rank", rank).select(*keys, "value", (F.col("_rank") / F.col("_total")).alias("p"))


def rms(samples: DataFrame, keys: list[str]) -> DataFrame:
    """D15"""
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def curve_mean(curves: DataFrame, curve_keys: list[str], keys: list[str]) -> DataFrame:
    """Mean position of each curve, then the mean of these."""
    one = curves.groupBy(*curve_keys).agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum("y")).alias("m"))
    return one.groupBy(*keys).agg(F.avg("m").alias("mean_position"))


def pad_arrays(df: DataFrame, column: str, fill: float | None = None) -> DataFrame:
    """Arrays of equal length."""
    longest = df.agg(F.max(F.size(column)).alias("_m"))
    padded = F.concat(F.col(column), F.array_repeat(F.lit(fill).cast("double"), (F.col("_m") - F.size(column)).cast("int")))
    return df.crossJoin(F.broadcast(longest)).withColumn(column, padded).drop("_m")
