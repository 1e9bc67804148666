"""Envelope tests (E). Observed and simulated curves are long tables: keys, curve_id, i, x, y."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.storage import running_before, written
from ..model import KEYS, STD_FLOOR
from .curves import _grid, ecdf, even_curve, exact_quantile, joint_curves, pointwise_envelope, r_grid, unit_curves
from .expressions import valid_samples


def share_above(obs: DataFrame, sims: DataFrame, keys: list[str]) -> DataFrame:
    """Monte Carlo p-value of every observed statistic: (simulated ones at least as large + 1) / (simulated ones + 1).

    One sort of both sides and a running count; no observed statistic meets a simulated one. A key without simulated ones is left out.
    """
    o = obs.withColumn("_at", F.col("statistic") - 1e-12).withColumn("_sim", F.lit(0))
    s = sims.select(*keys, F.col("statistic").alias("_at"), F.lit(1).alias("_sim"))
    by = W.partitionBy(*keys)
    so_far = F.sum("_sim").over(by.orderBy(F.desc("_at"), F.desc("_sim")).rowsBetween(W.unboundedPreceding, 0))
    both = o.unionByName(s, allowMissingColumns=True).withColumn("_k", so_far).withColumn("_n", F.sum("_sim").over(by))
    return both.filter("_sim = 0 and _n > 0").withColumn("p_value", (F.col("_k") + 1) / (F.col("_n") + 1)).drop("_at", "_sim", "_k", "_n")


def envelope_test(obs: DataFrame, sims: DataFrame, keys: list[str], statistic: str = "supremum") -> DataFrame:
    """Every observed curve against the simulated ones of its keys: statistic, sign, Monte Carlo p.

    ``obs``: keys, curve_id, i, y; ``sims``: keys, curve_id, i, y. Deviations are standardised by the simulated curves' mean and
    deviation at each point; simulated curves are measured by the same. ``supremum`` takes the largest and its sign, ``integrated``
    the integral (unit spacing) and the sign of the mean, ``rank`` the least rank from the side of the mean (see rank_test).
    """
    if statistic == "rank":
        return rank_test(obs, sims, keys)
    moments = sims.groupBy(*keys, "i").agg(F.avg("y").alias("_m"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("_s"))
    moments = moments.withColumn("_s", F.when(F.col("_s") == 0, STD_FLOOR).otherwise(F.col("_s")))

    def measured(curves: DataFrame) -> DataFrame:
        z = curves.join(moments, [*keys, "i"]).withColumn("_z", (F.col("y") - F.col("_m")) / F.col("_s"))
        if statistic == "supremum":
            stat, sign = F.max(F.abs("_z")), F.max_by("_z", F.struct(F.abs("_z"), -F.col("i")))
        else:
            # The sum of trapezoids of unit width: all points but half of each end.
            first, last = F.min_by(F.abs("_z"), "i"), F.max_by(F.abs("_z"), "i")
            stat, sign = F.sum(F.abs("_z")) - (first + last) / 2, F.avg("_z")
        return z.groupBy(*keys, "curve_id").agg(stat.alias("statistic"), F.when(sign < 0, -1).otherwise(1).alias("sign"))

    return share_above(measured(obs), measured(sims), keys)


def rank_test(obs: DataFrame, sims: DataFrame, keys: list[str]) -> DataFrame:
    """E02 for many observed curves of a key, each ranked among the simulated ones: statistic (u or v), sign, exact p.

    With b simulated values below an observed one at a point and c not below, u is the least b + 1 and v the least c + 1. A
    simulated curve is as extreme as v when its least rank from above is below v among the simulated ones alone, or is v at a point
    where the observed curve does not push it down, that is where c >= v (from below: likewise with u and b). The one simulated
    value of such a rank at such a point is looked up, so observed and simulated curves never meet in pairs.
    """
    s = sims.select(*keys, F.col("curve_id").cast("string").alias("_curve"), "i", "y")
    # One running count over both sides, observed ones first among equals: the simulated ones before a row. It goes over ranges, as
    # a point has a row for every curve.
    both = obs.select(*keys, "curve_id", "i", "y", F.lit(0).alias("_sim"), F.xxhash64("curve_id").alias("_h")).unionByName(s.select(*keys, "_curve", "i", "y", F.lit(1).alias("_sim")), allowMissingColumns=True)
    placed = written(running_before(both, [*keys, "i"], ["y", "_sim", "_curve", "_h"], "_sim", "_b"), "placed")
    per_point = written(s.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_mean")), "points")
    # From here a curve is one row with its points.
    at = placed.join(per_point, [*keys, "i"]).withColumn("_c", F.col("_n") - F.col("_b"))
    points = F.collect_list(F.struct("i", "_b", "_c")).alias("_at")
    tail = at.filter("_sim = 0").groupBy(*keys, "curve_id").agg(F.when(F.avg(F.col("y") - F.col("_mean")) < 0, -1).otherwise(1).alias("sign"), (F.min("_b") + 1).alias("_u"), (F.min("_c") + 1).alias("_v"), F.max("_n").alias("_n"), points)
    tail = tail.withColumn("statistic", F.when(F.col("sign") > 0, F.col("_v")).otherwise(F.col("_u")).cast("double"))
    free = F.filter("_at", lambda x: F.when(F.col("sign") > 0, x["_c"]).otherwise(x["_b"]) >= F.col("statistic"))
    tail = written(tail.select(*keys, "curve_id", "sign", "statistic", "_n", F.transform(free, lambda x: x["i"]).alias("_free")), "tails")
    # A simulated curve's least rank from either side (one more than the simulated ones beyond it), and the points where it has that rank.
    depth = at.filter("_sim = 1").groupBy(*keys, "_curve").agg(F.min("_b").alias("_l"), F.min("_c").alias("_h"), points)
    holds = lambda c, least: F.transform(F.filter("_at", lambda x: x[c] == F.col(least)), lambda x: x["i"]).alias("held")
    sides = F.array(F.struct(F.lit(1).alias("sign"), F.col("_h").cast("double").alias("statistic"), holds("_c", "_h")), F.struct(F.lit(-1).alias("sign"), (F.col("_l") + 1).cast("double").alias("statistic"), holds("_b", "_l")))
    sides = depth.select(*keys, F.explode(sides).alias("p")).select(*keys, "p.sign", "p.statistic", "p.held")
    # Simulated curves of a lesser least rank: a running count over the distinct ranks of a key. Those of just that rank come along; a
    # point has one curve of a rank, so they are no more than the points.
    found = sides.withColumn("_m", F.lit(1)).unionByName(tail.select(*keys, "sign", "statistic", F.lit(0).alias("_m")), allowMissingColumns=True)
    ranks = found.groupBy(*keys, "sign", "statistic").agg(F.sum("_m").alias("_m"), F.collect_list("held").alias("_held"))
    less = running_before(ranks, [*keys, "sign"], "statistic", "_m", "_less")
    # Many observed curves share a low rank: they stream past the table of ranks unsorted.
    out = tail.join(less.hint("shuffle_hash"), [*keys, "sign", "statistic"])
    equal = F.size(F.filter("_held", lambda x: F.arrays_overlap(x, F.col("_free"))))
    return out.select(*keys, "curve_id", "statistic", "sign", ((F.col("_less") + equal + 1) / (F.col("_n") + 1)).alias("p_value"))


def rank_envelope(obs: DataFrame, sims: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One observed curve per key against its simulated curves.

    Curves are ranked at each grid point (ties by curve order, the observed one first); u and v are a curve's least rank from
    below and from above. The sign of the mean deviation chooses the tail of the exact p-value; the bounds are the k-th least and
    largest values with k the observed curve's depth. Gives (keys, p_value, sign, u, v) and (keys, i, lo, hi).
    """
    pool = obs.select(*keys, F.lit("").alias("curve_id"), "i", "y", F.lit(0).alias("_sim")).unionByName(sims.select(*keys, F.col("curve_id").cast("string").alias("curve_id"), "i", "y", F.lit(1).alias("_sim")))
    by = W.partitionBy(*keys, "i")
    ranked = pool.withColumn("_r", F.row_number().over(by.orderBy("y", "_sim", "curve_id"))).withColumn("_n", F.count(F.lit(1)).over(by))
    ranked = ranked.withColumn("_mean", F.avg(F.when(F.col("_sim") == 1, F.col("y"))).over(by))
    depth = ranked.groupBy(*keys, "curve_id", "_sim").agg(F.min("_r").alias("u"), F.min(F.col("_n") + 1 - F.col("_r")).alias("v"), F.max("_n").alias("_n"), F.avg(F.col("y") - F.col("_mean")).alias("_d"))
    o = depth.filter("_sim = 0").select(*keys, F.col("u").alias("_u"), F.col("v").alias("_v"), "_n", F.when(F.col("_d") < 0, -1).otherwise(1).alias("sign"))
    extreme = F.when(F.col("sign") > 0, F.col("v") <= F.col("_v")).otherwise(F.col("u") <= F.col("_u"))
    # The observed curve counts as one of its own extremes.
    tests = depth.select(*keys, "u", "v").join(o, keys).groupBy(*keys, "_u", "_v", "_n", "sign").agg(F.count(F.when(extreme, 1)).alias("_k"))
    tests = tests.select(*keys, (F.col("_k") / F.col("_n")).alias("p_value"), "sign", F.col("_u").alias("u"), F.col("_v").alias("v"))
    k = F.greatest(F.lit(1), F.least("_u", "_v"))
    at = ranked.drop("_n").join(o, keys)
    bounds = at.groupBy(*keys, "i").agg(F.max(F.when(F.col("_r") == k, F.col("y"))).alias("lo"), F.max(F.when(F.col("_r") == F.col("_n") + 1 - k, F.col("y"))).alias("hi"))
    return tests, bounds


def bh_qvalues(df: DataFrame, p: str, keys: list[str], tie: list[str], out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg within the keys; ``tie`` orders equal p-values."""
    by = W.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(by.orderBy(p, *tie))).withColumn("_m", F.count(F.lit(1)).over(by))
    q = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(by.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn(out, F.least(F.lit(1.0), q)).drop("_r", "_m")


def rejection_rates(tests: DataFrame, keys: list[str], alpha: float, count: str) -> DataFrame:
    """Shares of tests with q < alpha: all, and those of either sign."""
    no = F.col("q_value") < alpha
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return tests.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), share(no).alias("rejected"), share(no & (F.col("sign") > 0)).alias("rejected_positive"), share(no & (F.col("sign") < 0)).alias("rejected_negative"))


def monte_carlo_per_cell(obs: DataFrame, sims: DataFrame, n_grid: int = 100, statistic: str = "integrated", whole: int = 1_000_000) -> DataFrame:
    """Each cell's observed sample against the simulated samples of each null mode, per measure and joint.

    ``obs``: measure, cell_id, value. ``sims``: measure, mode, cell_id, seed, value. All cells are done at once, by key. A
    simulation that lacks a measure of the cell has a curve of 0 there. ``statistic``: supremum, integrated or rank.

    A cell is one row with its samples, and its tests are made there. Cells of more than ``whole`` values and points of curves, and
    rank tests, are spread over rows instead.
    """
    o, s = valid_samples(obs).select("measure", "cell_id", "value"), valid_samples(sims).select("measure", "mode", "cell_id", "seed", "value")
    each = o.withColumn("mode", F.lit(None).cast("string")).withColumn("seed", F.lit(None).cast("string")).withColumn("_sim", F.lit(False)).unionByName(s.withColumn("seed", F.col("seed").cast("string")).withColumn("_sim", F.lit(True)))
    each = each.filter("cell_id is not null and measure is not null and (not _sim or (mode is not null and seed is not null))")
    sample = ["cell_id", "measure", "mode", "seed", "_sim"]
    if statistic == "rank":
        return _monte_carlo_rows(o, s, n_grid, statistic)
    # Two cheap counts tell which cells are large; there are few of those.
    sizes = each.groupBy(*sample).agg(F.count(F.lit(1)).alias("_n")).groupBy("cell_id").agg((F.sum("_n") + F.count(F.lit(1)) * n_grid).alias("_n"))
    large = written(sizes.filter(F.col("_n") > whole).select("cell_id"), "large-cells")
    several = not large.isEmpty()
    few = each.join(large, "cell_id", "left_anti") if several else each
    packed = few.groupBy(*sample).agg(F.collect_list("value").alias("values"))
    cells = packed.groupBy("cell_id").agg(F.collect_list(F.struct("measure", "mode", "seed", "_sim", "values")).alias("samples"))

    def test(batches):
        for pdf in batches:
            rows = [(m, mode, c, *t) for c, samples in zip(pdf["cell_id"], pdf["samples"]) for m, mode, t in _cell_tests(samples, n_grid, statistic)]
            yield pd.DataFrame(rows, columns=["measure", "mode", "cell_id", "statistic", "sign", "p_value"]).astype({"statistic": "float64", "sign": "int32", "p_value": "float64"})

    out = cells.mapInPandas(test, "measure string, mode string, cell_id string, statistic double, sign int, p_value double")
    if several:
        out = out.unionByName(_monte_carlo_rows(*[df.join(large, "cell_id", "left_semi") for df in (o, s)], n_grid, statistic))
    return out


def _measured(y: np.ndarray, mean: np.ndarray, sd: np.ndarray, statistic: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistic and sign of every row of curves (see envelope_test)."""
    z = (y - mean) / sd
    size = np.abs(z)
    if statistic == "supremum":
        at = size.argmax(1)
        stat, sign = size.max(1), z[np.arange(len(z)), at]
    else:
        stat, sign = size.sum(1) - (size[:, 0] + size[:, -1]) / 2, z.mean(1)
    return stat, np.where(sign < 0, -1, 1)


def _curve_test(obs: np.ndarray, sims: np.ndarray, statistic: str) -> tuple[float, int, float]:
    """One observed curve against the rows of ``sims``: statistic, sign, Monte Carlo p."""
    mean = sims.sum(0) / len(sims)
    sd = sims.std(0, ddof=1) if len(sims) > 1 else np.zeros(len(mean))
    sd = np.where((sims.max(0) == sims.min(0)) | (sd == 0), STD_FLOOR, sd)
    (stat,), (sign,) = _measured(obs[None], mean, sd, statistic)
    return float(stat), int(sign), float(((_measured(sims, mean, sd, statistic)[0] >= stat - 1e-12).sum() + 1) / (len(sims) + 1))


def _cell_tests(samples, n: int, statistic: str) -> list[tuple]:
    """(measure, mode, test) of one cell: each measure, and all of them one after the other on even points."""
    seen = {x["measure"]: np.sort(x["values"]) for x in samples if not x["_sim"]}
    sims: dict = {}
    for x in samples:
        if x["_sim"]:
            sims.setdefault(x["mode"], {}).setdefault(x["seed"], {})[x["measure"]] = np.sort(x["values"])
    out = []
    for mode, runs in sims.items() if seen else ():
        joint = []
        for measure in sorted(seen):
            each = [seen[measure], *[r.get(measure, np.empty(0)) for r in runs.values()]]
            pool = np.sort(np.concatenate(each))
            place = 0.995 * (len(pool) - 1)
            low, high = pool[int(np.floor(place))], pool[int(np.ceil(place))]
            x1 = max(low + (high - low) * (place - np.floor(place)), 1e-9) * 1.05
            x = np.arange(n) * (x1 / (n - 1) if n > 1 else 0.0)
            y = np.array([np.searchsorted(v, x, "right") / len(v) if len(v) else np.zeros(n) for v in each])
            out.append((measure, mode, _curve_test(y[0], y[1:], statistic)))
            joint.append(np.array([even_curve(x, row, n) for row in y]))
        every = np.round(np.concatenate(joint, 1), 12)
        out.append(("joint", mode, _curve_test(every[0], every[1:], statistic)))
    return out


def _monte_carlo_rows(o: DataFrame, s: DataFrame, n_grid: int, statistic: str) -> DataFrame:
    """E03 by rows: the values of one cell may fill any number of tasks."""
    keys = ["measure", "mode", "cell_id"]
    runs = s.select("mode", "cell_id", F.col("seed").alias("curve_id")).distinct().join(o.select("measure", "cell_id").distinct(), "cell_id")
    oc = o.join(runs.select(*keys).distinct(), ["measure", "cell_id"]).select(*keys, F.lit("obs").alias("curve_id"), "value")
    sc = s.select(*keys, F.col("seed").alias("curve_id"), "value").join(runs.select(*keys).distinct(), keys, "left_semi")
    grid = written(r_grid(oc.unionByName(sc), keys, n=n_grid), "grid")
    each_key = [*keys, "curve_id"]
    curves = [written(ecdf(oc, grid, each_key, keys), "curves"), written(ecdf(sc, grid, each_key, keys, runs.select(*each_key)), "curves")]
    each = envelope_test(*curves, keys, statistic)
    joint = envelope_test(*[written(joint_curves(c, each_key, n_grid), "joint") for c in curves], ["mode", "cell_id"], statistic).withColumn("measure", F.lit("joint"))
    return each.unionByName(joint).drop("curve_id")


def summarize_cells(tests: DataFrame, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Tests with q-values per (measure, mode), and the rejection rates (q < alpha) in all and by sign."""
    q = bh_qvalues(tests, "p_value", ["measure", "mode"], ["cell_id"])
    return q, rejection_rates(q, ["measure", "mode"], alpha, "n_cells")


def pairwise_curve_test(curves: DataFrame, statistic: str = "integrated", alpha: float = 0.05, joint_n: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """Every curve of mode a against the curves of mode b, for all ordered pairs of modes; at least two curves of b.

    ``curves``: measure, mode, curve_id, i, x, y. Gives tests (with q-values by pair and measure) and rejection rates. The joint test
    takes the measures in which b has two curves and a has one; the curves of a mode go together by their number in the order of
    curve_id, up to the least number of curves over these measures. ``statistic``: supremum, integrated or rank.
    """
    curves = written(curves, "curves")
    size = written(curves.select("measure", "mode", "curve_id").distinct().groupBy("measure", "mode").agg(F.count(F.lit(1)).alias("n")), "curve-counts")
    a = size.select("measure", F.col("mode").alias("mode_a"), F.col("n").alias("n_a"))
    b = size.filter("n >= 2").select("measure", F.col("mode").alias("mode_b"), F.col("n").alias("n_b"))
    pairs = written(a.join(b, "measure").filter("mode_a <> mode_b"), "curve-pairs")
    # Moments and simulated statistics depend on mode b alone; the pair enters with the observed curves.
    obs = pairs.join(curves.withColumnRenamed("mode", "mode_a"), ["measure", "mode_a"]).select("measure", "mode_b", F.struct("mode_a", "curve_id").alias("curve_id"), "i", "y")
    sims = curves.withColumnRenamed("mode", "mode_b").join(b, ["measure", "mode_b"], "left_semi").select("measure", "mode_b", "curve_id", "i", "y")
    tests = envelope_test(obs, sims, ["measure", "mode_b"], statistic).select("measure", "curve_id.mode_a", "mode_b", "curve_id.curve_id", "statistic", "sign", "p_value")
    if joint_n:
        number = F.row_number().over(W.partitionBy("measure", "mode").orderBy("curve_id")) - 1
        numbered = curves.select("measure", "mode", "curve_id").distinct().withColumn("no", number)
        even = unit_curves(curves, ["measure", "mode", "curve_id"], joint_n).join(numbered, ["measure", "mode", "curve_id"])
        place = written(size.select("measure").distinct().withColumn("_m", F.row_number().over(W.orderBy("measure")) - 1), "measures")  # one row a measure
        even = written(even.join(place, "measure").select("measure", "mode", "no", (F.col("_m") * joint_n + F.col("i")).alias("i"), "y"), "joint-curves")
        # The set of measures of a pair; most pairs of a mode b share one.
        sets = pairs.groupBy("mode_a", "mode_b").agg(F.sort_array(F.collect_set("measure")).alias("set"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))
        side = lambda own, other: sets.select(*own, "set", F.explode("set").alias("measure"), *other).distinct()
        joint_obs = side(["mode_a", "mode_b"], ["n_a"]).join(even.withColumnRenamed("mode", "mode_a"), ["measure", "mode_a"]).filter("no < n_a")
        joint_sims = side(["mode_b"], ["n_b"]).join(even.withColumnRenamed("mode", "mode_b"), ["measure", "mode_b"]).filter("no < n_b")
        joint_obs = joint_obs.select("mode_b", "set", F.struct("mode_a", F.col("no").cast("string").alias("curve_id")).alias("curve_id"), "i", "y")
        joint_sims = joint_sims.select("mode_b", "set", F.lpad(F.col("no").cast("string"), 12, "0").alias("curve_id"), "i", "y")
        joint = envelope_test(joint_obs, joint_sims, ["mode_b", "set"], statistic)
        tests = tests.unionByName(joint.select(F.lit("joint").alias("measure"), "curve_id.mode_a", "mode_b", "curve_id.curve_id", "statistic", "sign", "p_value"))
    tests = bh_qvalues(tests, "p_value", ["measure", "mode_a", "mode_b"], ["curve_id"])
    return tests, rejection_rates(tests, ["measure", "mode_a", "mode_b"], alpha, "n_curves")


def sample_curves(samples: DataFrame, n: int | None = 100, bin_width: float | None = None) -> DataFrame:
    """Empirical distribution curve of every (mode, cell, seed) on a grid that all modes of a measure share."""
    s = valid_samples(samples)
    grid = r_grid(s, ["measure"], n=n, bin_width=bin_width)
    return ecdf(s, grid, KEYS, ["measure"]).select("measure", "mode", F.concat_ws("_", "cell_id", "seed").alias("curve_id"), "i", "x", "y")


def pairwise_envelope_test(samples: DataFrame, statistic: str = "integrated", alpha: float = 0.05, n: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E06 on distance samples, and each mode's envelope on its own grid where it has two samples or more."""
    tests, rates = pairwise_curve_test(sample_curves(samples, n), statistic, alpha, n)
    return tests, rates, own_envelopes(samples, alpha, n)


def own_envelopes(samples: DataFrame, alpha: float = 0.05, n: int = 100) -> DataFrame:
    """Each mode's envelope on its own grid where it has two samples or more; needs no test."""
    s = valid_samples(samples)
    own = ecdf(s, r_grid(s, ["measure", "mode"], n=n), KEYS, ["measure", "mode"])
    many = s.select(*KEYS).distinct().groupBy("measure", "mode").count().filter("count > 1")
    return pointwise_envelope(own.join(many, ["measure", "mode"], "left_semi"), ["measure", "mode"], alpha)


def pairwise_envelope_test_occupancy(occ: DataFrame, comparison: str = "ratio", statistic: str = "integrated", alpha: float = 0.05, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """E06 on occupancy curves (null as 0), or on the distribution of each curve's values up to their 95 % point."""
    c = occ.select("measure", "mode", F.col("cell_id").alias("curve_id"), "i", "x", F.coalesce("occupancy", F.lit(0.0)).alias("y"))
    if comparison == "ecdf":
        values = c.select("measure", "mode", "curve_id", F.col("y").alias("value"))
        top = exact_quantile(values, ["measure"], "value", 0.95, "q").select("measure", F.greatest("q", F.lit(1e-9)).alias("x1"))
        grid = _grid(top.select("measure", F.lit(n).alias("n"), F.lit(0.0).alias("x0"), "x1"), ["measure"])
        c = ecdf(values, grid, ["measure", "mode", "curve_id"], ["measure"])
    return pairwise_curve_test(c, statistic, alpha, n)


def shared_xmax(envelopes: DataFrame) -> DataFrame:
    """One x-limit per measure for all modes."""
    return envelopes.groupBy("measure").agg(F.max("x").alias("x_max"))


