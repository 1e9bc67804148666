"""Two-sample comparison (F): KS, earth mover's distance, bootstraps, ranks, model comparison."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.special import ks_p_asymptotic, ks_p_exact, normal_quantile, normal_two_sided, rank_sum_p_exact, signed_rank_p_exact, student_two_sided
from ..model import KEYS
from ..functions.storage import running_before, written
from .curves import exact_quantile, exact_quantiles
from .expressions import support_label, valid_samples


#: Samples of at most so many distinct values are compared as arrays, larger ones as rows over many tasks.
WHOLE = 1_000_000


def signed_walk(values: DataFrame, keys: list[str]) -> DataFrame:
    """KS distance and earth mover's distance of the two sides of each key, whatever their size.

    ``values``: keys, side (0 or 1), value, w (multiplicity). Every side's weights add up to one; the running sum of the signed
    weights is the difference of the two distribution functions. The values of a key lie in ranges. A range tells the sum of its
    weights and its first value; from those of the ranges before it each knows the difference that it starts with, and from the range
    after it how far its last difference reaches. So the values of one key may fill any number of tasks.
    """
    sizes = values.groupBy(*keys).agg(*[F.sum(F.when(F.col("side") == k, F.col("w"))).alias(f"n{k + 1}") for k in (0, 1)]).filter("n1 is not null and n2 is not null")
    sizes = written(sizes, "sizes")
    signed = values.join(sizes, keys).groupBy(*keys, "value").agg(F.sum(F.when(F.col("side") == 0, F.col("w") / F.col("n1")).otherwise(-F.col("w") / F.col("n2"))).alias("_w"))
    laid = written(written(signed, "signed").repartitionByRange(*keys, "value").withColumn("_range", F.spark_partition_id()), "ranges")
    parts = laid.groupBy(*keys, "_range").agg(F.sum("_w").alias("_sum"), F.min("value").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range")
    parts = parts.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_start"), F.lead("_first").over(before).alias("_beyond"))
    inside = W.partitionBy(*keys, "_range").orderBy("value")
    apart = F.col("_start") + F.sum("_w").over(inside.rowsBetween(W.unboundedPreceding, 0))
    reach = F.coalesce(F.lead("value").over(inside), F.col("_beyond")) - F.col("value")
    walked = laid.join(parts, [*keys, "_range"]).select(*keys, F.abs(apart).alias("_f"), F.coalesce(reach, F.lit(0.0)).alias("_dx"))
    out = walked.groupBy(*keys).agg(F.max("_f").alias("ks"), F.sum(F.col("_f") * F.col("_dx")).alias("emd"))
    return sizes.join(out, keys).select(*keys, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "ks", "emd")


@F.pandas_udf(StructType([StructField("ks", DoubleType()), StructField("emd", DoubleType())]))
def walk_arrays(x: pd.Series, w: pd.Series, n: pd.Series, y: pd.Series, v: pd.Series, m: pd.Series) -> pd.DataFrame:
    """Both distances of two samples, each as its distinct values, their counts and the sum of these."""
    out = []
    for a, wa, na, b, wb, nb in zip(x, w, n, y, v, m):
        every = np.concatenate([a, b])
        order = np.argsort(every, kind="stable")
        every = every[order]
        apart = np.abs(np.cumsum(np.concatenate([wa / na, -wb / nb])[order]))
        step = np.diff(every)
        # Of equal values the last one tells the difference.
        out.append((float(apart[np.append(step > 0, True)].max()), float(apart[:-1] @ step)))
    return pd.DataFrame(out, columns=["ks", "emd"])


def sample_arrays(values: DataFrame, keys: list[str]) -> DataFrame:
    """Folded values as one row a sample: keys, values (ascending), weights, n."""
    packed = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "w"))).alias("_p"), F.sum("w").alias("n"))
    return packed.select(*keys, F.col("_p.value").alias("values"), F.col("_p.w").alias("weights"), "n")


def folded(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample as distinct values with multiplicities: what pair joins repeat is as small as it can be."""
    return samples.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("w"))


def emd(samples: DataFrame, keys: list[str], side: str) -> DataFrame:
    """F03 for samples whose column ``side`` holds 0 or 1."""
    return signed_walk(folded(samples.withColumnRenamed(side, "side"), [*keys, "side"]), keys)


def baseline_pairs(groups: DataFrame, baseline: DataFrame) -> DataFrame:
    """measure, baseline, mode, cell_id, seed, base_seed: which sample of each baseline a sample is compared with.

    That of the same cell and seed, else of the cell's smallest seed; cells that the baseline lacks are skipped. ``groups``: the keys
    of all samples; ``baseline``: one column of baseline modes. Both tables grow with the cells, so neither is broadcast.
    """
    base = groups.join(baseline, groups["mode"] == baseline["baseline"], "left_semi").select("measure", F.col("mode").alias("baseline"), "cell_id", F.col("seed").alias("base_seed"))
    first = base.groupBy("measure", "baseline", "cell_id").agg(F.min("base_seed").alias("first_seed"))
    wanted = groups.join(first.hint("merge"), ["measure", "cell_id"]).filter("mode <> baseline")
    same = base.withColumnRenamed("base_seed", "seed").withColumn("_same", F.lit(True))
    wanted = wanted.join(same.hint("merge"), ["measure", "baseline", "cell_id", "seed"], "left")
    return wanted.select("measure", "baseline", "mode", "cell_id", "seed", F.when(F.col("_same"), F.col("seed")).otherwise(F.col("first_seed")).alias("base_seed"))


def against_baselines(samples: DataFrame, baseline: DataFrame, whole: int = WHOLE) -> DataFrame:
    """measure, baseline, mode, cell_id, seed, n1, n2, ks, emd of each sample and its baseline's.

    A sample is folded into one row of sorted values, and a pair is one row with both. Pairs with a sample of more than ``whole``
    distinct values are walked as rows instead.
    """
    v = written(folded(valid_samples(samples), KEYS), "folded")
    sizes = written(v.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    keys = ["measure", "baseline", "mode", "cell_id", "seed"]
    there = ["measure", "baseline", "cell_id", "base_seed"]
    as_base = lambda df: df.withColumnsRenamed({"mode": "baseline", "seed": "base_seed"})
    large = sizes.filter(F.col("_size") > whole).drop("_size")
    pairs, several = baseline_pairs(sizes.drop("_size"), baseline), not large.isEmpty()
    few = v
    if several:
        pairs = written(pairs.join(large.withColumn("_l1", F.lit(True)), KEYS, "left").join(as_base(large).withColumn("_l2", F.lit(True)), there, "left").withColumn("_large", F.coalesce("_l1", "_l2", F.lit(False))), "pairs")
        few = v.join(large, KEYS, "left_anti")
    arrays = written(sample_arrays(few, KEYS), "arrays")
    one = (pairs.filter("not _large") if several else pairs).join(arrays, KEYS)
    two = as_base(arrays).select(*there, F.col("values").alias("_y"), F.col("weights").alias("_v"), F.col("n").alias("_m"))
    met = one.join(two, there).select(*keys, F.col("n").cast("long").alias("n1"), F.col("_m").cast("long").alias("n2"), walk_arrays("values", "weights", "n", "_y", "_v", "_m").alias("_d"))
    out = met.select(*keys, "n1", "n2", "_d.ks", "_d.emd")
    if several:
        long = pairs.filter("_large").select(*keys, "base_seed")
        left = long.join(v, KEYS).select(*keys, F.lit(0).alias("side"), "value", "w")
        right = long.join(as_base(v), there).select(*keys, F.lit(1).alias("side"), "value", "w")
        out = out.unionByName(signed_walk(left.unionByName(right), keys))
    return out


def ks_all_baselines(samples: DataFrame, baseline: DataFrame, level: float = 0.05, method: str = "exact") -> DataFrame:
    """F07 (F01 for one baseline): KS statistic, earth mover's distance and p-value against each baseline's sample of the cell.

    ``method``: exact (up to 10,000 values a side, else the series) or asymptotic (the series).
    """
    out = against_baselines(samples, baseline)
    n, m = F.col("n1").cast("double"), F.col("n2").cast("double")
    p = ks_p_exact("ks", "n1", "n2") if method == "exact" else ks_p_asymptotic(F.col("ks"), n, m)
    return out.withColumn("p_value", p).withColumn("similar", F.col("p_value") >= level).withColumn("different", F.col("p_value") < level)


def ks_test(samples: DataFrame, baseline: str, level: float = 0.05, method: str = "exact") -> DataFrame:
    """F01"""
    return ks_all_baselines(samples, samples.sparkSession.createDataFrame([(baseline,)], "baseline string"), level, method)


def draw(n: Column, *parts: Column | str) -> Column:
    """A number in 0 .. n-1 fixed by the parts."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


#: Draws of one experiment that are listed from one row.
DRAWS = 10_000


def ks_bootstrap(ks: DataFrame, n: int, keys: tuple[str, ...] = ("measure", "baseline")) -> DataFrame:
    """cells drawn with replacement, multiplicity kept; mean of ``similar`` per mode and experiment, null where nothing was drawn."""
    keys = list(keys)
    # Read several times below: the tests are made once.
    ks = written(ks.select(*keys, "mode", "cell_id", "similar"), "ks")
    # A cell is one row with its modes, so a draw meets one row.
    mode = ks.groupBy(*keys, "cell_id", "mode").agg(F.sum(F.col("similar").cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    cells = mode.groupBy(*keys, "cell_id").agg(F.collect_list(F.struct("mode", "_s", "_n")).alias("_modes"), F.lit(1).alias("_one"))
    per = written(running_before(cells, keys, "cell_id", "_one", "_no").select(*keys, F.col("_no").cast("int"), "_modes"), "cells")
    size = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    # Stretches of an experiment's draws are dealt out before they are listed: one row a key would list all of them in one task.
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1, F.lit(DRAWS).cast("long")))
    # Their number of partitions is given: stretches are so few that they would all be put into one.
    tasks = int(ks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = size.withColumn("experiment_number", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_from", stretches).repartition(tasks, *keys, "experiment_number", "_from")
    draws = parts.withColumn("_d", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + DRAWS, F.col("_cells")) - 1)))
    draws = draws.withColumn("_no", draw(F.col("_cells"), *keys, F.col("experiment_number").cast("string"), F.col("_d").cast("string")).cast("int"))
    # The planner takes listed draws for as few as their stretches: they are shuffled to the cells and never broadcast.
    drawn = draws.select(*keys, "experiment_number", "_no").join(per.hint("shuffle_hash"), [*keys, "_no"]).select(*keys, "experiment_number", F.explode("_modes").alias("_m"))
    got = drawn.groupBy(*keys, F.col("_m.mode").alias("mode"), "experiment_number").agg(F.try_divide(F.sum("_m._s"), F.sum("_m._n")).alias("similar_fraction"))
    full = mode.select(*keys, "mode").distinct().withColumn("experiment_number", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return full.join(got, [*keys, "mode", "experiment_number"], "left")


def _emd_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of a tile in one range of values: samples of its row with those of its column, each sorted, with the steps of its
    distribution function. Inside the range the difference starts with what lies before it, and it reaches to the ends of the range."""
    rows, columns = pdf[~pdf["across"]], pdf[pdf["across"]]
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    out = []
    for a, x, w, n, p in zip(rows["no"], rows["values"], rows["weights"], rows["n"], rows["before"]):
        for b, y, v, m, q in zip(columns["no"], columns["values"], columns["weights"], columns["n"], columns["before"]):
            if a < b:
                every = np.concatenate([x, y])
                order = np.argsort(every, kind="stable")
                every = every[order]
                start = p / n - q / m
                apart = start + np.cumsum(np.concatenate([w / n, -v / m])[order])
                area = float(np.abs(apart[:-1]) @ np.diff(every))
                if lo is not None and not np.isnan(lo):
                    area += abs(start) * ((every[0] if len(every) else hi if hi is not None and not np.isnan(hi) else lo) - lo)
                if hi is not None and not np.isnan(hi) and len(every):
                    area += abs(apart[-1]) * (hi - every[-1])
                out.append((a, b, int(n), int(m), float(area)))
    return pd.DataFrame(out, columns=["no_1", "no_2", "n1", "n2", "emd"]).assign(measure=pdf["measure"].iloc[0])


def _pack_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """One sample's values in one range as arrays, ascending."""
    order = np.argsort(pdf["value"].to_numpy())
    return pd.DataFrame({"no": pdf["no"].iloc[:1].to_numpy(), "range": pdf["range"].iloc[:1].to_numpy(), "values": [pdf["value"].to_numpy()[order]], "weights": [pdf["w"].to_numpy()[order]], "_in": [float(pdf["w"].sum())]})


def _in_ranges(v: DataFrame, names: DataFrame, values: int) -> DataFrame:
    """Folded samples as a row for each range of values: no, values, weights, n, before (weights below the range), range, lo, hi.

    ``v``: no, value, w; ``names``: measure and no of each sample. Ranges hold about ``values`` values of the measure's largest sample;
    their ends are shared by all samples of a measure, and a sample has a row in each, also where it has no value. The first has no
    lower end and the last no upper one.
    """
    sizes = written(v.groupBy("no").agg(F.count(F.lit(1)).alias("_size"), F.sum("w").alias("n")), "sizes")
    most = sizes.agg(F.max("_size")).first()[0] or 0
    parts = -(-most // values)
    if parts <= 1:
        return sample_arrays(v, ["no"]).select("*", F.lit(0.0).alias("before"), F.lit(0).alias("range"), *[F.lit(None).cast("double").alias(c) for c in ("lo", "hi")])
    of = F.broadcast(names.select("no", "measure"))
    cuts = v.join(of, "no").groupBy("measure").agg(F.array_sort(F.array_distinct(F.percentile_approx("value", [k / parts for k in range(1, parts)], 10_000))).alias("_cuts"))
    cuts = written(names.select("no", "measure").join(F.broadcast(cuts), "measure").select("no", "_cuts"), "cuts")
    at = v.join(F.broadcast(cuts), "no").select("no", F.size(F.filter("_cuts", lambda c: c <= F.col("value"))).alias("range"), "value", "w")
    packed = written(at.groupBy("no", "range").applyInPandas(_pack_range, "no long, range int, values array<double>, weights array<double>, _in double"), "packed")
    every = sizes.join(F.broadcast(cuts), "no").withColumn("range", F.explode(F.sequence(F.lit(0), F.size("_cuts"))))
    empty = F.expr("cast(array() as array<double>)")
    so_far = F.sum(F.coalesce("_in", F.lit(0.0))).over(W.partitionBy("no").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    # The sums of the ranges are told apart from their arrays: no window holds values.
    before = every.join(packed.select("no", "range", "_in"), ["no", "range"], "left").withColumn("before", F.coalesce(so_far, F.lit(0.0))).select("no", "range", "n", "before", F.when(F.col("range") > 0, F.get("_cuts", F.col("range") - 1)).alias("lo"), F.get("_cuts", F.col("range")).alias("hi"))
    return before.join(packed.drop("_in"), ["no", "range"], "left").withColumns({c: F.coalesce(c, empty) for c in ("values", "weights")})


def emd_all_pairs(samples: DataFrame, mode_order: list[str] | None = None, group: tuple[str, ...] = ("mode", "cell_id", "seed"), tile_samples: int = 64, tile_values: int = 2_000_000, range_values: int = 250_000) -> DataFrame:
    """earth mover's distance of all unordered pairs of samples of a measure.

    A sample is one row of sorted distinct values and their counts; where samples have more than ``range_values`` of them, one row for
    each range of values, and a distance is the sum of its parts in the ranges. Samples lie in tiles' rows and columns, at most
    ``tile_samples`` and about ``tile_values`` values in each, so a sample is sent as often as there are tiles in a row, not once for
    every other sample. Values are folded once, under the number of their sample.
    """
    group = list(group)
    valid = valid_samples(samples)
    place = F.array_position(F.array(*[F.lit(m) for m in mode_order]), F.col("mode")) if mode_order else F.lit(0)
    # One row per sample: their pairs are the result, so there are few of them.
    first = W.orderBy("measure", "_place", *group)
    names = valid.select("measure", *group).distinct().withColumn("_place", place).withColumn("no", F.row_number().over(first).cast("long"))
    names = written(names, "sample-names")
    v = valid.join(F.broadcast(names.drop("_place")), ["measure", *group]).groupBy("no", "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    v = written(v, "folded")
    each = written(_in_ranges(v, names, range_values).withColumn("_size", F.size("values")), "samples")
    by = W.partitionBy("measure").orderBy("no")
    share = F.greatest(F.col("_size") / tile_values, F.lit(1.0 / tile_samples))
    largest = each.groupBy("no").agg(F.max("_size").alias("_size"))
    names = names.join(largest, "no").select("measure", *group, "no", F.floor(F.sum(share).over(by.rowsBetween(W.unboundedPreceding, 0)) - share + 1e-9).alias("tile"))
    names = written(names, "sample-numbers")
    tiles = names.select("measure", "tile").distinct()
    told = ["range", "lo", "hi", "no", "values", "weights", "n", "before"]
    at = each.join(F.broadcast(names.select("no", "measure", "tile")), "no").select("measure", "tile", *told)
    across = at.join(F.broadcast(tiles.withColumnRenamed("tile", "other")), "measure")
    rows = across.filter("tile <= other").select("measure", F.col("tile").alias("row"), F.col("other").alias("column"), F.lit(False).alias("across"), *told)
    columns = across.filter("other <= tile").select("measure", F.col("other").alias("row"), F.col("tile").alias("column"), F.lit(True).alias("across"), *told)
    pairs = rows.unionByName(columns).groupBy("measure", "row", "column", "range").applyInPandas(_emd_tile, "no_1 long, no_2 long, n1 long, n2 long, emd double, measure string")
    pairs = pairs.groupBy("measure", "no_1", "no_2").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.sum("emd").alias("emd"))
    for k in (1, 2):
        pairs = pairs.join(names.select("measure", F.col("no").alias(f"no_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in group]), ["measure", f"no_{k}"])
    return pairs.select("measure", *[f"{c}_{k}" for k in (1, 2) for c in group], "n1", "n2", "emd")


def emd_intra(pairs: DataFrame) -> DataFrame:
    """both samples of one mode."""
    return pairs.filter("mode_1 = mode_2")


def emd_vs_baseline(pairs: DataFrame, baseline: str) -> DataFrame:
    """pairs with the baseline on either side, the other sample first."""
    swap = {f"{c}_{a}": f"{c}_{b}" for c in ("mode", "cell_id", "seed") for a, b in ((1, 2), (2, 1)) if f"{c}_{a}" in pairs.columns}
    second = pairs.filter((F.col("mode_1") != baseline) & (F.col("mode_2") == baseline))
    first = pairs.filter((F.col("mode_1") == baseline) & (F.col("mode_2") != baseline)).select(*[F.col(swap.get(c, c)).alias(c) for c in pairs.columns])
    return second.unionByName(first)


def _summary(df: DataFrame, keys: list[str], c: str, population: bool = False) -> DataFrame:
    """keys, n, mean, std, median, and the 2.5 and 97.5 % points. ``df`` is read twice."""
    moments = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.stddev_pop(c) if population else F.stddev_samp(c)).alias("std"))
    return moments.join(exact_quantiles(df, keys, c, {"median": 0.5, "lo": 0.025, "hi": 0.975}), keys, "left")


def emd_summary(pairs: DataFrame) -> DataFrame:
    """by unordered pair of modes, per measure and over all measures (measure null)."""
    p = written(pairs.select(F.least("mode_1", "mode_2").alias("mode_a"), F.greatest("mode_1", "mode_2").alias("mode_b"), "measure", "emd"), "pairs")
    every = _summary(p, ["mode_a", "mode_b"], "emd").withColumn("measure", F.lit(None).cast("string"))
    return _summary(p, ["mode_a", "mode_b", "measure"], "emd").unionByName(every)


def ks_summary(boot: DataFrame) -> DataFrame:
    """F10"""
    return _summary(written(boot.select("measure", "mode", "similar_fraction"), "bootstrap"), ["measure", "mode"], "similar_fraction")


def distance_summary(samples: DataFrame, requested: DataFrame | None = None, minimum: float | None = None) -> DataFrame:
    """all cells and seeds together; requested groups without values are reported with n = 0."""
    got = _summary(valid_samples(samples, minimum), ["measure", "mode"], "value", True)
    wanted = (requested if requested is not None else samples).select("measure", "mode").distinct()
    return wanted.join(got, ["measure", "mode"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def emd_means(pairs: DataFrame) -> DataFrame:
    """F12"""
    return pairs.groupBy("measure", "mode_1", "mode_2").agg(F.avg("emd").alias("mean_emd"))


def emd_by_cell(pairs: DataFrame, baseline: str) -> DataFrame:
    """for each cell of the baseline and each other mode, the mean over that mode's samples."""
    p = emd_vs_baseline(pairs, baseline)
    return p.groupBy("measure", F.col("mode_1").alias("mode"), F.col("cell_id_2").alias("cell_id")).agg(F.avg("emd").alias("mean_emd"))


def similar_fraction_means(boot: DataFrame) -> DataFrame:
    """mean similar fraction of a mode in each measure and over all measures (measure null); absent experiments are skipped."""
    return boot.groupingSets([["measure", "mode"], ["mode"]], "measure", "mode").agg(F.avg("similar_fraction").alias("similar_fraction"))


def ks_means(ks: DataFrame) -> DataFrame:
    """F12"""
    return ks.groupBy("measure", "mode").agg(F.avg(F.col("similar").cast("double")).alias("similar_share"))


def _sides(df: DataFrame, side: str, a: str, b: str, value: str, keys: list[str]) -> DataFrame:
    pick = lambda s, f: f(F.when(F.col(side) == s, F.col(value)))
    return df.groupBy(*keys).agg(*[pick(s, f).cast("double").alias(f"_{n}{k}") for k, s in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])


def cohens_d(df: DataFrame, side: str, a: str, b: str, value: str = "value", keys: list[str] | None = None, signed: bool = True) -> DataFrame:
    """difference of means over the pooled deviation; 0 where that is 0."""
    keys = keys or []
    s = _sides(df, side, a, b, value, keys)
    pooled = F.sqrt(((F.col("_n1") - 1) * F.coalesce("_v1", F.lit(0.0)) + (F.col("_n2") - 1) * F.coalesce("_v2", F.lit(0.0))) / F.when(F.col("_n1") + F.col("_n2") > 2, F.col("_n1") + F.col("_n2") - 2))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("_m1") - F.col("_m2")) / F.when(pooled != 0, pooled))
    return s.select(*keys, (d if signed else F.abs(d)).alias("d"))


#: Fixed bounds of the exact tests: the smaller side of a rank-sum test, the pairs of a signed-rank test.
EXACT_SIDE, EXACT_PAIRS = 8, 50
#: Beyond so many sums to count the exact rank-sum distribution gives way to the normal one.
EXACT_SUMS = 2_000_000


def mann_whitney(df: DataFrame, side: str, a: str, b: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """U of side a, two-sided p, rank-biserial correlation 1 - 2 U / (n1 n2).

    p is counted exactly where nothing is tied and a side has at most ``EXACT_SIDE`` values; else it is normal, with corrections for
    ties and continuity. A group that lacks a side has no p. z is the normal one in either case.
    """
    keys = keys or ["_all"]
    d = df.filter(F.col(side).isin(a, b)).withColumn("_all", F.lit(0)) if keys == ["_all"] else df.filter(F.col(side).isin(a, b))
    # Equal values are one row with their counts; a tie has the mean of its ranks.
    n = lambda s: F.count(F.when(F.col(side) == s, 1))
    folded = running_before(d.groupBy(*keys, value).agg(n(a).alias("_a"), n(b).alias("_b"), F.count(F.lit(1)).alias("_ties")), keys, value, "_ties", "_before")
    rank, t = F.col("_before") + (F.col("_ties") + 1) / 2, F.col("_ties").cast("double")
    g = folded.groupBy(*keys).agg(F.sum(rank * F.col("_a")).alias("_r1"), F.sum("_a").cast("double").alias("_n1"), F.sum("_b").cast("double").alias("_n2"), F.sum(t * (t * t - 1)).alias("_t"))
    u = F.col("_r1") - F.col("_n1") * (F.col("_n1") + 1) / 2
    n, both = F.col("_n1") + F.col("_n2"), F.col("_n1") * F.col("_n2")
    sd = F.sqrt(both / 12 * (n + 1 - F.try_divide(F.col("_t"), n * (n - 1))))
    g = g.withColumn("u", u).withColumn("z", F.try_divide(F.greatest(F.col("u"), both - F.col("u")) - both / 2 - 0.5, sd))
    lesser = F.least(F.col("u"), both - F.col("u"))
    exact = (F.col("_t") == 0) & (F.least("_n1", "_n2") <= EXACT_SIDE) & (lesser < EXACT_SUMS) & (both > 0)
    g = g.withColumn("_exact", rank_sum_p_exact(F.when(exact, lesser), F.col("_n1"), F.col("_n2")))
    normal = F.when(both > 0, F.least(F.lit(1.0), normal_two_sided(F.greatest("z", F.lit(0.0)))))
    out = g.withColumn("p_value", F.coalesce("_exact", normal)).withColumn("rank_biserial", 1 - F.try_divide(2 * F.col("u"), both))
    return out.select(*[k for k in keys if k != "_all"], "u", "z", "p_value", "rank_biserial")


def wilcoxon(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """signed ranks of the differences a - b: the lesser sum, two-sided p, effect.

    Zeros are dropped. p is counted exactly where there are at most ``EXACT_PAIRS`` pairs, no zeros and no ties among the differences;
    else it is normal, corrected for ties. The effect is the normal quantile of 1 - p / 2 over the root of all pairs, zeros included,
    with the sign of the mean difference (plus where that is 0). Pairs without a difference are left out; a group of zeros only has
    statistic 0, no p and no effect.
    """
    keys = keys or ["_all"]
    d = pairs.withColumn("_all", F.lit(0)) if keys == ["_all"] else pairs
    d = d.withColumn("_d", F.col(a) - F.col(b)).filter("_d is not null").withColumn("_abs", F.abs("_d"))
    every = d.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_pairs"), F.avg("_d").alias("_mean"))
    n = lambda c: F.count(F.when(c, 1))
    moved = d.filter("_d <> 0").groupBy(*keys, "_abs").agg(n(F.col("_d") > 0).alias("_a"), n(F.col("_d") < 0).alias("_b"), F.count(F.lit(1)).alias("_ties"))
    folded = running_before(moved, keys, "_abs", "_ties", "_before")
    rank, t = F.col("_before") + (F.col("_ties") + 1) / 2, F.col("_ties").cast("double")
    g = folded.groupBy(*keys).agg(F.sum(rank * F.col("_a")).alias("w_plus"), F.sum(rank * F.col("_b")).alias("w_minus"), F.sum("_ties").cast("double").alias("_n"), F.sum(t * (t * t - 1)).alias("_t"))
    sd = F.sqrt(F.col("_n") * (F.col("_n") + 1) * (2 * F.col("_n") + 1) / 24 - F.col("_t") / 48)
    z = F.try_divide(F.least("w_plus", "w_minus") - F.col("_n") * (F.col("_n") + 1) / 4, sd)
    g = every.join(g, keys, "left").withColumn("statistic", F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0))).withColumn("z", z)
    exact = (F.col("_t") == 0) & (F.col("_pairs") <= EXACT_PAIRS) & (F.col("_pairs") == F.col("_n"))
    g = g.withColumn("_exact", signed_rank_p_exact(F.when(exact, F.col("statistic")), F.col("_n"))).withColumn("p_value", F.coalesce("_exact", normal_two_sided("z")))
    sign = F.when(F.col("_mean") < 0, -1.0).otherwise(1.0)
    effect = sign * F.abs(normal_quantile(F.col("p_value") / 2)) / F.sqrt("_pairs")
    return g.select(*[k for k in keys if k != "_all"], "statistic", "z", "p_value", effect.alias("effect"))


def compare_models(df: DataFrame, with_value: str, without_value: str, k_with: int, k_without: int, keys: list[str]) -> DataFrame:
    """F16: AIC of two sets of distances as residuals, weights, evidence ratio, the better one and a verdict."""

    def aic(c: str, k: int) -> Column:
        n, rss = F.count(c), F.sum(F.col(c) * F.col(c))
        return n * F.ln(rss / n) + 2 * (k + 1)

    g = df.groupBy(*keys).agg(aic(with_value, k_with).alias("aic_with"), aic(without_value, k_without).alias("aic_without"))
    least = F.least("aic_with", "aic_without")
    g = g.withColumn("delta_aic_with", F.col("aic_with") - least).withColumn("delta_aic_without", F.col("aic_without") - least)
    w1, w2 = F.exp(-F.col("delta_aic_with") / 2), F.exp(-F.col("delta_aic_without") / 2)
    g = g.withColumn("weight_with", w1 / (w1 + w2)).withColumn("weight_without", w2 / (w1 + w2))
    return g.select(
        "*", (F.greatest("weight_with", "weight_without") / F.greatest(F.least("weight_with", "weight_without"), F.lit(1e-16))).alias("evidence_ratio"),
        F.when(F.col("aic_with") < F.col("aic_without"), "with structure").otherwise("without structure").alias("best"),
        support_label(F.greatest("delta_aic_with", "delta_aic_without")).alias("interpretation"),
    )


def welch(df: DataFrame, side: str, a: str, b: str, value: str, keys: list[str]) -> DataFrame:
    """t test with unequal variances, and Cohen's d."""
    s = _sides(df, side, a, b, value, keys)
    e1, e2 = F.col("_v1") / F.col("_n1"), F.col("_v2") / F.col("_n2")
    t = F.try_divide(F.col("_m1") - F.col("_m2"), F.sqrt(e1 + e2))
    dof = F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("_n1") - 1) + e2 * e2 / (F.col("_n2") - 1))
    pooled = F.sqrt(((F.col("_n1") - 1) * F.col("_v1") + (F.col("_n2") - 1) * F.col("_v2")) / (F.col("_n1") + F.col("_n2") - 2))
    s = s.filter("_n1 > 1 and _n2 > 1").select(*keys, t.alias("t"), dof.alias("dof"), F.try_divide(F.col("_m1") - F.col("_m2"), pooled).alias("d"))
    return s.withColumn("p_value", student_two_sided("t", "dof"))


def long_rates(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """F18"""
    return wide.unpivot(keys, columns, "rate", "value")


def emd_bound(pairs: DataFrame) -> DataFrame:
    """F18"""
    return exact_quantile(pairs.select(F.lit(0).alias("_all"), "emd"), ["_all"], "emd", 0.99, "_q").select((F.col("_q") * 1.1).alias("bound"))
