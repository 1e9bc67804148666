"""Occupancy: density of what is occupied over density of what is available (G)."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..model import ALPHA, BIN_WIDTH, MIN_COUNT, PIXEL_SIZE_IN_UM, PSEUDOCOUNT, RATIO_FLOOR
from ..functions.storage import written
from .curves import exact_quantile, fixed_grid, histogram, interp, kde, normalize_pdf, pdf_ratio, pointwise_envelope, r_grid
from .expressions import valid_samples
from .twosample import emd_all_pairs, ks_all_baselines

CELL = ["measure", "mode", "cell_id"]
PLACE = ["measure", "structure_id", "cell_id"]


def cells_by_structure(samples: DataFrame, modes: DataFrame, cap: int | None = None, seed: str = "cells") -> DataFrame:
    """Cells of each structure over all its modes; at most ``cap`` of them, in md5 order."""
    cells = samples.join(modes, "mode").select("structure_id", "cell_id").distinct()
    if cap is None:
        return cells
    order = F.row_number().over(W.partitionBy("structure_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "structure_id", "cell_id")), "cell_id"))
    return cells.withColumn("_o", order).filter(F.col("_o") <= cap).drop("_o")


def occupied_available(samples: DataFrame, available: DataFrame, modes: DataFrame, pixel: float | None = PIXEL_SIZE_IN_UM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occupied and available values in micrometres; occupied beyond the available maximum is dropped.

    Also gives, per cell, how many values were dropped, and cells (mode, cell) without available space.
    """
    scale = F.when(F.col("measure").contains("scaled"), 1.0).otherwise(pixel) if pixel else F.lit(1.0)
    occ = valid_samples(samples).join(modes, "mode").withColumn("value", F.col("value") * scale)
    av = valid_samples(available).withColumn("value", F.col("value") * scale)
    top = av.groupBy(*PLACE).agg(F.max("value").alias("_top"))
    joined = occ.join(top, PLACE, "left")
    kept = joined.filter(F.col("value") <= F.col("_top"))
    report = joined.groupBy(*CELL, "structure_id").agg(F.count(F.when(F.col("value") > F.col("_top"), 1)).alias("beyond"), F.max("_top").isNull().alias("no_space"))
    return kept.drop("_top"), av, report


def _per_cell_available(av: DataFrame, kept: DataFrame) -> DataFrame:
    """Available rows once per (mode, cell): for operators whose output is per mode."""
    return av.join(kept.select(*CELL, "structure_id").distinct(), PLACE)


def binned_occupancy(occ: DataFrame, av: DataFrame, width: float = BIN_WIDTH, pseudo: float = PSEUDOCOUNT, min_count: int = MIN_COUNT) -> DataFrame:
    """Per cell, ratio of the two histograms on the grid of the cell's own available space; null where that space is sparse.

    The available side is counted once per cell, whatever the number of modes.
    """
    grid = r_grid(av, PLACE, bin_width=width)
    h_av = histogram(av, grid, PLACE, PLACE, width)
    h_occ = histogram(occ, grid, [*CELL, "structure_id"], PLACE, width)
    den = h_av.withColumnRenamed("y", "raw_avail")
    add = lambda df, c: df.withColumn("y", F.col(c) + pseudo)
    pdf_a = normalize_pdf(add(den, "raw_avail"), PLACE).select(*PLACE, "i", "raw_avail", F.col("y").alias("pdf_avail"))
    pdf_o = normalize_pdf(add(h_occ.withColumnRenamed("y", "raw_occ"), "raw_occ"), CELL).withColumnRenamed("y", "pdf_occ")
    ratio = F.exp(F.ln(F.greatest("pdf_occ", F.lit(RATIO_FLOOR))) - F.ln(F.greatest("pdf_avail", F.lit(RATIO_FLOOR))))
    out = pdf_o.join(pdf_a, [*PLACE, "i"])
    value = F.when(F.col("pdf_occ").isNull() | F.col("pdf_avail").isNull(), 0.0).otherwise(ratio)
    return out.select(*CELL, "structure_id", "i", "x", F.when(F.col("raw_avail") >= min_count, value).alias("occupancy"), "pdf_occ", "pdf_avail", "raw_occ", "raw_avail")


def common_grid(av: DataFrame, width: float = BIN_WIDTH, limits: tuple[float, float] | None = None) -> DataFrame:
    """One grid per measure, from all available space or from limits."""
    return fixed_grid(av, ["measure"], *limits, width, "occupancy") if limits else r_grid(av, ["measure"], bin_width=width)


def occupancy_common(cell_curves: DataFrame, grid: DataFrame, column: str = "occupancy") -> DataFrame:
    """Per-cell curves on the common grid, null outside their range."""
    c = cell_curves.select(*CELL, "i", "x", F.col(column).alias("y"))
    return interp(c, grid, CELL, ["measure"], "null").withColumnRenamed("y", "occupancy")


def combine_occupancy(common: DataFrame, occ: DataFrame | None = None, av: DataFrame | None = None, grid: DataFrame | None = None, width: float = BIN_WIDTH, pseudo: float = PSEUDOCOUNT, alpha: float = ALPHA) -> DataFrame:
    """Mean and deviation over cells without nulls, envelope with null as 0, and the ratio of all values together."""
    by = ["measure", "mode", "i"]
    stats = common.groupBy(*by).agg(F.max("x").alias("x"), F.coalesce(F.avg("occupancy"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("occupancy"), F.lit(0.0)).alias("std"))
    env = pointwise_envelope(common.withColumn("y", F.coalesce("occupancy", F.lit(0.0))), ["measure", "mode"], alpha).select(*by, "lo", "hi")
    out = stats.join(env, by)
    if occ is None:
        return out.withColumn("pooled", F.lit(None).cast("double"))
    key = ["measure", "mode"]
    ho = histogram(occ, grid, key, ["measure"], width).withColumn("y", F.col("y") + pseudo)
    # Available space of every cell that the mode has, pooled.
    counted = histogram(av, grid, PLACE, ["measure"], width)
    ha = counted.join(occ.select(*CELL, "structure_id").distinct(), PLACE).groupBy(*key, "i", "x").agg((F.sum("y") + pseudo).alias("y"))
    return out.join(pdf_ratio(ho, ha, key).select(*by, F.col("y").alias("pooled")), by, "left")


def occupancy_binned(samples: DataFrame, available: DataFrame, modes: DataFrame, width: float = BIN_WIDTH, pseudo: float = PSEUDOCOUNT, min_count: int = MIN_COUNT, limits: tuple[float, float] | None = None, cap: int | None = None, pixel: float | None = PIXEL_SIZE_IN_UM) -> tuple[DataFrame, DataFrame]:
    """G01 to G06 for all measures that have available space: curves per cell on the common grid, and combined ones."""
    if cap is not None:
        chosen = cells_by_structure(samples, modes, cap)
        samples = samples.join(chosen.select("cell_id").distinct(), "cell_id", "left_semi")
        available = available.join(chosen, ["structure_id", "cell_id"], "left_semi")
    occ, av, _ = occupied_available(samples, available, modes, pixel)
    grid = common_grid(av, width, limits)
    common = occupancy_common(binned_occupancy(occ, av, width, pseudo, min_count), grid)
    return common, combine_occupancy(common, occ, av, grid, width, pseudo)


def kde_occupancy_cell(occ: DataFrame, av: DataFrame, n: int = 100, bandwidth: str | float = "scott") -> DataFrame:
    """Per cell, ratio of kernel densities from the least available value (0 at least) to the 95 % point."""
    ends = av.groupBy(*PLACE).agg(F.greatest(F.lit(0.0), F.min("value")).alias("x0"), F.percentile("value", F.lit(0.95)).alias("x1")).withColumn("n", F.lit(n))
    return _kde_ratio(occ, av, ends, PLACE, bandwidth)


def _kde_ratio(occ, av, ends, grid_keys, bandwidth) -> DataFrame:
    from .curves import _grid

    grid = _grid(ends, grid_keys)
    ka = kde(av, grid, PLACE, grid_keys, bandwidth)
    ko = kde(occ, grid, [*CELL, "structure_id"], grid_keys, bandwidth)
    ka = ka.join(ko.select(*CELL, "structure_id").distinct(), PLACE)
    return pdf_ratio(ko, ka, [*CELL, "structure_id"]).withColumnRenamed("y", "occupancy")


def kde_common_grid(av: DataFrame, n: int = 100, percentile: float = 0.05, x_max: float | None = None) -> DataFrame:
    """Grid per measure up to the given percentile of the cells' largest available values (0 to 100)."""
    tops = written(av.groupBy(*PLACE).agg(F.max("value").alias("top")), "tops")
    cut = exact_quantile(tops, ["measure"], "top", percentile / 100, "_cut")
    if x_max is None:
        ends = cut.select("measure", F.col("_cut").alias("x1"))
    else:
        under = tops.join(F.broadcast(cut), "measure").groupBy("measure").agg(F.max(F.when(F.col("top") <= F.col("_cut"), F.col("top"))).alias("_under"))
        ends = under.select("measure", F.least(F.lit(float(x_max)), F.col("_under")).alias("x1"))
    from .curves import _grid

    return _grid(ends.select("measure", F.lit(n).alias("n"), F.lit(0.0).alias("x0"), "x1"), ["measure"])


def occupancy_kde(samples: DataFrame, available: DataFrame, modes: DataFrame, n: int = 100, percentile: float = 0.05, x_max: float | None = None, bandwidth: str | float = "scott", pixel: float | None = PIXEL_SIZE_IN_UM) -> tuple[DataFrame, DataFrame]:
    """Kernel densities on the common grid, null above each cell's 95 % point; combined without a pooled ratio."""
    occ, av, _ = occupied_available(samples, available, modes, pixel)
    grid = kde_common_grid(av, n, percentile, x_max)
    ends = grid.groupBy("measure").agg(F.max("n").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    cell = _kde_ratio(occ, av, ends, ["measure"], bandwidth)
    p95 = av.groupBy(*PLACE).agg(F.percentile("value", F.lit(0.95)).alias("_p"))
    cell = cell.join(p95, PLACE).withColumn("occupancy", F.when(F.col("x") <= F.col("_p"), F.col("occupancy"))).select(*CELL, "i", "x", "occupancy")
    return cell, combine_occupancy(cell)


def sample_range(df: DataFrame, keys: list[str]) -> DataFrame:
    """G11"""
    return valid_samples(df).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def x_limit(occ: DataFrame, pct: float) -> DataFrame:
    """Percentile of the grid positions of a measure."""
    return exact_quantile(occ, ["measure"], "x", pct / 100, "x_limit")


def _values(occ: DataFrame) -> DataFrame:
    return occ.select("measure", "mode", "cell_id", F.lit("0").alias("seed"), F.col("occupancy").alias("value"))


def occupancy_emd(occ: DataFrame) -> DataFrame:
    """earth mover's distance of the finite ratio values of all pairs of cells; a side without values gives null."""
    v = _values(occ)
    pairs = emd_all_pairs(v, None, ("mode", "cell_id"))
    ids = v.select("measure", "mode", "cell_id").distinct()
    full = v.select("measure", "mode", "cell_id").distinct().withColumn("_id", F.struct("mode", "cell_id"))
    a = full.select("measure", F.col("_id").alias("_a"), F.col("mode").alias("mode_1"), F.col("cell_id").alias("cell_id_1"))
    b = ids.withColumn("_b", F.struct("mode", "cell_id")).select("measure", "_b", F.col("mode").alias("mode_2"), F.col("cell_id").alias("cell_id_2"))
    every = a.join(b, "measure").filter("_a < _b").drop("_a", "_b")
    return every.join(pairs.select(*every.columns, "emd"), every.columns, "left")


def occupancy_ks(occ: DataFrame, baseline: DataFrame, level: float = 0.05, method: str = "exact") -> DataFrame:
    """KS test of each cell's ratio values against the baseline's of the same cell."""
    return ks_all_baselines(_values(occ), baseline, level, method)
