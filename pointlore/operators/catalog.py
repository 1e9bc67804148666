"""Catalogues and bookkeeping tables (K)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import _index_below


def cells_for(catalog: DataFrame, structure: str, subset: bool = False) -> DataFrame:
    """K01"""
    c = catalog.filter(F.col("structure_name") == structure)
    if subset:
        c = c.filter(F.col("8dsphere"))
    return c.select(F.col("CellId").cast("string").alias("cell_id"))


def sample_cells(df: DataFrame, n: int | None, seed: str = "0") -> DataFrame:
    """N cells without replacement, in md5 order; all of them if n is null or larger."""
    return df if n is None else df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "cell_id")), "cell_id").limit(n)


def restrict(meta: DataFrame, catalog: DataFrame) -> DataFrame:
    """K03"""
    return meta.join(catalog.select("structure_name", "CellId"), ["structure_name", "CellId"], "left_semi")


def structure_summary(stats: DataFrame, columns: tuple[str, ...] = ("radius", "count", "volume")) -> DataFrame:
    """K04"""
    return stats.groupBy("structure_name").agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def metric_summary(cells: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Mean, population deviation, range of every metric, in long form."""
    long = cells.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def metric_histogram(cells: DataFrame, metric: str, keys: list[str], width: float) -> DataFrame:
    """Histogram of a metric per key: bins of ``width`` from the least value on, the last one closed; empty bins count 0.

    A value lies in the bin of the last edge, least value + bin * width, that is not above it."""
    v = cells.filter(F.col(metric).isNotNull()).select(*keys, F.col(metric).cast("double").alias("_v"))
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_bins", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo")) / width)).cast("int"))
    placed = v.join(ends, keys).groupBy(*keys, F.least(_index_below(F.col("_v"), F.col("_lo"), F.lit(float(width))).cast("int"), F.col("_bins") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    return every.join(placed, [*keys, "bin"], "left").select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), F.coalesce("_c", F.lit(0)).alias("count"))


def release_table(files: DataFrame, stats: DataFrame, structures: DataFrame) -> DataFrame:
    """Files (stem, packing, condition, structure_name, rule) with cell id, rounded statistics and short rule."""
    f = files.withColumn("CellId", F.expr("regexp_replace(regexp_replace(stem, concat('^results_', packing, '_', condition, '_'), ''), '_seed_(?!.*_seed_).*$', '')"))
    f = f.join(structures.select("structure_name"), "structure_name", "left_semi").withColumn("rule_short", F.substring_index("rule", "_", 1))
    numbers = [c for c, t in stats.dtypes if t == "double"]
    rounded = stats.select("structure_name", "CellId", *[F.round(c, 4 if "sphericity" in c else 2).alias(c) for c in numbers])
    return f.join(rounded, ["structure_name", "CellId"], "left")


def refresh_stats(catalog: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """The statistics columns of an existing catalogue anew."""
    return catalog.drop(*columns).join(stats.select("structure_name", "CellId", *columns), ["structure_name", "CellId"], "left")


def column_metadata(df: DataFrame, described: dict[str, str]) -> DataFrame:
    """One row per column of ``df``: name, type, description."""
    return df.sparkSession.createDataFrame([(c, t, described.get(c, "")) for c, t in df.dtypes], "column string, type string, description string")


def missing_work(expected: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, seed) without output, and items with expected, present and done (all seeds there)."""
    missing = expected.join(present.select("item", "seed").distinct(), ["item", "seed"], "left_anti")
    there = expected.join(present.select("item", "seed").distinct().withColumn("_p", F.lit(1)), ["item", "seed"], "left")
    return missing, there.groupBy("item").agg(F.count(F.lit(1)).alias("expected"), F.count("_p").alias("present"), (F.count("_p") == F.count(F.lit(1))).alias("done"))


def outcome_summary(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Count by rule and status; expected items without a result are 'missing', results nobody expected 'unexpected'."""
    j = expected.select("rule", "item").distinct().withColumn("_e", F.lit(1)).join(results.select("rule", "item", "status"), ["rule", "item"], "full_outer")
    status = F.when(F.col("status").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise(F.col("status"))
    return j.groupBy("rule", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_parameters(rules: DataFrame, cells: DataFrame, stats: DataFrame, replicates: int = 1) -> DataFrame:
    """Every rule with every cell: count, radius and seed; with one replicate the seed is the cell's number."""
    r = cells.crossJoin(F.broadcast(rules)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    seed = F.expr("try_cast(cell_id as bigint)") if replicates == 1 else F.col("replicate").cast("long")
    return r.join(stats.select("cell_id", "count", "radius"), "cell_id", "left").withColumn("seed", seed)


