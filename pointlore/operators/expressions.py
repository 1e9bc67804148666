"""Filters, projections and scalar expressions (B). NaN becomes null on entry and is skipped from there on."""

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..model import KEYS, PIXEL_SIZE_IN_UM

INF = float("inf")


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column, minimum: float | None = None) -> Column:
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)
    return ok if minimum is None else ok & (c >= minimum)


def valid_samples(df: DataFrame, minimum: float | None = None, value: str = "value") -> DataFrame:
    """Finite values, at least ``minimum``."""
    return df.filter(finite(F.col(value), minimum))


def filter_samples(df: DataFrame, minimum: float | None = None, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The valid samples, and the groups that have none left."""
    kept = valid_samples(df, minimum)
    return kept, df.select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti")


def to_um(c: Column, power: int = 1) -> Column:
    """Lengths, areas and volumes from pixels."""
    return c * F.lit(PIXEL_SIZE_IN_UM**power)


def norm_factor(kind: str | None, measure: Column, cell: Column | None = None, largest: Column | None = None) -> Column:
    """The divisor of a measure. Scaled measures stay; a factor of zero or none is an error."""
    if kind == "max_distance":
        factor = largest
    elif kind in ("intracellular_radius", "cell_diameter"):
        factor = cell
    else:
        factor = F.lit(1 / PIXEL_SIZE_IN_UM)
    checked = F.when(factor.isNull() | (factor == 0), F.raise_error(F.lit(f"no factor for {kind}")).cast("double")).otherwise(factor)
    return F.when(measure.contains("scaled"), F.lit(1.0)).otherwise(checked)


def normalize_samples(df: DataFrame, cells: DataFrame, modes: DataFrame, kind: str | None) -> DataFrame:
    """Divide by the factor; cells without shape facts use 1 for the two shape kinds, max_distance is per seed."""
    joined = df
    cell = largest = None
    if kind in ("intracellular_radius", "cell_diameter"):
        column = "intracellular_radius" if kind == "intracellular_radius" else "mem_diameter"
        facts = modes.join(cells.select("structure_id", "cell_id", F.col(column).alias("_f")), "structure_id").select("mode", "cell_id", "_f")
        joined = df.join(facts, ["mode", "cell_id"], "left")
        cell = F.coalesce(F.col("_f"), F.lit(1.0))
    elif kind == "max_distance":
        joined = df.withColumn("_m", F.max("value").over(W.partitionBy(*KEYS)))
        largest = F.col("_m")
    return joined.withColumn("value", F.col("value") / norm_factor(kind, F.col("measure"), cell, largest)).drop("_f", "_m")


def normalize_available(available: DataFrame, cells: DataFrame, kind: str | None, minimum: float | None = None) -> DataFrame:
    """B03 and B01 for the available space of every cell; a cell with nothing left is an error."""
    column = {"intracellular_radius": "intracellular_radius", "cell_diameter": "mem_diameter"}.get(kind)
    df = available.join(cells.select("structure_id", "cell_id", F.col(column).alias("_f")), ["structure_id", "cell_id"]) if column else available
    largest = F.max("value").over(W.partitionBy("measure", "structure_id", "cell_id"))
    df = df.withColumn("value", F.col("value") / norm_factor(kind, F.col("measure"), F.col("_f") if column else None, largest)).drop("_f")
    ok = finite(F.col("value"), minimum)
    left = F.count(F.when(ok, 1)).over(W.partitionBy("measure", "structure_id", "cell_id"))
    return df.withColumn("_left", F.when(left == 0, F.raise_error(F.lit("a cell has no available space"))).otherwise(left)).filter(ok & (F.col("_left") > 0)).drop("_left")


def with_labels(df: DataFrame, labels: DataFrame, key: str, label: str, out: str = "label") -> DataFrame:
    """Look a label up; an unknown key labels itself. ``labels`` is a dimension table."""
    return df.join(labels.select(F.col(key), F.col(label).alias("_l")), key, "left").withColumn(out, F.coalesce("_l", F.col(key))).drop("_l")


def cell_id_from_stem(c: Column, packing: str, condition: str) -> Column:
    """Strip the prefix of the file name, cut at the last seed mark."""
    return F.regexp_replace(F.regexp_replace(c, f"^results_{packing}_{condition}_", ""), "_seed_(?!.*_seed_).*$", "")


def parse_profile_name(c: Column, config: str = "analyze", suffix: str = "_pilr") -> Column:
    """(cell, channel, seed) of a profile file's name: last part is the seed, third from the end the cell, between the configuration's name and the cell stands the channel."""
    name = F.substring_index(c, suffix, 1)
    parts = F.split(name, "_")
    cell = F.try_element_at(parts, F.lit(-3))
    channel = F.call_function("substring_index", F.substring_index(name, f"{config}_", -1), F.concat(F.lit("_"), cell), F.lit(1))
    return F.struct(cell.alias("cell_id"), channel.alias("channel"), F.substring_index(F.element_at(parts, -1), ".", 1).alias("seed"))


def decay_weights(df: DataFrame, length: float | None, keys: list[str], value: str = "distance") -> DataFrame:
    """Distances over their maximum, then an exponential decay rescaled to a maximum of 1, or a linear one."""
    by = W.partitionBy(*keys)
    s = F.try_divide(F.col(value), F.max(value).over(by))
    df = df.withColumn("_s", s)
    if length is None:
        return df.withColumn("weight", 1 - F.col("_s")).drop("_s")
    df = df.withColumn("_w", F.exp(-F.col("_s") / length))
    return df.withColumn("weight", F.try_divide(F.col("_w"), F.max("_w").over(by))).drop("_s", "_w")


def structure_stats(meta: DataFrame, count: str = "count", volume: str = "volume") -> DataFrame:
    """Volume of one unit and its radius (null where count or volume is not positive), sphericity of membrane and nucleus."""
    unit = F.when((F.col(count) > 0) & (F.col(volume) > 0), F.col(volume) / F.col(count))
    sphericity = lambda v, a: F.try_divide(math.pi ** (1 / 3) * F.pow(6 * v, F.lit(2 / 3)), a)
    out = meta.withColumn("unit_volume", unit).withColumn("radius", F.cbrt(3 * unit / (4 * math.pi)))
    for side in ("mem", "nuc"):
        if f"{side}_volume" in meta.columns and f"{side}_area" in meta.columns:
            out = out.withColumn(f"{side}_sphericity", sphericity(F.col(f"{side}_volume"), F.col(f"{side}_area")))
    return out


def cell_metrics(bounds: DataFrame) -> DataFrame:
    """Heights, diameters and intracellular radius from bounds; the nucleus height starts at the membrane's bottom."""
    span = lambda side, c: F.col(f"{side}_{c}_max") - F.col(f"{side}_{c}_min")
    size = lambda side: F.greatest(*[span(side, c) for c in "xyz"])
    return bounds.select(
        "*", span("mem", "z").alias("cell_height"), (F.col("nuc_z_max") - F.col("mem_z_min")).alias("nuc_height"),
        size("mem").alias("mem_diameter"), size("nuc").alias("nuc_diameter"), ((size("mem") - size("nuc")) / 2).alias("intracellular_radius"),
    )


def to_spherical(df: DataFrame, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """R, theta from the z axis, phi."""
    x, y, z = (F.col(c) - F.lit(float(o)) for c, o in zip("xyz", centre))
    return df.select("*", F.sqrt(x * x + y * y + z * z).alias("r"), F.atan2(F.sqrt(x * x + y * y), z).alias("theta"), F.atan2(y, x).alias("phi"))


def expand_box(lo: Column, hi: Column, factor: float) -> tuple[Column, Column]:
    """A box edge scaled about its centre."""
    return (lo + hi) / 2 - (hi - lo) / 2 * factor, (lo + hi) / 2 + (hi - lo) / 2 * factor


def round_out(c: Column) -> Column:
    """Away from zero."""
    return F.signum(c) * F.ceil(F.abs(c))


#: Fixed texts.
EFFECTS = ("Negligible", "Small", "Medium", "Large")
SUPPORT = (
    "Both models have substantial support",
    "Considerably less support for losing model",
    "Little support for losing model",
    "Essentially no support for losing model",
)


def effect_label(c: Column) -> Column:
    """Size of an effect in words."""
    a = F.abs(c)
    return F.when(a < 0.2, EFFECTS[0]).when(a < 0.5, EFFECTS[1]).when(a < 0.8, EFFECTS[2]).otherwise(EFFECTS[3])


def support_label(delta: Column) -> Column:
    """What the losing model's difference in AIC says."""
    return F.when(delta <= 2, SUPPORT[0]).when(delta <= 7, SUPPORT[1]).when(delta <= 10, SUPPORT[2]).otherwise(SUPPORT[3])
