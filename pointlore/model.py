"""The data model: table shapes, key columns, fixed constants, and the driver tables seen in these shapes."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["measure", "mode", "cell_id", "seed"]

# Results depend on them.
PIXEL_SIZE_IN_UM = 0.108
BIN_WIDTH = 0.2
BIN_WIDTH_SCALED = 0.05
PSEUDOCOUNT = 1e-10
MIN_COUNT = 5
ALPHA = 0.05
RATIO_FLOOR = 1e-10
STD_FLOOR = 1e-9

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no minus before zero; both engines agree on these."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def r6_unit(c: Column | str) -> Column:
    """``r6`` of a number between -1 and 1 by arithmetic: rows by the thousand million spend most of their time in a decimal's rounding.

    Half a unit goes away from zero as in ``r6``; a tie is told by the product with a million, as DuckDB tells it.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / F.lit(1e6) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("value").alias("measure"), F.col("event_type").alias("mode"), F.col("user_id").cast("string").alias("cell_id"), F.lit("0").alias("seed"), "value")


SAMPLES_EVENTS = "samples AS (SELECT 'value' AS measure, event_type AS mode, CAST(user_id AS VARCHAR) AS cell_id, '0' AS seed, value FROM events)"


def samples_items(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    pairs = F.array(F.struct(F.lit("quantity").alias("measure"), F.col("l_quantity").alias("value")), F.struct(F.lit("price").alias("measure"), (F.col("l_extendedprice") / 1000).alias("value")))
    return li.select(F.col("l_returnflag").alias("mode"), F.col("l_suppkey").cast("string").alias("cell_id"), F.col("l_linestatus").alias("seed"), F.explode(pairs).alias("p")).select("p.measure", "mode", "cell_id", "seed", "p.value")


SAMPLES_ITEMS = """samples AS (
  SELECT 'quantity' AS measure, l_returnflag AS mode, CAST(l_suppkey AS VARCHAR) AS cell_id, l_linestatus AS seed, l_quantity AS value FROM lineitem
  UNION ALL
  SELECT 'price', l_returnflag, CAST(l_suppkey AS VARCHAR), l_linestatus, l_extendedprice / 1000 FROM lineitem)"""


def samples_orders(spark, d) -> DataFrame:
    """Few large groups: modes are priorities, cells are order states."""
    o = table(spark, d, "orders")
    return o.select(F.lit("price").alias("measure"), F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("cell_id"), F.lit("0").alias("seed"), (F.col("o_totalprice") / 1000).alias("value"))


SAMPLES_ORDERS = "samples AS (SELECT 'price' AS measure, o_orderpriority AS mode, o_orderstatus AS cell_id, '0' AS seed, o_totalprice / 1000 AS value FROM orders)"


def available_orders(spark, d) -> DataFrame:
    """Available space of a cell: all its samples, of every mode."""
    return samples_orders(spark, d).select("measure", F.lit("S1").alias("structure_id"), "cell_id", "value")


AVAILABLE_ORDERS = "available AS (SELECT measure, 'S1' AS structure_id, cell_id, value FROM samples)"


def modes_of(samples: DataFrame) -> DataFrame:
    return samples.select("mode").distinct().withColumn("structure_id", F.lit("S1"))


def points_vec(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    at = lambda k: (F.col("embedding")[k].cast("double") * 10)
    return e.select((F.col("vec_id") % 3).cast("string").alias("mode"), F.col("label").cast("string").alias("cell_id"), F.lit("0").alias("seed"), F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


POINTS_VEC = """points AS (SELECT CAST(vec_id % 3 AS VARCHAR) AS mode, CAST(label AS VARCHAR) AS cell_id, '0' AS seed, vec_id AS point_id,
  CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings)"""


def cells_vec(spark, d) -> DataFrame:
    """Shape facts of the cells of points_vec: bounds of the cell and of its inner half."""
    from .operators.expressions import cell_metrics

    p = points_vec(spark, d)
    b = p.groupBy("cell_id").agg(*[f(c).alias(f"mem_{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    inner = [((F.col(f"mem_{c}_min") + F.col(f"mem_{c}_max")) / 2 + s * (F.col(f"mem_{c}_max") - F.col(f"mem_{c}_min")) / 4).alias(f"nuc_{c}_{n}") for c in "xyz" for n, s in (("min", -1), ("max", 1))]
    return cell_metrics(b.select("*", *inner))


CELLS_VEC = """bounds AS (SELECT cell_id, min(x) AS mem_x_min, max(x) AS mem_x_max, min(y) AS mem_y_min, max(y) AS mem_y_max, min(z) AS mem_z_min, max(z) AS mem_z_max FROM points GROUP BY cell_id),
inner_bounds AS (SELECT *, (mem_x_max - mem_x_min) / 2 AS nx, (mem_y_max - mem_y_min) / 2 AS ny, (mem_z_max - mem_z_min) / 2 AS nz, (mem_z_min + mem_z_max) / 2 + (mem_z_max - mem_z_min) / 4 AS nuc_z_max FROM bounds),
cells AS (SELECT cell_id, mem_z_min, mem_z_max, mem_z_max - mem_z_min AS cell_height, nuc_z_max - mem_z_min AS nuc_height,
  greatest(mem_x_max - mem_x_min, mem_y_max - mem_y_min, mem_z_max - mem_z_min) AS mem_diameter, greatest(nx, ny, nz) AS nuc_diameter,
  (greatest(mem_x_max - mem_x_min, mem_y_max - mem_y_min, mem_z_max - mem_z_min) - greatest(nx, ny, nz)) / 2 AS intracellular_radius FROM inner_bounds)"""
