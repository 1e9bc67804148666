"""Tables that several plans share are written once, in the folder that all executors see."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's checkpoint folder. A session that names none gets a temporary one in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` and read it back: the lineage is cut, and what builds on it does not compute it again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_before(df: DataFrame, keys: list[str], order: str | list[str], value: str, out: str, size: int = 500_000) -> DataFrame:
    """Sum of ``value`` over the rows of a key that come before each row in ``order``, which no two rows of a key share.

    Rows lie in ranges of (keys, order); a range adds up its own rows and starts at the sum of the ranges before it, so the rows of
    one key may fill any number of tasks. Beyond the session's number of partitions there are as many ranges as keep them at about
    ``size`` rows, so that a task holds no more of a larger table.
    """
    order = [order] if isinstance(order, str) else order
    rows = written(df, "rows")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // size))
    laid = written(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = laid.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    there = laid.repartition(parts, *keys, "_range").join(start, [*keys, "_range"])
    return there.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_start")
