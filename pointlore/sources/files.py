"""Sources, sinks and materialised results (A)."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

POSITIONS = "map<string, map<string, array<array<double>>>>"


def _points(parsed: DataFrame, ingredient: str, keep: list[str]) -> DataFrame:
    cells = parsed.select(*keep, F.explode("_json").alias("key", "ingredients"))
    found = F.col("ingredients")[ingredient]
    bad = F.raise_error(F.concat(F.lit(f"no ingredient {ingredient} in "), F.col("key"))).cast("array<array<double>>")
    cells = cells.withColumn("_p", F.when(found.isNull(), bad).otherwise(found))
    return cells.select(*keep, "key", F.posexplode("_p").alias("point_id", "_xyz")).select(*keep, "key", "point_id", *[F.col("_xyz")[j].alias(c) for j, c in enumerate("xyz")])


def read_points(spark: SparkSession, path: str, ingredient: str) -> DataFrame:
    """Positions JSON to cell_id, seed, point_id, x, y, z. A key of one part has seed '0', one of more than two is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", POSITIONS).alias("_json"))
    p = _points(raw, ingredient, [])
    parts = F.split("key", "_")
    bad = F.raise_error(F.concat(F.lit("unexpected key "), F.col("key"))).cast("string")
    seed = F.when(F.size(parts) == 1, "0").when(F.size(parts) == 2, parts[1]).otherwise(bad)
    return p.select(parts[0].alias("cell_id"), seed.alias("seed"), "point_id", "x", "y", "z")


def read_point_files(spark: SparkSession, folder: str, rule: str, ingredient: str, prefix: str = "positions_", output: str | None = None) -> DataFrame:
    """The files of a rule together. The key is {last part of the file's name}_{inner key}; nothing is written.

    A folder whose name ends in .json, as Spark's writer makes them, counts as a file of that name.
    """
    every = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    raw = every.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+\.json)(?:/[^/]*)?$", 1).alias("_file"), "value").filter(F.col("_file").startswith(prefix))
    raw = raw.filter(F.col("_file").contains(rule))
    if "invert" not in rule:
        raw = raw.filter(~F.col("_file").contains("invert"))
    if output:
        raw = raw.filter(F.col("_file") != output)
    p = _points(raw.select("_file", F.from_json("value", POSITIONS).alias("_json")), ingredient, ["_file"])
    stem = F.regexp_replace("_file", r"\.json$", "")
    return p.select(F.element_at(F.split(stem, "_"), -1).alias("cell_id"), F.col("key").alias("seed"), "point_id", "x", "y", "z")


def read_all_modes(spark: SparkSession, modes: dict[str, dict]) -> DataFrame:
    """Mode -> {"path", "ingredient"} for observed, or {"folder", "rule", "ingredient"} for simulated positions."""

    def one(mode: str, how: dict) -> DataFrame:
        df = read_points(spark, how["path"], how["ingredient"]) if "path" in how else read_point_files(spark, how["folder"], how["rule"], how["ingredient"])
        return df.select(F.lit(mode).alias("mode"), "*")

    return reduce(DataFrame.unionByName, [one(m, h) for m, h in modes.items()])


def load_table(spark: SparkSession, name: str, places: list[str], keep: str | None = None) -> DataFrame:
    """The first place that has the table; an empty table is an error; ``keep`` writes a copy."""
    last: Exception | None = None
    for k, place in enumerate(places):
        try:
            df = spark.read.parquet(f"{place.rstrip('/')}/{name}.parquet")
        except Exception as e:  # the next place may have it
            last = e
            continue
        if df.isEmpty():
            raise ValueError(f"{name} is empty")
        if keep and k > 0:
            df.write.mode("overwrite").parquet(f"{keep.rstrip('/')}/{name}.parquet")
        return df
    raise FileNotFoundError(name) from last


def ingest_csv(spark: SparkSession, path: str, out: str, schema: str, key: str = "CellId") -> DataFrame:
    """CSV with a header to Parquet; rows without a key are refused."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    df = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row has no {key}")).cast(dict(df.dtypes)[key])).otherwise(F.col(key)))
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def ordinals(lines: DataFrame) -> DataFrame:
    """``lines`` (file, block, at and others) with ``no``, the place of each in its file from 0.

    A file is read in blocks of bytes, each by a task of its own. A block numbers its own lines and starts at the count of the blocks
    before it in the file.
    """
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("file", "block", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return lines.join(starts, ["file", "block"]).withColumn("no", F.col("_start") + inside).drop("_start", "block", "at")


def read_meshes(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """OBJ files: vertices (file, vertex, x, y, z) and triangles (file, tri_id, ax .. cz). Polygons become fans.

    A file of any size is read in blocks; vertices and faces are numbered over them. Other lines (vn, vt, comments) are left out.
    """
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))

    def of(kind: str) -> DataFrame:
        return ordinals(lines.filter(F.col("value").rlike(rf"^{kind}\s")).select("file", "block", "at", F.split("value", r"\s+").alias("_t")))

    v = of("v").select("file", (F.col("no") + 1).cast("int").alias("vertex"), *[F.col("_t")[j + 1].cast("double").alias(c) for j, c in enumerate("xyz")])
    corner = lambda s: F.split(s, "/")[0].cast("int")
    f = of("f").withColumn("_c", F.transform(F.slice("_t", F.lit(2), F.size("_t")), corner)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_c") - 2)))
    tri = f.select("file", (F.shiftleft(F.col("no").cast("long"), 32) + F.col("_k")).alias("tri_id"), F.col("_c")[0].alias("a"), F.col("_c")[F.col("_k")].alias("b"), F.col("_c")[F.col("_k") + 1].alias("c"))
    for k in "abc":
        tri = tri.join(v.select("file", F.col("vertex").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), ["file", k])
    return v, tri.drop("a", "b", "c")


def missing_pairs(requested_measures: DataFrame, requested_modes: DataFrame, stored: DataFrame) -> DataFrame:
    """(measure, mode) that are asked for and not stored."""
    return requested_measures.select("measure").distinct().crossJoin(F.broadcast(requested_modes.select("mode").distinct())).join(stored.select("measure", "mode").distinct(), ["measure", "mode"], "left_anti")


def refresh(spark: SparkSession, path: str, measures: list[str], modes: list[str], compute, recalculate: bool = False) -> DataFrame:
    """compute(missing pairs) is written to its own partitions; complete ones are not touched."""
    m, o = spark.createDataFrame([(x,) for x in measures], "measure string"), spark.createDataFrame([(x,) for x in modes], "mode string")
    try:
        stored = spark.read.parquet(path)
    except Exception:  # nothing is stored yet
        stored = None
    wanted = m.crossJoin(o) if recalculate or stored is None else missing_pairs(m, o, stored)
    if not wanted.isEmpty():
        compute(wanted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("measure", "mode").parquet(path)
    return spark.read.parquet(path).join(F.broadcast(m), "measure", "left_semi").join(F.broadcast(o), "mode", "left_semi")


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A08"""
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.parquet(path)


def check_complete(df: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Difference between the stored and the expected keys; missing columns are an error."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    keys = expected.columns
    have = df.select(*keys).distinct()
    return expected.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(expected).withColumn("problem", F.lit("unexpected")))


def point_inventory(points: DataFrame) -> DataFrame:
    """A10"""
    return points.groupBy("mode").agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct(F.struct("cell_id", "seed")).alias("seeds"))
