"""Helpers shared by the training-data operators."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A session that names none gets a temporary one in local mode and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_open_scopes: list[list[DataFrame]] = []


def telling(df: DataFrame, **told: Column) -> DataFrame:
    """``df``, of which ``stage`` is to tell these aggregates."""
    df.asked = told
    return df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and any executor may be lost.

    The write also tells ``n_rows`` and what ``telling`` asks for (``told``), so that no other job counts what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen, asked = Observation(), [F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in getattr(df, "asked", {}).items()]]
    df.observe(seen, *asked).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    out.told = seen.get or out.agg(*asked).first().asDict()  # a plan that the optimizer empties tells nothing
    out.n_rows = out.told["n_rows"]
    if _open_scopes:
        _open_scopes[-1].append(out)
    return out


def drop(*staged: DataFrame | None) -> None:
    """Delete the files of staged tables that no plan will read again."""
    for df in staged:
        path = getattr(df, "staged_at", None)
        if path:
            df.staged_at = None
            jvm_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """``with Scratch() as s``: tables staged inside are deleted at its end, but for those that ``s.keep`` has passed on."""

    def __enter__(self) -> "Scratch":
        self.kept: list[DataFrame] = []
        _open_scopes.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, failed, *_) -> None:
        inside = _open_scopes.pop()
        if failed:
            return
        for df in inside:
            if not any(df is k for k in self.kept):
                drop(df)
            elif _open_scopes:
                _open_scopes[-1].append(df)


def uniform(*cols: Column | str, seed: str = "") -> Column:
    """A number in (0, 1) fixed by the columns and the seed; DuckDB's md5 gives the same one."""
    text = F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, within ``keys`` by ``bucket`` and then ``order``.

    No task sees a whole key: sums of the buckets give each bucket its offset, and windows run inside
    (keys, bucket) only. ``bucket`` must not fall as ``order`` rises; keys and bucket must not be null.
    """
    per_bucket = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offset = per_bucket.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(offset, [*keys, bucket])
        .withColumn(out, (F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_off")
    )


def with_groups(df: DataFrame, groups: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Left join of rows with their groups; ``weight`` tells how many of the ``total`` rows a group has, and is dropped.

    Groups of more than a 10,000th of the rows are fewer than 10,000: those are broadcast, so their rows stay where they are. No
    key of the shuffled join that is left has more rows than that. Groups staged with their ``least`` and ``most`` weight meet the
    rows in one join where all of them are on one side.
    """
    told = getattr(groups, "told", {})
    if told.get("least") is not None and told["least"] * 10_000 > total:
        return df.join(F.broadcast(groups.drop(weight)), on, "left")
    if told.get("most") is not None and told["most"] * 10_000 <= total:
        return df.join(groups.drop(weight), on, "left")
    hot = F.col(weight) * 10_000 > total
    large, small = groups.filter(hot).drop(weight), groups.filter(~hot).drop(weight)
    there = df.join(F.broadcast(large.withColumn("_there", F.lit(True))), on, "left")
    rest = df.join(F.broadcast(large.select(*on)), on, "left_anti").join(small, on, "left")
    return there.filter("_there").drop("_there").unionByName(rest)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, pattern: str, valid=None, context: int = 32) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: array of (s, e, v, b, f).

    s and e count code points, e is exclusive, v is the matched text, b the last ``context`` characters
    before it and f the first ones after it. ``valid`` keeps a match or drops it, without a retry.
    Matches come from regexp_extract_all and their places from the lengths of the pieces between them,
    so everything stays in the JVM. Places are added up in stretches of about the square root of the
    number of matches: within a stretch from its own start, between stretches from their sums. So the
    work grows with n * sqrt(n) of n matches, not with their square.
    """
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string,b:string,f:string>>)")
    no_number = F.expr("cast(array() as array<int>)")
    size = F.lit(context)

    def place(at: Column, x: Column) -> Column:
        return F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + x))

    def stretches(parts: Column) -> Column:
        step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(parts).cast("double"))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.size(parts), step), lambda at: F.slice(parts, at, step))

    def ends_in(stretch: Column) -> Column:
        return F.aggregate(stretch, no_number, lambda at, x: place(at, F.length(x["p"]) + F.length(x["v"])))

    def add_starts(ends: Column) -> Column:
        before = F.aggregate(ends, no_number, lambda at, x: place(at, F.element_at(x, -1)))
        return F.flatten(F.transform(ends, lambda x, i: let(F.when(i > 0, F.get(before, i - 1)).otherwise(0), lambda o: F.transform(x, lambda e: e + o))))

    def hits(pieces: Column, found: Column) -> Column:
        parts = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
        ends = let(parts, lambda x: let(F.transform(stretches(x), ends_in), add_starts))

        def hit(x: Column, i: Column) -> Column:
            near = F.when(F.length(F.get(pieces, i)) < context, F.concat(F.coalesce(F.right(F.get(pieces, i - 1), size), F.lit("")), F.coalesce(F.get(found, i - 1), F.lit("")), F.get(pieces, i)))
            before = F.right(F.coalesce(near, F.get(pieces, i)), size)
            return F.struct((x["e"] - F.length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v"), before.alias("b"), F.left(F.get(pieces, i + 1), size).alias("f"))

        every = F.transform(F.zip_with(found, ends, lambda v, e: F.struct(v.alias("v"), e.alias("e"))), hit)
        return every if valid is None else F.filter(every, lambda h: F.coalesce(valid(h["v"]), F.lit(False)))

    looked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda pieces: hits(pieces, found))).otherwise(none))
    return F.when(text.rlike(pattern), looked).otherwise(none)


def probably_in(df: DataFrame, key: Column, keys: DataFrame, out: str, bits: int = 27, most: int | None = None) -> DataFrame:
    """``df`` with a boolean ``out``: whether its long ``key`` may be among the longs of ``keys`` (one column).

    No key that is there is missed. A bitmap of at most 2**bits bits (16 MB) is broadcast; what hits it
    by chance is for the caller to tell apart. ``most`` bounds the number of keys where it is known; else they are counted.
    """
    slots = 1 << max(15, min(bits, (32 * (keys.count() if most is None else most)).bit_length()))
    place = F.pmod(F.xxhash64(keys.columns[0]), F.lit(slots))
    marks = keys.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bitmap"))
    probe = df.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(slots))).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(marks), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position("_p") % 8).cast("int")) == 1, F.lit(False))
    return probe.withColumn(out, hit).drop("_p", "_bucket", "_bitmap")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, bits: int = 27, most: int | None = None) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be among the longs of ``keys``: none of those is missed."""
    return probably_in(df, key, keys, "_hit", bits, most).filter("_hit").drop("_hit")


def weights(name: str) -> dict[str, Column]:
    """What ``with_groups`` wants to know of staged groups."""
    return {"least": F.min(name), "most": F.max(name)}


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], label: str) -> DataFrame:
    """``df`` with ``pos``, the place of each row within its keys by ``order`` (from 0), and ``n``, the rows of its keys.

    Keys must not be null. Rows lie in ranges of (keys, order), written once; a range numbers its own rows and starts at the count of
    the ranges before it, so that one key may fill any number of tasks. Rows that agree in ``order`` get places in any sequence.
    """
    laid = stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), label)
    every, before = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = laid.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"), F.sum("_rows").over(every).alias("n"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order)
    return laid.join(starts, [*keys, "_range"]).withColumn("pos", (F.col("_start") + F.row_number().over(inside) - 1).cast("long")).drop("_range", "_start")


#: DuckDB: crc_table (t), the 256 remainders of the checksum's polynomial.
CRC32_TABLE_SQL = ", ".join(
    ["crc_0 AS (SELECT i AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i))"]
    + [f"crc_{k + 1} AS (SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM crc_{k})" for k in range(8)]
    + ["crc_table AS (SELECT list(v ORDER BY k) AS t FROM crc_8)"]
)


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned CRC-32 of an ASCII text, where crc_table is joined."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"
