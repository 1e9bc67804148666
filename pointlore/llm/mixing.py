"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u)/w, u fixed by its id, its text and the seed, w its quality weight.
Within a source, documents stand in the order of their keys, and a running sum of their sizes meets
the source's budget of words. Complete epochs come first: budget div source size; the rest of the
budget takes documents in key order, the last one in part, so that each source meets its target to
the word. Only DataFrame functions are used.

A null or empty text has size 0 and nothing is taken of it; a null source is a source of its own, last
in order; a null id is an id; repeated rows are documents of their own with draws of their own, as a number
tells those of one id, source and text apart. An empty table gives an empty result. Extra columns are ignored.
"""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import numbered, running_total, stage, table, uniform, with_groups

WORD = r"[^ \t-\r]+"
SYMBOLS = r"[|#*%&$!]"


def quality_weight(text, size):
    """Between 1/21 and 1: falls with the share of symbol characters."""
    left = F.length(F.regexp_replace(text, SYMBOLS, "")).cast("double")
    n = F.length(text).cast("double")
    return F.when(size > 0, 1.0 / (1.0 + 20.0 * ((n - left) / n))).otherwise(1.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Per source: source_no, source_size, target. One row per source; the windows run over sources only.

    The water level is total weight's share of what capped sources leave: with the sources in order of
    size per weight, it is the largest of the levels that hold before each one.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    no = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("source_no", no).withColumn("weight", F.array(*[F.lit(w) for w in weights])[(F.col("source_no") - 1) % len(weights)])
    before = W.orderBy(cap * F.col("source_size") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.max("_level").over(every)
    per = per.withColumn("_level", left.cast("double") / heavy.cast("double"))
    return per.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))).drop("_level", "weight")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    columns: tuple[str, str, str] = ("doc_id", "source", "text"),
    row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``row``: a column that tells rows apart; it is kept and breaks ties.
    """
    own = [row] if row else []
    doc_id, source, text = (F.col(c) for c in columns)
    text = F.coalesce(text.cast("string"), F.lit(""))
    read = docs.select(*own, doc_id.alias("doc_id"), source.cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("text"))
    weighed = stage(read.select(*own, "doc_id", "source", "size", quality_weight(F.col("text"), F.col("size")).alias("quality"), F.md5(F.col("text").cast("binary")).alias("mark"), F.monotonically_increasing_id().alias("at")), "mix-read")
    # A draw is fixed by the id and the text; rows that share both, and the source, are told apart by a number.
    alike = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("-")), "mark", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))).cast("binary"))
    weighed = weighed.withColumn("alike", alike)
    same = weighed.groupBy("alike").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    told_apart = same.isEmpty()
    if told_apart:
        drawn = weighed.withColumn("nth", F.lit(0).cast("long"))
    else:
        told = with_groups(weighed, same.withColumn("again", F.lit(True)), ["alike"], "rows", weighed.count())
        twice = numbered(told.filter("again").drop("again"), ["alike"], ["at"], "mix-again")
        drawn = told.filter("again is null").drop("again").withColumn("nth", F.lit(0).cast("long")).unionByName(twice.withColumnRenamed("pos", "nth").drop("n"))
    draw = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"), F.col("nth").cast("string"), seed=seed)
    sized = drawn.select(*own, "doc_id", "source", "size", "nth", (-F.log(draw) / F.col("quality")).alias("key"))
    if not told_apart:
        sized = stage(sized, "mix-sizes")
    targets = source_targets(sized, weights, cap)
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # Steps of the key's logarithm: whatever the weights, a unit of it holds at most 1/e of the rows in expectation. With as
    # many steps a unit as the root of the source's rows, neither the windows nor the offsets grow with the source alone.
    share = F.ceil(F.sqrt(F.col("n_rows").cast("double")))
    bucket = F.floor(share * F.log(F.col("key"))).cast("long")
    placed = running_total(known.withColumn("_b", bucket), ["source_no"], "_b", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("nth"), *[F.col(c) for c in own]], "size", "_before")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("_before")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return placed.select(*own, F.col("doc_id").alias(columns[0]), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth, len(regexp_extract_all(text, '[^ \\t-\\r]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(text) || '|' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) || '|mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
         length(text)::DOUBLE AS n, length(regexp_replace(text, '[|#*%&$!]', '', 'g'))::DOUBLE AS kept
  FROM t
), keyed AS (
  SELECT doc_id, source, size, nth,
         -ln(u) / CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * ((n - kept) / n)) ELSE 1.0::DOUBLE END AS key
  FROM sized
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM keyed GROUP BY source
), weighted AS (
  SELECT *, 1 + (source_no - 1) % 3 AS weight FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighted
  WINDOW b AS (ORDER BY 3 * source_size::DOUBLE / weight::DOUBLE, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM placed
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM epochs
"""
