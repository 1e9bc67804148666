"""Corpus pipeline: quality classifier, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before
kept. All but the last return the columns of ``docs``, so further columns travel along. Stages 2 and 4
decide row by row, by a key of their own: rows that share an id, or have none, are documents of their own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlore.llm.common import Scratch, drop, stage, table
from pointlore.llm.decontaminate import drop_contaminated
from pointlore.llm.jaccard_join import jaccard_join
from pointlore.llm.mixing import mix_sources
from pointlore.llm.quality import fit_on, score_column
from pointlore.llm.sharding import shard_documents

KEY = "__pipeline_key"


def quality(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Keep documents that the classifier accepts."""
    score = score_column(fit_on(docs, table(spark, sf_dir, "labels")), spark)
    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key each, written so that the key stays."""
    return stage(docs.withColumn(KEY, F.monotonically_increasing_id()), "pipeline-keyed")


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the one with the least id; a null id comes last."""
    rows = keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), KEY)
    with Scratch() as join:
        classes = jaccard_join(rows, id_col=KEY).select(KEY, "class_id")
        heads = rows.select(KEY, order.alias("o")).join(classes, KEY).groupBy("class_id").agg(F.min("o").alias("o")).select(F.col(f"o.{KEY}").alias(KEY))
        heads = join.keep(stage(heads, "pipeline-heads"))
    # One key for each row that stays: no table to broadcast, at any size.
    return rows.join(heads.hint("shuffle_hash"), KEY, "left_semi").select(*docs.columns)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; a part of at least half a document counts as one."""
    rows = keyed(docs)
    taken = mix_sources(rows, row=KEY)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    times = taken.select(KEY, copies.alias("__pipeline_copies")).filter("__pipeline_copies > 0")
    return rows.join(times, KEY).withColumn("__pipeline_nth", F.explode(F.sequence(F.lit(1), "__pipeline_copies"))).select(*docs.columns)


def shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Stages 1, 2 and 5 (a trained network, components, an iteration) are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with Scratch() as inside:
            last, docs = docs, inside.keep(stage(step(spark, docs, sf_dir), f"pipeline-{name}"))
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
