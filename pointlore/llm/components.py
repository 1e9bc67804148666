"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join; every round is written to the shared folder.
The edges of a node of any degree stay spread over tasks, and no step makes more edges than it read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage, telling, weights, with_groups


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Gives (node, root) for every node of an edge; root is the least node of its component."""
    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while True:
        both = e.withColumn("leaf", F.lit(1)).unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("leaf")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"), F.sum("leaf").alias("up"))
        # Done when the edges are stars: each leaf has one root, and no root is a leaf. Then m is the root.
        least = stage(telling(least, open=F.count(F.when((F.col("up") > 0) & (F.col("n") > 1), 1)), **weights("n")), "cc-least")
        if not least.told["open"]:
            drop(e)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = with_groups(both.drop("leaf"), least, ["a"], "n", 2 * e.n_rows).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, "cc-large")
        low = stage(telling(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), **weights("n")), "cc-low")
        small = with_groups(large, low, ["a"], "n", large.n_rows).select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        ends = F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("y").alias("a"), F.col("m").alias("b")))
        last, e = e, stage(small.select(F.explode(ends).alias("p")).select("p.a", "p.b").filter("a <> b").distinct(), "cc-small")
        drop(last, least, large, low)
