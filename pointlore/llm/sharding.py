"""Sharding by balanced label propagation.

Documents with equal texts are linked through their text, never pair by pair. Copies of one text are
interchangeable, so the propagation state is (text, shard, number of copies): a row for every text and
shard at most, however large a group is. A round is a window over each text's few rows
and a join with the sums of buckets of movers: the copies of a text want to move to the shard that
holds most of them, and a move is accepted while the running sum of the movers stays within what the
shard's quota leaves. Texts with one copy are linked
to nothing; they fill the shards at the end, so counts differ by one at most. A group that is larger
than a quota is cut, as is one whose shard is full. Only DataFrame functions are used.

Null texts equal one another and have size 1; null and repeated ids are rows like any other; an empty
table gives an empty result; extra columns are ignored.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import running_total, stage, table


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Copies per shard: one number for each shard comes to the driver."""
    got = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [int(got.get(s) or 0) for s in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])[index]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")


def _fill(pool: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """Deal (key, n) rows out to shards with ``room``: each row lies at an interval of the running sum."""
    bounds = [sum(room[:s]) for s in range(len(room) + 1)]
    laid = _laid(pool, buckets)
    parts = F.array(*[
        F.struct(F.lit(s).alias("shard"), (F.least(F.col("_a") + F.col("n"), F.lit(bounds[s + 1])) - F.greatest(F.col("_a"), F.lit(bounds[s]))).cast("long").alias("n"))
        for s in range(len(room))
    ])
    return laid.select("key", F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p")).select("key", "p.shard", "p.n")


def _laid(pool: DataFrame, buckets: int) -> DataFrame:
    """Running sum ``_a`` of n over all rows, without one task that sees them all."""
    return running_total(pool.withColumn("_one", F.lit(0)).withColumn("_b", _bucket(F.col("key"), buckets)), ["_one"], "_b", [F.col("key")], "n", "_a").drop("_one", "_b")


def propagate(state: DataFrame, quota: list[int], rounds: int, buckets: int, slack: float = 0.1) -> DataFrame:
    """Move linked copies towards the shard that holds most of their text. state: key, shard, n.

    While rounds run, a shard may exceed its quota by ``slack``; settle() takes that back.
    """
    shards = len(quota)
    cap = [int(q * (1 + slack)) + 1 for q in quota]
    for no in range(rounds):
        loads = _loads(state, shards)
        free = [max(0, c - n) for c, n in zip(cap, loads)]
        if not any(free):
            break
        by_key = W.partitionBy("key")
        has_room = _pick([int(f > 0) for f in free], F.col("shard")) == 1
        best = F.max(F.when(has_room, F.struct(F.col("n").alias("n"), (-F.col("shard")).alias("minus")))).over(by_key)
        wish = state.withColumn("_best", best).withColumn("_total", F.sum("n").over(by_key)).withColumn("_to", (-F.col("_best")["minus"]).cast("int"))
        # A copy moves only to where at least as many of its kind are; ties go to the lower shard.
        gain = (F.col("_best")["n"] > F.col("n")) | ((F.col("_best")["n"] == F.col("n")) & (F.col("_to") < F.col("shard")))
        wish = stage(wish.select("key", "shard", "n", F.when(F.col("_to").isNotNull() & gain & (F.col("_to") != F.col("shard")), F.col("_to")).alias("to"), F.when(F.col("_total") > 0, F.col("_best")["n"] / F.col("_total")).alias("pull")), f"shard-wish-{no}")
        movers = wish.filter("to is not null")
        if movers.isEmpty():
            break
        # Strongest pull first: ten classes of pull, then hashed buckets, then the key.
        klass = (F.lit(9) - F.least(F.lit(9), F.floor(F.col("pull") * 10))) * buckets + _bucket(F.col("key"), buckets)
        queued = running_total(movers.withColumn("_b", klass.cast("long")), ["to"], "_b", [F.col("key"), F.col("shard")], "n", "_a")
        went = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), _pick(free, F.col("to")) - F.col("_a")))
        queued = queued.withColumn("_went", went)
        moved = queued.select("key", F.explode(F.array(F.struct(F.col("to").alias("shard"), F.col("_went").alias("n")), F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("_went")).alias("n")))).alias("p")).select("key", "p.shard", "p.n")
        state = stage(wish.filter("to is null").select("key", "shard", "n").unionByName(moved).filter("n > 0").groupBy("key", "shard").agg(F.sum("n").alias("n")), f"shard-state-{no}")
    return state


def settle(state: DataFrame, single: DataFrame, quota: list[int], buckets: int) -> DataFrame:
    """Shards over their quota give up what is beyond it, smallest groups first; that and the single texts fill the rest."""
    shards = len(quota)
    # Large groups keep their place: classes of falling size, then hashed buckets.
    klass = (F.lit(63) - F.floor(F.log2(F.col("n").cast("double")))) * buckets + _bucket(F.col("key"), buckets)
    stood = running_total(state.withColumn("_b", klass.cast("long")), ["shard"], "_b", [F.col("key")], "n", "_a")
    stay = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), _pick(quota, F.col("shard")) - F.col("_a")))
    stood = stage(stood.select("key", "shard", "n", stay.alias("stay")), "shard-stay")
    kept = stood.filter("stay > 0").select("key", "shard", F.col("stay").alias("n"))
    loads = _loads(kept, shards)
    pool = stood.filter("n > stay").groupBy("key").agg(F.sum(F.col("n") - F.col("stay")).alias("n")).unionByName(single)
    filled = _fill(pool, [q - n for q, n in zip(quota, loads)], buckets)
    return stage(kept.unionByName(filled).groupBy("key", "shard").agg(F.sum("n").alias("n")), "shard-places")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 10, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    ``buckets`` cut running sums into windows: by default about the root of the number of rows, so that
    neither a window nor the list of bucket sums grows with the input alone.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256)).alias("key"),
        F.pmod(F.hash(F.col(id_col)), F.lit(shards)).alias("shard"),
    )
    base = stage(base, "shard-base")
    if buckets is None:
        buckets = max(16, math.isqrt(base.count()))
    # Copies of one text are told apart by salt and order, not by one long window.
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    parts = stage(base.groupBy("key", "shard", "salt").agg(F.count(F.lit(1)).alias("n")), "shard-parts")
    state = parts.groupBy("key", "shard").agg(F.sum("n").alias("n"))
    linked = F.sum("n").over(W.partitionBy("key")) > 1
    state = stage(state.withColumn("linked", linked), "shard-first")
    rows = sum(_loads(state, shards))
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    moved = propagate(state.filter("linked").select("key", "shard", "n"), quota, rounds, buckets)
    single = state.filter("not linked").select("key", "n")
    places = settle(moved, single, quota, buckets)

    # Rank of a copy among its text's copies: offset of its salt, then the order inside the salt.
    salted = parts.groupBy("key", "salt").agg(F.sum("n").alias("n"))
    by_salt = W.partitionBy("key").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.select("key", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("first"))
    by_shard = W.partitionBy("key").orderBy("shard")
    ends = places.withColumn("end", F.sum("n").over(by_shard)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # one entry a shard at most
    told = starts.join(ends, "key")
    inside = W.partitionBy("key", "salt").orderBy("doc_id", "size")
    ranked = base.drop("shard").join(told, ["key", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)
    placed = ranked.select("doc_id", "size", "text_crc32", F.filter("ends", lambda e: e["end"] > F.col("rank"))[0]["shard"].alias("shard"))
    placed = stage(placed.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("long")).withColumn("_one", F.lit(1).cast("long")), "shard-placed")
    slots = running_total(placed, ["shard"], "_b", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "_one", "slot")
    return slots.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
