"""Exact duplicates by an exchange of compressed fingerprints.

A sender is a set of stretches of the input's partitions. It sorts its distinct 64-bit fingerprints,
cuts them by owner and sends every owner one Golomb-Rice coded list. An owner answers each list with a
bitmap of the fingerprints that other lists hold too, or that repeat at the sender. Rows with a marked
fingerprint are suspects; only their texts are shuffled, and equality is decided on the bytes themselves.

A null text counts as empty. Ids may repeat or be null: the row with the largest id stays (a null id
is below all others; of rows that share the largest id, one), every row is returned once. An empty
table gives an empty result; extra columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, probably_in, stage, table, with_groups


def rice_encode(values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of sorted distinct uint64: unary quotient and ``bits`` low bits of each gap."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1])
    gaps[0] = 0
    high, low = (gaps >> np.uint64(bits)).astype(np.int64), gaps & np.uint64((1 << bits) - 1)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    lows = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([len(values), len(unary)], np.uint64).tobytes() + values[:1].tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(lows).tobytes()


def rice_decode(blob: bytes, bits: int) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, n_unary = (int(x) for x in np.frombuffer(blob, np.uint64, 2))
    first, at = np.frombuffer(blob, np.uint64, 1, 16), 24
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, (n_unary + 7) // 8, at), count=n_unary)
    at += (n_unary + 7) // 8
    high = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n * bits).reshape(n, bits)
    low = (low.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(bits)) + low
    return first + np.cumsum(gaps, dtype=np.uint64)


def rice_bits(n: int, space_bits: int) -> int:
    """Low bits that suit ``n`` values spread over a space of 2**space_bits."""
    return max(1, min(60, space_bits - max(1, n).bit_length()))


def sender(total: int, sender_rows: int) -> Column:
    """Sender of a row from its ``row``: stretches of input partitions, dealt to as many senders as ``total`` rows fill.

    monotonically_increasing_id counts inside a partition in its low 33 bits, so a large partition is
    many stretches and many small ones share a sender.
    """
    senders = max(1, -(-total // sender_rows))
    stretch = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return F.pmod(F.xxhash64(F.shiftright("row", 33), F.floor(stretch / F.lit(max(1, sender_rows // 16)))), F.lit(senders)).cast("int")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = 500_000, sender_rows: int = 2_000_000, fp_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``sender_rows`` and ``owner_rows`` are about how many fingerprints a sender holds and an owner
    compares: both are groups of bounded memory at any size of the input. ``fp_bits`` below 64 makes
    fingerprints collide (for tests); results do not depend on it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shift = 64 - fp_bits
    fp = F.shiftright(F.xxhash64(text), shift) if shift else F.xxhash64(text)
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), fp.alias("fp"))
    base = stage(plain.select("doc_id", "fp", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("len"), F.monotonically_increasing_id().alias("row")), "dedup-base")

    total = base.count()
    owner_bits = max(0, (-(-total // owner_rows) - 1).bit_length())
    space = 64 - owner_bits

    def send(key, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, counts = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        owner = (codes >> np.uint64(space)).astype(np.int64) if owner_bits else np.zeros(len(codes), np.int64)
        rows = []
        for o, a in zip(*np.unique(owner, return_index=True)):
            mine = codes[a : np.searchsorted(owner, o, "right")]
            bits = rice_bits(len(mine), space)
            rows.append((int(o), int(key[0]), bits, rice_encode(mine, bits), np.packbits(counts[a : a + len(mine)] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["owner", "sender", "bits", "codes", "own"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [rice_decode(c, b) for c, b in zip(pdf["codes"], pdf["bits"])]
        seen, n = np.unique(np.concatenate(lists), return_counts=True)
        rows = []
        for x, own in zip(lists, pdf["own"]):
            dup = n[np.searchsorted(seen, x)] > 1
            dup |= np.unpackbits(np.frombuffer(own, np.uint8), count=len(x)).astype(bool)
            rows.append(np.packbits(dup).tobytes())
        return pdf[["sender", "bits", "codes"]].assign(marks=rows)

    held = base.select(sender(total, sender_rows).alias("sender"), "fp")
    sent = held.groupBy("sender").applyInPandas(send, "owner long, sender int, bits int, codes binary, own binary")
    replies = sent.groupBy("owner").applyInPandas(answer, "sender int, bits int, codes binary, marks binary")

    def suspects(batches):
        for pdf in batches:
            for c, b, m in zip(pdf["codes"], pdf["bits"], pdf["marks"]):
                x = rice_decode(c, b)
                yield pd.DataFrame({"fp": x[np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool)].view(np.int64)})

    # What a sender learns of its rows is the set of marked fingerprints; the senders' rows meet it in a bitmap of fixed size.
    marked = stage(replies.mapInPandas(suspects, "fp long").distinct(), "dedup-marked")
    told = probably_in(base, F.col("fp"), marked, "suspect")
    asked = maybe_in(plain, F.col("fp"), marked)

    # Partial aggregation folds hot copies before the shuffle; grouping by the text compares its bytes.
    groups = (
        asked.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("len"), "n")
    )
    # Two texts with one SHA-256 and one length would need the text below as well; that fails the job instead of guessing.
    one = groups.groupBy("key", "sha", "len").agg(F.max("n").alias("n"), F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share a SHA-256"))).alias("bad"))
    # Of rows that share the largest id the last one stays.
    head = told.filter("suspect").groupBy("sha", "len").agg(F.max(F.struct("doc_id", "row")).alias("head"))
    known = one.filter("bad is null").join(head, ["sha", "len"]).select("sha", "len", "n", F.col("n").alias("rows"), F.col("head.doc_id").alias("keep_id"), F.col("head.row").alias("keep_row"))
    out = ["doc_id", "keep_id", "n", "kept", "sha"]
    # Rows that are no suspects never move.
    alone = told.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")
    joined = with_groups(told.filter("suspect"), stage(known, "dedup-groups"), ["sha", "len"], "rows", total)
    single = F.col("n").isNull()
    copies = joined.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), (single | (F.col("row") == F.col("keep_row"))).alias("kept"), "sha")
    every = alone.select(*out).unionByName(copies.select(*out))
    return every.select(F.col("doc_id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
