"""Lines that several documents hold, dropped in all but one, through a sharded minimal perfect hash.

The key of a line is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code points
that documents with different ids hold stay in the documents of the least id (a null id comes after all others) and go elsewhere;
other lines stay. A key is known by two 64-bit hashes.

The repeated keys lie in shards. A shard is a minimal perfect hash, which gives each of its keys a place of its own among 0 .. keys - 1,
and arrays at those places: fingerprints, counts of lines and owners, the least ids. Documents send the distinct hashes of about
``sender_lines`` lines at a time to the shards, packed; a shard answers with the owners of those it knows. So a line that every
document has reaches its shard once per sender, and no text moves before its document is known to lose lines.

A null or empty text is one empty line. Rows that share an id are one document. Ids are integers; an empty table gives an empty
result; extra columns are ignored.
"""

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import stage, table
from .hashing import LOWER, mix

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = (1 << 63) - 1  # a null id comes last


# --- a minimal perfect hash ------------------------------------------------------------------------


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & ((1 << 64) - 1))
    return (mix(mix(a ^ salt) + b * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Places 0 .. n - 1 for n distinct pairs of 64-bit hashes, in about four bits a pair.

    At each level the pairs left fall into twice as many slots. Those alone in a slot are settled, their slot's bit is set; the others
    go on to the next level. The place of a pair is the number of bits set before its own.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool) if sizes else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        sizes, parts, left = [], [], np.arange(len(a))
        while len(left):
            size = max(64, 2 * len(left))
            slot = _slots(a[left], b[left], len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[slot]]
        return cls(sizes, np.packbits(np.concatenate(parts)).tobytes() if parts else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair that was there when it was built has its own place; any other has some place or -1."""
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = start + _slots(a[left], b[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left, start = left[~hit], start + size
        return out


# --- lines and their index -----------------------------------------------------------------------------


def _whole(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def hash_lines(text: bytes, min_chars: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two hashes of the key of each line that has at least ``min_chars`` code points, the numbers of these lines, and how many lines there are."""
    lines = text.translate(LOWER).split(b"\n")
    digests, at = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANK)
            # A code point has at most four bytes.
            if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                digests.append(xxh3_128_digest(key))
                at.append(i)
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), np.array(at, np.uint32), len(lines)


def _gathered(batches, columns: tuple[str, ...], min_chars: int, sender_lines: int):
    """Documents of about ``sender_lines`` lines at a time: the named columns, hashes by line, document and number of each line."""
    held, lines = [], 0

    def together():
        cols = {c: np.concatenate([h[0][c] for h in held]) for c in columns}
        docs = [d for h in held for d in h[1]]
        return cols, np.concatenate([d[0] for d in docs]), np.repeat(np.arange(len(docs), dtype=np.uint32), [len(d[1]) for d in docs]), np.concatenate([d[1] for d in docs])

    for batch in batches:
        if not batch.num_rows:
            continue
        docs = [hash_lines(t.as_py(), min_chars) for t in batch.column("text")]
        held.append(({c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns}, docs))
        lines += sum(d[2] for d in docs)
        if lines >= sender_lines:
            yield together()
            held, lines = [], 0
    if held:
        yield together()


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, shard_keys: int = 1 << 18, shard_lines: int = 1 << 20, sender_lines: int = 1 << 20) -> tuple[DataFrame, int]:
    """The index and its number of shards. Index: shard, sizes, bits (the perfect hash), prints, counts, owners (arrays by place).

    A shard has about ``shard_keys`` repeated keys and answers for about ``shard_lines`` of the lines of ``docs``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("owner", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])

    def keys(batches):
        for cols, hashes, doc_at, _ in _gathered(batches, ("id",), min_chars, sender_lines):
            if len(hashes):
                order = np.lexsort((hashes[:, 1], hashes[:, 0]))
                a, b, ids = hashes[order, 0], hashes[order, 1], cols["id"][doc_at[order]]
                start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                n = np.diff(np.append(start, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[start].view(np.int64), b[start].view(np.int64), np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start), n)], schema=schema)

    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), _whole(text_col).cast("binary").alias("text"))
    seen = Observation()
    found = plain.mapInArrow(keys, "a long, b long, owner long, last long, n long").groupBy("a", "b").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.sum("n").alias("n"))
    repeated = stage(found.observe(seen, F.sum("n").alias("lines")).filter("owner < last").drop("last"), "line-keys")
    shards = max(1, -(-repeated.count() // shard_keys), -(-(seen.get["lines"] or 0) // shard_lines))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in "ab")
        perfect = PerfectHash.build(a, b)
        at, n = perfect.places(a, b), pdf["n"].to_numpy(np.int64)
        prints, owners, counts = np.empty(len(a), np.uint64), np.empty(len(a), np.int64), np.empty(len(a), np.min_scalar_type(int(n.max())))
        prints[at], owners[at], counts[at] = b, pdf["owner"].to_numpy(np.int64), n
        return pd.DataFrame([(int(key[0]), perfect.sizes, perfect.packed(), prints.tobytes(), counts.dtype.str, counts.tobytes(), owners.tobytes())], columns=["shard", "sizes", "bits", "prints", "width", "counts", "owners"])

    index = repeated.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, sizes array<long>, bits binary, prints binary, width string, counts binary, owners binary")
    return stage(index, "line-index"), shards


def _packer(shards: int, min_chars: int, sender_lines: int):
    """Arrow batches of documents (id, print, length, text) to rows for the shards and one row for the sender itself."""
    schema = pa.schema([("sender", pa.string()), ("shard", pa.int64()), ("start", pa.int64()), *[(c, pa.binary()) for c in ("a", "b", "ids", "prints", "lengths", "doc_at", "line_at", "key_at")]])

    def send(batches):
        for cols, hashes, doc_at, line_at in _gathered(batches, ("id", "print", "length"), min_chars, sender_lines):
            shard = np.mod(hashes[:, 0].view(np.int64), shards)
            order = np.lexsort((hashes[:, 1], hashes[:, 0], shard))
            a, b, shard = hashes[order, 0], hashes[order, 1], shard[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            key_at = np.empty(len(a), np.uint32)
            key_at[order] = np.cumsum(new) - 1
            a, b, shard = a[new], b[new], shard[new]
            sender, rows = uuid.uuid4().hex, []
            for s, start, count in zip(*np.unique(shard, return_index=True, return_counts=True)):
                rows.append((sender, int(s), int(start), a[start : start + count].tobytes(), b[start : start + count].tobytes(), *[None] * 6))
            own = (cols["id"], cols["print"], cols["length"], doc_at, line_at, key_at)
            rows.append((sender, -1, len(a), None, None, *[x.tobytes() for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return send, "sender string, shard long, start long, a binary, b binary, ids binary, prints binary, lengths binary, doc_at binary, line_at binary, key_at binary"


def _answer(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(shard) and len(asked):
        x = shard.iloc[0]
        perfect, prints, owners = PerfectHash(list(x["sizes"]), x["bits"]), _u64(x["prints"]), np.frombuffer(x["owners"], np.int64)
        for sender, start, a, b in zip(asked["sender"], asked["start"], asked["a"], asked["b"]):
            at, b = perfect.places(_u64(a), _u64(b)), _u64(b)
            known = at >= 0
            known[known] = prints[at[known]] == b[known]
            if known.any():
                rows.append((sender, (np.flatnonzero(known) + start).astype(np.int64).tobytes(), owners[at[known]].tobytes()))
    return pd.DataFrame(rows, columns=["sender", "known", "owners"])


def _decide(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """Which lines each of a sender's documents loses: true at their numbers."""
    rows = []
    if len(own) and len(replies):
        x = own.iloc[0]
        ids, prints, lengths = (np.frombuffer(x[c], np.int64) for c in ("ids", "prints", "lengths"))
        doc_at, line_at, key_at = (np.frombuffer(x[c], np.uint32) for c in ("doc_at", "line_at", "key_at"))
        known, owner = np.zeros(int(x["start"]), bool), np.zeros(int(x["start"]), np.int64)
        for at, o in zip(replies["known"], replies["owners"]):
            at = np.frombuffer(at, np.int64)
            known[at], owner[at] = True, np.frombuffer(o, np.int64)
        lost = np.flatnonzero(known[key_at] & (owner[key_at] != ids[doc_at]))
        docs, starts = np.unique(doc_at[lost], return_index=True)
        for d, at in zip(docs, np.split(line_at[lost], starts[1:])):
            drop = np.zeros(int(at[-1]) + 1, bool)
            drop[at] = True
            rows.append((ids[d], prints[d], lengths[d], drop))
    return pd.DataFrame(rows, columns=["id", "print", "length", "drop"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, shard_keys: int = 1 << 18, shard_lines: int = 1 << 20, sender_lines: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: the id, ``text`` without the lines that another document keeps, n_lines (before) and n_dropped."""
    index, shards = line_index(docs, id_col, text_col, min_chars, shard_keys, shard_lines, sender_lines)
    # Rows of one id and text lose the same lines, so these three tell which decision is theirs.
    marked = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), _whole(text_col).alias("text"))
    marked = marked.select("*", F.xxhash64("text").alias("print"), F.octet_length("text").cast("long").alias("length"))
    send, shape = _packer(shards, min_chars, sender_lines)
    sent = stage(marked.select("id", "print", "length", F.col("text").cast("binary").alias("text")).mapInArrow(send, shape), "line-senders")
    replies = sent.filter("shard >= 0").select("shard", "sender", "start", "a", "b").groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_answer, "sender string, known binary, owners binary")
    own = sent.filter("shard < 0").select("sender", "start", "ids", "prints", "lengths", "doc_at", "line_at", "key_at")
    lost = own.groupBy("sender").cogroup(replies.groupBy("sender")).applyInPandas(_decide, "id long, print long, length long, drop array<boolean>")
    lost = stage(lost.dropDuplicates(["id", "print", "length"]), "line-drops").hint("shuffle_hash")
    told = marked.join(lost, ["id", "print", "length"], "left").withColumn("lines", _lines(F.col("text")))
    left = F.array_join(F.filter("lines", lambda x, i: ~F.coalesce(F.get("drop", i), F.lit(False))), "\n")
    dropped = F.size(F.filter(F.coalesce("drop", F.array().cast("array<boolean>")), lambda x: x))
    return told.select(F.col("given").alias(id_col), F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(l) + 1)) t(i)),
o AS (SELECT key, min(doc_id) AS owner FROM x WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT x.*, coalesce(length(x.key) >= 10 AND x.doc_id IS DISTINCT FROM o.owner, false) AS gone FROM x LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY r
"""
