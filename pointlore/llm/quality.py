"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over every byte of a document. Their responses are max-pooled over overlapping
chunks (two neighbouring blocks each), and the chunk vectors are pooled over the whole document by
maximum, mean and minimum; a small layer makes one probability of that. Whole texts are scored, of
any length, in blocks.

The model is fitted on the driver on a bounded sample of labelled rows (``max_train`` documents of at
most ``max_train_bytes`` bytes each, by hash order); scoring is an Arrow UDF in the tasks. Labels,
language, source and ids are not inputs of a score. Null and empty texts score as the empty byte
string; without usable labels every score is 1. Of a labelled id with several texts the least one is
learned from; repeated rows score alike; extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WIDTH, BLOCK, SEGMENT = 6, 256, 1 << 14


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text padded to whole blocks and so far that no filter reaches the next text; blocks and bytes of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-(sizes + WIDTH - 1) // BLOCK)
    x = np.frombuffer(b"".join(t.ljust(int(b) * BLOCK, b"\0") for t, b in zip(texts, blocks)) + bytes(WIDTH), np.uint8)
    return x, blocks, sizes


def outside(blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions that are padding; the first of an empty text counts as a byte."""
    starts = (np.cumsum(blocks) - blocks) * BLOCK
    return np.concatenate([np.arange(s + max(1, n), s + b * BLOCK) for s, b, n in zip(starts, blocks, sizes)] or [np.empty(0, np.int64)])


@dataclass
class ByteNet:
    taps: np.ndarray  # WIDTH x 256 x filters
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, filters: int, units: int, seed: int) -> "ByteNet":
        g = np.random.default_rng(seed)
        n = 3 * filters + 1
        taps = g.normal(0, 0.4, (WIDTH, 256, filters)).astype(np.float32)
        taps[:, 0] = 0
        return cls(taps, np.zeros(filters, np.float32), g.normal(0, (2 / n) ** 0.5, (n, units)).astype(np.float32), np.zeros(units, np.float32), g.normal(0, (1 / units) ** 0.5, units).astype(np.float32), np.array([1.0], np.float32))

    def pair_tables(self) -> list[np.ndarray]:
        """Responses of two neighbouring taps by both bytes: half as many look-ups."""
        return [(self.taps[k][:, None] + self.taps[k + 1][None]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def block_max(self, x: np.ndarray, pad: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter in each block."""
        n, f = len(x) - WIDTH, self.bias.size
        two = (x[:-1].astype(np.uint16) << 8) | x[1:]
        top = np.empty((n // BLOCK, f), np.float32)
        for a in range(0, n, SEGMENT):
            b = min(n, a + SEGMENT)
            r = pairs[0].take(two[a:b], 0)
            for k in range(1, WIDTH // 2):
                r += pairs[k].take(two[a + 2 * k : b + 2 * k], 0)
            p = pad[np.searchsorted(pad, a) : np.searchsorted(pad, b)]
            r[p - a] = -1e9
            top[a // BLOCK : b // BLOCK] = r.reshape(-1, BLOCK, f).max(1)
        return top

    def pool(self, top: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> tuple:
        """Chunk vectors and document vectors. A chunk is a block and the next one of its document."""
        first = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(blocks)), blocks)
        last = np.zeros(len(top), bool)
        last[first + blocks - 1] = True
        at = np.flatnonzero(~last | (blocks[doc] == 1))
        after = np.where(last[at], at, at + 1)
        chunk = np.maximum(0, np.maximum(top[at], top[after]) + self.bias)
        n = np.maximum(1, blocks - 1)
        start = np.cumsum(n) - n
        high, low = np.maximum.reduceat(chunk, start), np.minimum.reduceat(chunk, start)
        mean = np.add.reduceat(chunk, start) / n[:, None].astype(np.float32)
        vec = np.concatenate([high, mean, low, (np.log1p(sizes) / 10).astype(np.float32)[:, None]], 1)
        return at, after, chunk, start, n, vec

    def head(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, vec @ self.hidden + self.hidden_bias)
        return h, 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))

    def score(self, texts: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
        x, blocks, sizes = lay_out(texts)
        top = self.block_max(x, outside(blocks, sizes), pairs)
        return self.head(self.pool(top, blocks, sizes)[-1])[1].astype(float)


def crop(text: bytes, label: int, g: np.random.Generator) -> bytes:
    """Now and then a short piece instead of the whole text, so that short documents are judged well too."""
    n = int(g.integers(16, 400))
    if len(text) <= n or g.random() > (0.3 if label else 0.1):
        return text
    at = int(g.integers(0, len(text) - n))
    return text[at : at + n]


def gradients(net: ByteNet, texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the mean log loss, for the parts of ``net`` in their order."""
    filters = net.bias.size
    x, blocks, sizes = lay_out(texts)
    n = len(x) - WIDTH
    r = net.taps[0].take(x[:n], 0)
    for k in range(1, WIDTH):
        r += net.taps[k].take(x[k : n + k], 0)
    r[outside(blocks, sizes)] = -1e9
    r = r.reshape(-1, BLOCK, filters)
    arg = r.argmax(1)
    top = np.take_along_axis(r, arg[:, None], 1)[:, 0]
    at, after, chunk, start, count, vec = net.pool(top, blocks, sizes)
    h, p = net.head(vec)
    d = (p - y) / len(texts)
    g_out, g_ob = h.T @ d, np.array([d.sum()], np.float32)
    dh = np.outer(d, net.out) * (h > 0)
    g_hid, g_hb = vec.T @ dh, dh.sum(0)
    dv = dh @ net.hidden.T
    owner = np.repeat(np.arange(len(texts)), count)
    dc = dv[owner, filters : 2 * filters] / count[owner][:, None]
    for lo, ext in ((0, np.maximum.reduceat(chunk, start)), (2 * filters, np.minimum.reduceat(chunk, start))):
        same = chunk == ext[owner]
        dc += dv[owner, lo : lo + filters] * same / np.add.reduceat(same, start, dtype=np.float32)[owner]
    dc *= chunk > 0
    src = np.where(top[at] >= top[after], at[:, None], after[:, None])
    pos = src * BLOCK + np.take_along_axis(arg, src, 0)
    g_taps, cols = np.zeros_like(net.taps), np.broadcast_to(np.arange(filters), pos.shape)
    for k in range(WIDTH):
        np.add.at(g_taps[k], (x[pos + k], cols), dc)
    g_taps[:, 0] = 0
    return g_taps, dc.sum(0), g_hid, g_hb, g_out, g_ob


def fit(texts: list[bytes], labels: np.ndarray, filters: int = 16, units: int = 16, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteNet | None:
    """Adam on the log loss; None without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    net, g = ByteNet.fresh(filters, units, seed), np.random.default_rng(seed)
    parts = [net.taps, net.bias, net.hidden, net.hidden_bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    epochs = max(epochs, -(-1500 * batch // (len(texts) * 2)) if len(texts) < 1500 else epochs)
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = g.permutation(len(texts))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            grads = gradients(net, [crop(texts[i], labels[i], g) for i in pick], labels[pick].astype(np.float32))
            t += 1
            step = rate * min(1.0, 2.0 * (1 - (t - 1) / steps))
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                parts[i] -= (step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 3000, max_train_bytes: int = 32 << 10) -> ByteNet | None:
    """Fit on at most ``max_train`` labelled rows, none of them held out."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("_id"))
    chosen = usable.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(max_train)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").cast("binary").alias("body")).filter(F.octet_length("body") <= max_train_bytes)
    # Of an id with several texts one is learned from, so what comes here is bounded by max_train texts of max_train_bytes.
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("body").alias("body")).collect()
    rows.sort(key=lambda r: r["_id"])
    return fit([bytes(r["body"]) for r in rows], np.array([r["y"] for r in rows]))


def score_column(net: ByteNet | None, spark):
    """A function from a text column to its score."""
    shared, tables = spark.sparkContext.broadcast(net), []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        net = shared.value
        if net is None:
            return pd.Series(np.ones(len(texts)))
        if not tables:
            tables.append(net.pair_tables())
        out, group, size = [], [], 0
        for t in texts:
            group.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(group[-1]) + BLOCK
            if size > 1 << 20:
                out.append(net.score(group, tables[0]))
                group, size = [], 0
        if group:
            out.append(net.score(group, tables[0]))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return score


def score_quality(docs: DataFrame, net: ByteNet | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted."""
    scored = docs.select(F.col(id_col).alias(id_col), score_column(net, docs.sparkSession)(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_on(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
