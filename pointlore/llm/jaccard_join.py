"""Jaccard similarity self-join on word shingles by chosen paths.

A document is the set of its five-word shingles; documents with equal sets are one class from the
start. Each set is embedded in 128 tokens (the least shingle under each of 128 hashes). A run splits
all sets on sampled tokens: sets that share the token at a coordinate go to the same child, and every
node samples 1/similarity coordinates in expectation, so that a pair above the threshold survives in
expectation at every depth. From the third split on buckets are looked at: a small one is compared by
brute force; in a large one every set is compared with one pivot, and the bucket splits on unless all its
sets are close to it. At full depth the sets that are not close to the pivot meet the bucket in blocks.
Runs repeat until a pair at the threshold is missed with chance ``miss`` at most. Found pairs only connect
sets to cells. Inside a cell the exact sets decide, each by its difference from the cell's pivot, so
every link is exact, is counted at both ends, and no list of pairs is ever made.

Documents with fewer than five words are one shingle of all their words; empty and null texts have
none and are linked to nothing. The class is the least doc_id of the connected documents; a null id is
never a class id unless no other is there. Repeated rows are documents of their own. An empty table
gives an empty result; extra columns are ignored.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Scratch, drop, maybe_in, stage, table, telling, weights, with_groups
from .components import components
from .hashing import mix, windows, word_hashes

COORDS = 128
_SALT = [np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)]
_rng = np.random.default_rng(20240301)
#: One hash per coordinate, a permutation of 32 bits: the shingles are hashed already.
_FLIP = _rng.integers(0, 1 << 32, (COORDS, 1), dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, (COORDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, start = word_hashes(b"\n".join(data))
    last = np.searchsorted(start, np.cumsum([len(d) + 1 for d in data]))
    every = windows(words, size) if len(words) >= size else words[:0]
    out = []
    for a, b in zip(np.concatenate(([0], last[:-1])), last):
        out.append(np.unique(every[a : b - size + 1] if b - a >= size else windows(words[a:b], size)))
    return out


def fingerprint(x: np.ndarray) -> bytes:
    """128 bits of a set."""
    return b"".join(int(mix(x ^ s).sum(dtype=np.uint64)).to_bytes(8, "big") for s in _SALT)


def embed(x: np.ndarray) -> bytes:
    """16 bits of the least shingle under each of 128 hashes, so that coordinates are independent for sets of any size."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(least, ((x[None, a : a + 512] ^ _FLIP) * _TIMES).min(1), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def children(path: np.ndarray, sketch: np.ndarray, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths one level down: one coordinate, and a second one with chance 1/similarity - 1."""
    h = mix(path + np.uint64(depth + 1))
    first = (h % np.uint64(COORDS)).astype(np.int64)
    two = np.flatnonzero((h >> np.uint64(40)) % np.uint64(1 << 16) < int((1 / similarity - 1) * (1 << 16)))
    step = 1 + ((h >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)
    rows = np.concatenate((np.arange(len(path)), two))
    coord = np.concatenate((first, (first[two] + step[two]) % COORDS))
    value = sketch[rows, coord].astype(np.uint64)
    return rows, mix(h[rows] ^ (coord.astype(np.uint64) << np.uint64(20)) ^ (value + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def runs_for(similarity: float, depth: int, miss: float) -> int:
    """Runs after which a pair at the threshold is missed with chance ``miss``: each run is a branching process of mean 1 or more.

    All runs look at the same sketches, so the chance is taken over the number of coordinates at which a pair agrees.
    """
    second, agree = 1 / similarity - 1, np.arange(COORDS + 1) / COORDS
    chance = np.array([math.comb(COORDS, k) * similarity**k * (1 - similarity) ** (COORDS - k) for k in range(COORDS + 1)])
    lost = np.zeros(COORDS + 1)
    for _ in range(depth):
        one = 1 - agree * (1 - lost)
        lost = one * (1 - second) + one * one * second
    runs = 1
    while (chance * lost**runs).sum() > miss:
        runs += 1
    return runs


def forest(close: np.ndarray) -> np.ndarray:
    """Root of each row of a symmetric matrix of links: the least row of its component."""
    root = np.arange(len(close))
    while True:
        low = np.where(close, root[None, :], len(close)).min(1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def close(same: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a share ``same`` of equal coordinates and sizes n and m allow the threshold. Estimates of small sets get more room."""
    least, most = np.minimum(n, m), np.maximum(n, m)
    need = np.where(least >= 256, similarity - 0.16, np.where(least >= 64, similarity - 0.3, similarity - 0.6))
    return (same >= need) & (least >= similarity * most - 1e-9)


def sketch_links(sketch: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose embedded similarity allows the threshold."""
    m = len(sketch)
    same = np.empty((m, m), np.float32)
    for a in range(0, m, 32):
        same[a : a + 32] = (sketch[a : a + 32, None] == sketch[None]).mean(2, dtype=np.float32)
    return close(same, n[:, None], n[None], similarity)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every a with every b; only elements of both sides are laid out, in stretches."""
    out = np.zeros((len(a), len(b)), np.float64)
    left, right = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b))
    both = np.intersect1d(left, right)
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    if not len(both):
        return out
    at = [np.searchsorted(both, v) for v in (left, right)]
    for k, v in enumerate((left, right)):
        keep = both[np.minimum(at[k], len(both) - 1)] == v
        rows[k], at[k] = rows[k][keep], at[k][keep]
    for lo in range(0, len(both), 4096):
        block = []
        for k, m in enumerate((len(a), len(b))):
            inside = (at[k] >= lo) & (at[k] < lo + 4096)
            x = np.zeros((m, min(4096, len(both) - lo)), np.float32)
            x[rows[k][inside], at[k][inside] - lo] = 1
            block.append(x)
        out += block[0] @ block[1].T
    return out


def cells_of(pdf: pd.DataFrame):
    """The rows of each root."""
    return pdf.sort_values("root", kind="stable").groupby("root", sort=False)


def jaccard_join(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    leaf: int = 64,
    depth: int = 4,
    first_look: int = 3,
    miss: float = 1e-4,
    block: int = 512,
    block_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    trace: list | None = None,
) -> DataFrame:
    """One row per document: id, class_id, n_links (other documents at ``similarity`` or more), n_shingles.

    Buckets of at most ``leaf`` sets are compared by brute force, larger ones split on, down to ``depth``. A group of the exact
    comparison holds about ``block`` sets or ``block_bytes`` bytes. ``trace`` gathers (level, small, large, open) buckets.
    """
    kind = docs.schema[id_col].dataType
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def embedded(batches):
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a in range(0, len(texts), 500):
                sets = shingle_sets(texts[a : a + 500], shingle)
                yield pd.DataFrame({
                    "doc_id": ids[a : a + 500], "n": [len(s) for s in sets],
                    "node": [fingerprint(s) if len(s) else None for s in sets],  # a set; its first half, nid, stands for it in the search
                    "sketch": [embed(s) if len(s) else None for s in sets],
                })

    told = read.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(embedded, "doc_id string, n long, node binary, sketch binary")
    members = stage(told.withColumn("doc_id", F.col("doc_id").cast(kind)), "join-members")
    nodes = members.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies"), F.any_value("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("nid", F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")), "join-nodes")
    with Scratch() as search:
        edges = search.keep(stage(find_pairs(nodes.select("nid", "n", "sketch"), similarity, leaf, depth, first_look, miss, block, trace, nodes.n_rows), "join-edges"))
    with Scratch() as merge:
        cells = merge.keep(stage(components(edges).withColumnRenamed("node", "nid"), "join-cells"))

    # Exact sets of the sets in cells, each from the text of one document. A cell's pivot is the set with the most edges.
    degree = edges.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("degree"))
    wanted = stage(cells.join(nodes.select("nid", "n", "node", "head", "copies"), "nid").join(degree, "nid"), "join-wanted")
    drop(edges, cells)
    shape = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), F.max_by("nid", F.struct("degree", "nid")).alias("pivot"))
    parts = F.greatest(F.ceil(F.col("m") / F.lit(block)), F.ceil(F.col("items") * 8 / F.lit(block_bytes))).cast("int")
    placed = with_groups(wanted, shape.select("root", "pivot", parts.alias("parts"), "m"), ["root"], "m", wanted.n_rows).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    texts = maybe_in(read, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), wanted.select(F.xxhash64(F.coalesce(F.col("head").cast("string"), F.lit(""))).alias("h")), most=wanted.n_rows).select("text")

    def full_sets(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a in range(0, len(texts), 500):
                sets = [s for s in shingle_sets(texts[a : a + 500], shingle) if len(s)]
                yield pd.DataFrame({"node": [fingerprint(s) for s in sets], "items": [s.tobytes() for s in sets]})

    sets = texts.mapInPandas(full_sets, "node binary, items binary")
    full = stage(telling(sets.join(placed, "node").groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("items", "root", "copies", "parts", "own", "nid", "pivot")]), whole=F.sum(F.when(F.col("parts") == 1, F.octet_length("items")))), "join-sets")
    with Scratch() as exact:
        groups = exact.keep(stage(exact_classes(full, similarity, block, block_bytes), "join-classes"))
    drop(full, wanted)
    every = nodes.select("node", "head", "copies").join(groups, "node", "left").select("node", "head", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class"))
    every = stage(every, "join-groups")
    drop(nodes, groups)
    heads = stage(telling(every.groupBy("class").agg(F.min("head").alias("class_id"), F.count(F.lit(1)).alias("m")), **weights("m")), "join-heads")
    classes = with_groups(every, heads, ["class"], "m", every.n_rows)
    classes = stage(telling(classes.select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies"), **weights("copies")), "join-told")
    drop(every, heads)
    out = with_groups(members.select("doc_id", "n", "node"), classes, ["node"], "copies", members.n_rows)
    return out.select(F.col("doc_id").alias(id_col), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def find_pairs(nodes: DataFrame, similarity: float, leaf: int, depth: int, first_look: int, miss: float, block: int, trace: list | None, n_nodes: int) -> DataFrame:
    """Edges (a, b) between sets that are probably similar. nodes: nid, n, sketch; ``n_nodes`` rows."""

    def splitter(start: range | None, levels: range):
        """Rows (nid, path) after ``levels`` more splits; a path tells what a row shares so far. ``start``: runs that begin here."""

        def split(batches):
            for pdf in batches:
                sketch, nid = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(-1, COORDS), pdf["nid"].to_numpy()
                roots = [np.full(len(pdf), mix(np.array([r + 1], np.uint64))[0]) for r in start] if start else [pdf["path"].to_numpy(np.int64).view(np.uint64)]
                for path in roots:
                    rows = np.arange(len(pdf))
                    for level in levels:
                        step, path = children(path, sketch[rows], level, similarity)
                        rows = rows[step]
                    yield pd.DataFrame({"nid": nid[rows], "path": path.view(np.int64)})

        return split

    def sketches(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDS)

    def compare(batches):
        """Brute force inside small buckets."""
        for pdf in batches:
            a, b = [], []
            for bucket in pdf["bucket"]:
                bucket = sorted(bucket, key=lambda x: x["nid"])
                root = forest(sketch_links(sketches([x["sketch"] for x in bucket]), np.array([x["n"] for x in bucket]), similarity))
                for i in np.flatnonzero(root != np.arange(len(root))):
                    a.append(bucket[i]["nid"])
                    b.append(bucket[root[i]]["nid"])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def star(batches):
        """Whether each set of a large bucket is close to the bucket's pivot."""
        for pdf in batches:
            same = (sketches(pdf["sketch"]) == sketches(pdf["pivot_sketch"])).mean(1, dtype=np.float32)
            yield pdf[["path", "nid", "m", "pivot"]].assign(near=close(same, pdf["n"].to_numpy(), pdf["pivot_n"].to_numpy(), similarity) | (pdf["nid"] == pdf["pivot"]).to_numpy())

    def with_sketch(rows: DataFrame) -> DataFrame:
        """Only the sketches of sets in open buckets move, and each is met once: a set's rows, a few for each run, travel as one."""
        rest = [c for c in rows.columns if c != "nid"]
        each = rows.groupBy("nid").agg(F.collect_list(F.struct(*rest)).alias("rows"))
        met = each.join(maybe_in(nodes, F.col("nid"), rows.select("nid"), most=n_nodes), "nid")
        return met.select("nid", "n", "sketch", F.inline("rows"))

    entry = F.struct("nid", "n", "sketch")

    def search(these: range, known: DataFrame | None) -> list[DataFrame]:
        """Edges that the runs find. A bucket whose sets are all connected already tells nothing new and is left out."""
        # The first splits need no look at the buckets: a pair must share them all in any case.
        rows, edges, open_rows = nodes.select("nid", "sketch").mapInPandas(splitter(these, range(first_look)), "nid long, path long"), [], None
        for level in range(first_look, depth + 1):
            rows = stage(rows, f"join-level-{level}")
            drop(open_rows)
            sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.count(F.lit(1)).alias("weight")).filter("m > 1")
            sizes = stage(telling(sizes, **weights("weight")), f"join-sizes-{level}")
            hit = with_groups(rows, sizes, ["path"], "weight", rows.n_rows).filter("m is not null")
            group = hit.withColumn("g", F.col("nid")) if known is None else hit.join(known.withColumnRenamed("node", "nid"), "nid", "left").withColumn("g", F.coalesce("root", "nid")).drop("root")
            hit = stage(group, f"join-hits-{level}")
            drop(rows, sizes)
            told = hit.groupBy("path", "m").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.bit_xor(F.xxhash64("nid")).alias("xor")).filter("g1 <> g2")
            # Runs often find the same bucket again; one of each is enough.
            once = told.groupBy("m", "g1", "g2", "xor").agg(F.min("path").alias("path")).select("path", F.lit(True).alias("once"), F.col("m").alias("weight"))
            once = stage(telling(once, **weights("weight")), f"join-once-{level}")
            is_small = F.col("m") <= leaf
            inside = stage(telling(with_groups(hit, once, ["path"], "weight", hit.n_rows).filter("once").drop("once"), small=F.count(F.when(is_small, 1))), f"join-buckets-{level}")
            drop(hit, once)
            if inside.told["small"]:
                bucket = with_sketch(inside.filter(is_small)).groupBy("path").agg(F.collect_list(entry).alias("bucket")).select("bucket")  # at most ``leaf`` entries
                edges.append(stage(bucket.mapInPandas(compare, "a long, b long").distinct(), f"join-small-{level}"))
            open_rows = None
            if inside.n_rows > inside.told["small"]:
                # In a large bucket the sets are compared with one pivot; a bucket that is close to its pivot as a whole is done. The pivot
                # is of the largest part that is connected already, whose sets need no comparison with it.
                large = inside.filter(~is_small)
                parts = large.groupBy("path", "m", "g").agg(F.count(F.lit(1)).alias("c"), F.min_by("nid", F.xxhash64("nid")).alias("pivot"))
                best = F.max_by(F.struct("pivot", "g"), F.struct("c", F.bitwise_not(F.xxhash64("pivot")), "pivot"))
                pivots = stage(parts.groupBy("path", "m").agg(best.alias("best")).select("path", "m", "best.pivot", "best.g"), f"join-pivots-{level}")
                asks = stage(large.join(pivots.select("path", "g"), ["path", "g"], "left_anti"), f"join-asks-{level}")
                # Salted by the bucket's size, as all its sets may meet its pivot.
                salts = F.ceil(F.col("m") / F.lit(8 * block)).cast("int")
                pivot = pivots.join(nodes.select(F.col("nid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch")), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m", "g")
                salted = with_sketch(asks.drop("g")).withColumn("salt", F.pmod(F.xxhash64("nid"), salts).cast("int"))
                stars = stage(salted.join(pivot, ["path", "salt"]).mapInPandas(star, "path long, nid long, m long, pivot long, near boolean"), f"join-stars-{level}")
                edges.append(stage(stars.filter("near and nid <> pivot").select(F.col("nid").alias("a"), F.col("pivot").alias("b")).distinct(), f"join-near-{level}"))
                far = stars.filter("not near").select("path", "nid", F.lit(False).alias("near"))
                open_paths = far.groupBy("path").agg(F.count(F.lit(1)).alias("far"))
                open_rows = large.select("path", "nid", "m").join(open_paths, "path").join(far, ["path", "nid"], "left").withColumn("near", F.coalesce("near", F.lit(True)))
                open_rows = stage(open_rows, f"join-open-{level}")
                drop(stars, pivots, asks)
            if trace is not None:
                n_open = open_rows.select("path").distinct().count() if open_rows is not None else 0
                trace.append((level, inside.filter(is_small).select("path").distinct().count(), inside.filter(~is_small).select("path").distinct().count(), n_open))
            drop(inside)
            if open_rows is None or not open_rows.n_rows:
                return edges
            if level < depth:
                rows = with_sketch(open_rows.select("path", "nid")).mapInPandas(splitter(None, range(level, level + 1)), "nid long, path long")
        # What still shares every sampled token at full depth: the sets that are not close to the pivot meet all sets of the bucket, block by block.
        far_blocks, blocks = F.ceil(F.col("far") / F.lit(block)).cast("int"), F.ceil(F.col("m") / F.lit(block)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
        asking = open_rows.filter("not near").select("path", "nid", own(far_blocks).alias("i"), spread(blocks).alias("j"))
        asked = open_rows.select("path", "nid", spread(far_blocks).alias("i"), own(blocks).alias("j"))
        pairs = with_sketch(asking.unionByName(asked).distinct()).groupBy("path", "i", "j").agg(F.collect_list(entry).alias("bucket")).select("bucket")
        return [*edges, pairs.mapInPandas(compare, "a long, b long").distinct()]

    def all_of(found: list[DataFrame]) -> DataFrame:
        out = nodes.sparkSession.createDataFrame([], "a long, b long")
        found = [out, *found]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    # The first runs find most of it; the others then look only at buckets that could still connect something.
    runs = runs_for(similarity, depth, miss)
    first = min(2, runs)
    edges = stage(all_of(search(range(first), None)), "join-edges")
    if runs > first:
        edges = edges.unionByName(all_of(search(range(first, runs), components(edges))))
    return edges


def exact_classes(full: DataFrame, similarity: float, block: int, block_bytes: int) -> DataFrame:
    """(node, links, class) of the sets in cells. full: node, items, root (the cell), copies, parts, own, nid, pivot.

    With P the pivot's set and x = P without ``lacks`` elements and with ``adds`` others, two sets of a cell have
    |x & y| = |P| - lacks - lacks' + o and |x | y| = |P| + adds + adds' - o, o being the common elements of their differences
    from P. So with w = lacks + similarity * adds they are linked when w + w' - (1 + similarity) o <= (1 - similarity) |P|.
    Without o that is a count of w in order: no pairs. Only sets with w beyond half of the bound can need an o, and
    only they meet the other sets' differences, block by block.
    """
    columns = ["root", "node", "copies", "parts", "own", "pivot", "nid"]

    def from_pivot(sets: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
        rows = []
        for x in sets["items"]:
            x = np.frombuffer(x, np.uint64)
            d = np.setxor1d(x, p, assume_unique=True)
            adds = (len(d) + len(x) - len(p)) // 2
            rows.append((len(p), len(d) - adds, adds, d.tobytes()))
        return pd.concat([sets[columns].reset_index(drop=True), pd.DataFrame(rows, columns=["n_pivot", "lacks", "adds", "diff"])], axis=1)

    def differ(sets: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        return from_pivot(sets, np.frombuffer(pivot["p"].iloc[0], np.uint64))

    def differ_cells(sets: pd.DataFrame) -> pd.DataFrame:
        """Whole cells, many in a group."""
        return pd.concat([from_pivot(c, np.frombuffer(c["items"][c["nid"] == c["pivot"]].iloc[0], np.uint64)) for _, c in cells_of(sets)])

    about = "root long, node binary, copies long, parts int, own int, pivot long, nid long, n_pivot long, lacks long, adds long, diff binary"
    # Cells of one part are dealt out to lots of bounded size; a larger cell is a group for each part, and each gets the pivot.
    lots = lambda size: max(1, -(-(size or 0) // (block_bytes // 4)))
    whole, cut = full.filter("parts = 1"), full.filter("parts > 1")
    lot = F.pmod(F.xxhash64("root"), F.lit(lots(full.told["whole"]))).alias("lot")
    pivots = cut.filter("nid = pivot").select("root", F.col("items").alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    diffs = whole.groupBy(lot).applyInPandas(differ_cells, about).unionByName(cut.groupBy("root", "own").cogroup(pivots.groupBy("root", "own")).applyInPandas(differ, about))
    diffs = stage(diffs, "join-diffs")

    # Links that need no o, for every (lacks, adds) of a cell: how many w' are within the bound less w. A running count in order.
    counted = diffs.groupBy("root", "parts", "n_pivot", "lacks", "adds").agg(F.sum("copies").alias("n"))
    w, bound = F.col("lacks") + similarity * F.col("adds"), (1 - similarity) * F.col("n_pivot") + 1e-9
    counted = stage(counted.withColumn("w", w).withColumn("bound", bound), "join-counts")
    points = counted.select("root", F.col("w").alias("at"), F.lit(0).alias("asks"), "n", "w")
    asks = counted.select("root", (F.col("bound") - F.col("w")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("n"), "w", "parts", "lacks", "adds", "bound")
    by = W.partitionBy("root")
    so_far = F.sum("n").over(by.orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0))
    ranks = points.unionByName(asks, allowMissingColumns=True).withColumn("plain", so_far).withColumn("most", F.max("w").over(by)).filter("asks = 1")
    far = (2 * F.col("w") > F.col("bound")) & (F.col("w") + F.col("most") > F.col("bound"))
    ranks = ranks.select("root", "lacks", "adds", "plain", (2 * F.col("w") <= F.col("bound")).alias("itself"), far.alias("far"), (F.col("w") > F.col("bound")).alias("alone"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    known = stage(diffs.join(ranks, ["root", "own", "lacks", "adds"]).withColumn("links", F.col("plain") - F.when(F.col("itself"), F.col("copies")).otherwise(0)), "join-ranks")
    drop(diffs, counted)

    # Far sets and all sets of their cells, in blocks.
    total = known.n_rows
    wide = known.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("diff")).alias("b"), F.count(F.when(F.col("far"), 1)).alias("far_m"), F.sum(F.when(F.col("far"), F.octet_length("diff"))).alias("far_b")).filter("far_m > 0")
    part = lambda n, b: F.greatest(F.ceil(F.col(n) / F.lit(block)), F.ceil(F.col(b) / F.lit(block_bytes))).cast("int")
    wide = wide.select("root", part("far_m", "far_b").alias("ni"), part("m", "b").alias("nj"), "m", (F.col("far_b") + F.col("b")).alias("size"))
    wide = stage(telling(wide, lone=F.sum(F.when((F.col("ni") == 1) & (F.col("nj") == 1), F.col("size"))), **weights("m")), "join-wide")
    laid = with_groups(known, wide, ["root"], "m", total).filter("ni is not null")
    columns = ["root", "i", "j", "asks", "node", "copies", "far", "n_pivot", "lacks", "adds", "diff", "ni", "nj"]
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = laid.filter("far").withColumn("i", own("ni")).withColumn("j", spread("nj")).withColumn("asks", F.lit(True)).select(*columns)
    asked = laid.withColumn("j", own("nj")).withColumn("i", spread("ni")).withColumn("asks", F.lit(False)).select(*columns)

    def meet_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([meet(c) for _, c in cells_of(pdf)])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        f, a = pdf[pdf["asks"]].reset_index(drop=True), pdf[~pdf["asks"]].reset_index(drop=True)
        if not len(f) or not len(a):
            return pd.DataFrame({"node": [], "links": [], "to": []})
        wf, wa = (x["lacks"].to_numpy() + similarity * x["adds"].to_numpy() for x in (f, a))
        o = overlaps(*[[np.frombuffer(d, np.uint64) for d in x["diff"]] for x in (f, a)])
        bound, least = (1 - similarity) * pdf["n_pivot"].iloc[0] + 1e-9, wf[:, None] + wa[None]
        other = f["node"].to_numpy()[:, None] != a["node"].to_numpy()[None]
        link = (least - (1 + similarity) * o <= bound) & other
        more = link & (least > bound)
        square = np.zeros((len(f) + len(a),) * 2, bool)
        square[: len(f), len(f) :] = link
        root = forest(square | square.T)
        node = np.concatenate((f["node"].to_numpy(), a["node"].to_numpy()))
        # A far set counts all its sets here; a set that is not far counts the far ones.
        links = np.concatenate((more @ a["copies"].to_numpy(), np.where(a["far"].to_numpy(bool), 0, f["copies"].to_numpy() @ more)))
        return pd.DataFrame({"node": node, "links": links.astype(np.int64), "to": node[root]})

    sides = asking.unionByName(asked)
    lone = sides.filter("ni = 1 and nj = 1")
    lot = F.pmod(F.xxhash64("root"), F.lit(lots(wide.told["lone"]))).alias("lot")
    found = "node binary, links long, to binary"
    met = stage(lone.groupBy(lot).applyInPandas(meet_cells, found).unionByName(sides.filter("ni > 1 or nj > 1").groupBy("root", "i", "j").applyInPandas(meet, found)), "join-met")
    more = met.groupBy("node").agg(F.sum("links").alias("more"))
    sizes = known.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.max(F.when(F.col("nid") == F.col("pivot"), F.col("node"))).alias("pivot_node"))
    sizes = sizes.join(wide.select("root", F.lit(True).alias("mixed")), "root", "left")
    near = stage(with_groups(known.select("root", "node", "links", "alone"), stage(telling(sizes, **weights("m")), "join-sizes"), ["root"], "m", total), "join-near")
    # Whatever is linked to the pivot is one class; where far sets are, their links may add to it or connect others.
    star = near.filter("mixed and not alone and node <> pivot_node").select(F.col("node").alias("a"), F.col("pivot_node").alias("b"))
    reached = components(star.unionByName(met.filter("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))))
    out = near.join(more, "node", "left").join(reached.withColumnRenamed("root", "reached"), "node", "left")
    group = F.when(F.col("mixed"), F.coalesce("reached", "node")).otherwise(F.col("pivot_node"))
    return out.select("node", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), group.alias("class"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
