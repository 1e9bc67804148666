"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and a proof for each leaf.

H is the SHA-256 in lower-case hex of its inputs one after the other, digests as hex text. A leaf is H of the row's fields, each ``-``
for null, else its UTF-8 byte count, ``:`` and the value. The leaves of a source ascend by id (a null id first; of equal ids the
lesser leaf first). While a tree has several nodes, every three consecutive ones, in the last run as many as are left, become their H.
A tree of one leaf is that leaf. The roots of the sources, by source (null first, then by bytes), are the leaves of the last tree.

Nodes are appended to an ``OpenTree`` one by one. A node that arrives gives each open sibling of its run its digest, and takes theirs:
these partial witnesses are kept once for a whole subtree, and a later sibling extends them. Blocks of ``3 ** block_levels`` leaves
that start at a multiple of that number are complete subtrees, so each is grown in a task of its own; their roots are appended as
nodes further up in the same way, over as many rounds as the largest tree needs. A leaf's proof is its witness in its block, then
that of its block, and so on up to the root.

Empty tables give empty results; rows that repeat are leaves of their own; extra columns are ignored.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_TABLE_SQL, crc32_sql, numbered, stage, table

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def combine(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class OpenTree:
    """A tree that nodes are appended to. ``open``: by level, the nodes of the run that is not full; ``before`` and ``after``: by level and node, what its siblings have added to its witness so far."""

    def __init__(self):
        self.open: list[list[bytes]] = []
        self.before: list[list[bytes]] = []
        self.after: list[list[bytes]] = []

    def append(self, digest: bytes, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.before.append([])
            self.after.append([])
        run, before, after = self.open[level], self.before[level], self.after[level]
        for k in range(1, len(run) + 1):
            after[-k] += digest
        before.append(b"".join(run))
        after.append(b"")
        run.append(digest)
        if len(run) == FAN:
            self._fold(level)

    def _fold(self, level: int) -> None:
        node, self.open[level] = combine(self.open[level]), []
        self.append(node, level + 1)

    def close(self, levels: int) -> bytes:
        """Fold what is open up to ``levels``; the node there."""
        for level in range(levels):
            if self.open[level]:
                self._fold(level)
        return self.open[levels][-1]

    def witness(self, leaf: int, levels: int) -> tuple[list[bytes], list[bytes]]:
        """The siblings to the left and to the right of each level, so far."""
        at = [leaf // FAN**k for k in range(levels)]
        return [self.before[k][i] for k, i in enumerate(at)], [self.after[k][i] for k, i in enumerate(at)]


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    d = 0
    while FAN**d < n:
        d += 1
    return d


def grow(nodes: DataFrame, keep: tuple[str, ...], block_levels: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Proofs of the nodes of many trees, and the trees' roots.

    ``nodes``: tree (not null), pos, n (nodes of the tree), digest (binary) and the columns ``keep``. Proofs: tree, pos, n, digest,
    ``keep``, before, after (siblings on both sides by level, up to the root). Roots: tree, root.
    """
    size = FAN**block_levels

    def append(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        levels = min(block_levels, depth(int(pdf["n"].iloc[0])))
        tree = OpenTree()
        for digest in pdf["digest"]:
            tree.append(digest)
        root = tree.close(levels)
        sides = [tree.witness(i, levels) for i in range(len(pdf))]
        pdf["before"], pdf["after"] = [s[0] for s in sides], [s[1] for s in sides]
        pdf["root"] = [root] + [None] * (len(pdf) - 1)
        return pdf

    here = nodes.select("tree", "pos", "n", "digest", *keep).withColumn("block", F.floor(F.col("pos") / size))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema) + ", before array<binary>, after array<binary>, root binary"
    rows = stage(here.groupBy("tree", "block").applyInPandas(append, shape), label)
    done = rows.filter((F.col("n") <= size) & F.col("root").isNotNull()).select("tree", "root")
    rows, tops = rows.drop("root"), rows.filter((F.col("n") > size) & F.col("root").isNotNull())
    tops = tops.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
    if tops.isEmpty():
        return rows.drop("block"), done
    above, roots = grow(tops, (), block_levels, f"{label}-up")
    above = above.select("tree", F.col("pos").alias("block"), F.col("before").alias("_b"), F.col("after").alias("_a"))
    whole = rows.join(above, ["tree", "block"], "left")
    for own, up in (("before", "_b"), ("after", "_a")):
        whole = whole.withColumn(own, F.when(F.col(up).isNull(), F.col(own)).otherwise(F.concat(own, up)))
    return whole.drop("block", "_b", "_a"), done.unionByName(roots)


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_digest(fields: list[Column]) -> Column:
    """Leaf of a row, binary."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def merkle_manifest(leaves: DataFrame, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = (), block_levels: int = 7) -> DataFrame:
    """``leaves``: id, source, leaf (binary) and the columns ``keep``. Adds subroot, root and the proof: before and after by level."""
    # Null is no key of a join; "1" before a source keeps it apart from every source.
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    slim = leaves.select(tree.alias("tree"), F.col(id_col).alias("_id"), F.col("leaf").alias("digest"), *keep)
    nodes = numbered(slim, ["tree"], ["_id", "digest"], "merkle-leaves")
    proofs, roots = grow(nodes, ("_id", *keep), block_levels, "merkle-blocks")
    tops = numbered(roots.select(F.lit(0).alias("all"), "tree", "root"), ["all"], ["tree"], "merkle-sources")
    sources, last = grow(tops.select(F.lit("all").alias("tree"), "pos", "n", F.col("root").alias("digest"), F.col("tree").alias("of")), ("of",), block_levels, "merkle-top")
    per_source = sources.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("before").alias("_b"), F.col("after").alias("_a"), F.lit("all").alias("_all")).join(F.broadcast(last.select(F.col("tree").alias("_all"), "root")), "_all")
    joined = proofs.join(per_source, "tree")
    source = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)"))
    return joined.select(
        F.col("_id").alias(id_col), source.alias(source_col), "pos", F.col("digest").alias("leaf"), *keep, "subroot", "root",
        F.concat("before", "_b").alias("before"), F.concat("after", "_a").alias("after"),
    )


def proof_hash(before: Column, after: Column) -> Column:
    """H of all siblings, level by level, from left to right."""
    return F.sha2(F.concat(F.array_join(F.transform(F.arrays_zip(before.alias("b"), after.alias("a")), lambda s: F.concat(hex_text(s["b"]), hex_text(s["a"]))), "")), 256)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings give, hex."""
    step = lambda h, s: F.sha2(F.concat(hex_text(s["b"]), h, hex_text(s["a"])), 256)
    return F.aggregate(F.arrays_zip(before.alias("b"), after.alias("a")), hex_text(leaf), step)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), leaf_digest([*fields[:-1], tampered]).alias("seen"))
    proofs = merkle_manifest(leaves, keep=("seen",))
    out = proofs.withColumn("folded_root", folded(F.col("seen"), F.col("before"), F.col("after")))
    return out.select(
        "doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        proof_hash(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == hex_text(F.col("root"))).alias("verified"),
    )


def _levels(name: str, start: str, levels: int) -> str:
    """CTEs: nodes by level, and what each leaf's proof (p) and folded digest (f) have become after it."""
    out = [f"{name}_0 AS MATERIALIZED ({start})", f"{name}_r0 AS MATERIALIZED (SELECT * FROM {name}_0)"]
    run = "PARTITION BY tree, pos // 3 ORDER BY pos"
    for k in range(levels):
        sides = f"""SELECT tree, pos, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
          coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}_{k} WINDOW w AS ({run})"""
        out.append(f"{name}_s{k} AS MATERIALIZED ({sides})")
        out.append(f"""{name}_r{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (r.pos // 3 AS pos, (r.n + 2) // 3 AS n, p || b || a AS p, CASE WHEN r.n > 1 THEN sha256(b || f || a) ELSE f END AS f)
          FROM {name}_r{k} r JOIN {name}_s{k} s USING (tree, pos))""")
        out.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
          FROM {name}_{k} GROUP BY tree, pos // 3, n)""")
    return ", ".join(out)


def _op11_sql(levels: int = 20, top_levels: int = 12) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(part(c) for c in FIELDS[:-1])
    leaf = f"""SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS tree, sha256({head} || {part("text")}) AS leaf, sha256({head} || {part("seen")}) AS seen
      FROM (SELECT d.*, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents d, crc_table)"""
    start = "SELECT rid, doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h, leaf, seen AS f, '' AS p FROM leaves"
    tops = f"SELECT tree AS of, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h, '' AS p, h AS f FROM a_{levels}"
    # The second pass carries each leaf's own digest through its source's proof.
    second = f"SELECT a.rid, a.doc_id, a.leaf, s.h AS subroot, 0 AS tree, s.pos, s.n, a.p, a.f FROM a_r{levels} a JOIN b_0 s ON s.of = a.tree"
    chain = [f"c_0 AS MATERIALIZED ({second})"]
    for k in range(top_levels):
        chain.append(f"c_{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (r.pos // 3 AS pos, (r.n + 2) // 3 AS n, p || b || a AS p, CASE WHEN r.n > 1 THEN sha256(b || f || a) ELSE f END AS f) FROM c_{k} r JOIN b_s{k} s USING (tree, pos))")
    return f"""WITH {CRC32_TABLE_SQL}, leaves AS MATERIALIZED ({leaf}), {_levels("a", start, levels)}, {_levels("b", tops, top_levels)}, {", ".join(chain)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM c_{top_levels}, (SELECT h FROM b_{top_levels})"""


OP11_SQL = _op11_sql()
