"""Brute-force twins and edge cases of the Merkle manifest, line deduplication and conversation repair."""

import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlore.llm import conversation, line_dedup, merkle, queries
from pointlore.llm.common import numbered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, value string, _p long, pos long, before string, tree string, id long, print string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "v", 3, 1, "b", "t", 5, "p") for i, t, s in rows], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", ["op11_merkle", "op12_line_dedup", "op13_conversation"])
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name]).df()[got.columns]
    rows = lambda df: collections.Counter(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got.toPandas()) == rows(want)


def test_numbered(spark):
    rows = [(k, v % 7) for k in "ab" for v in range(200)]
    got = numbered(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"], "t").collect()
    for k in "ab":
        mine = sorted((r["pos"], r["v"]) for r in got if r["k"] == k)
        assert [m[0] for m in mine] == list(range(200)) and [m[1] for m in mine] == sorted(v for x, v in rows if x == k)
    assert {r["n"] for r in got} == {200}


# --- Merkle manifest -----------------------------------------------------------------------------


def plain_tree(leaves):
    """Root and siblings (left and right, by level) of each leaf."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf, i in enumerate(at):
            run, k = runs[i // 3], i % 3
            proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, at = [sha(*r) for r in runs], [i // 3 for i in at]
    return level[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100])
def test_open_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree, seen = merkle.OpenTree(), {}
    for i, d in enumerate(leaves):
        tree.append(bytes.fromhex(d))
        # A witness only ever grows.
        for leaf in (0, i):
            b, a = tree.witness(leaf, len(tree.open)) if FULL(leaf, tree) else ([], [])
            old = seen.get(leaf, ([], []))
            assert all(x.startswith(y) for x, y in zip(a, old[1])) and b[: len(old[0])] == old[0]
            seen[leaf] = (b, a)
    root = tree.close(merkle.depth(n)).hex()
    want, proofs = plain_tree(leaves)
    assert root == want
    for i in range(n):
        b, a = tree.witness(i, merkle.depth(n))
        assert [(x.hex(), y.hex()) for x, y in zip(b, a)] == proofs[i]


def FULL(leaf, tree):
    """Whether the leaf has a node on every level so far."""
    return all(leaf // 3**k < len(tree.before[k]) for k in range(len(tree.open)))


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*[field(x) for x in (r[0], r[2], "en", len(r[1] or ""), t)])
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for x, own in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            r, proof = x[3], own + tops[k]
            cut = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            d = leaf(r, r[1].replace("\n", "") if cut else r[1])
            for b, a in proof:
                d = sha(b, d, a)
            out.append((r[0], x[2], trees[s][0], root, sha(*itertools.chain(*proof)), d, d == root))
    return out


@pytest.mark.parametrize("block_levels", [1, 2, 7])
def test_manifest(spark, tmp_path, block_levels, monkeypatch):
    rnd = random.Random(block_levels)
    texts = ["a\nb", "", None, "x" * 300_000 + "\n", "ünï\ncode", "same", "same"]
    rows = [(i, rnd.choice(texts), rnd.choice(["hot"] * 6 + ["é", "z", "", None])) for i in range(150)]
    rows += [(None, "no id\n", "hot"), (None, "no id\n", "hot"), (7, "again", "hot"), (7, "again\n", "hot"), (1, None, "alone")]
    docs_of(spark, rows).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    grow = merkle.grow
    monkeypatch.setattr(merkle, "grow", lambda nodes, keep, levels, label: grow(nodes, keep, block_levels, label))
    got = [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert collections.Counter(got) == collections.Counter(brute_manifest(rows))
    assert 0 < sum(g[-1] for g in got) < len(got)


def test_manifest_empty(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle(spark, str(tmp_path)).collect() == []


# --- lines ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in "ab")
    a[: n // 3] = a[:1].repeat(n // 3)  # pairs that share a half are pairs of their own
    h = line_dedup.PerfectHash.build(a, b)
    again = line_dedup.PerfectHash(h.sizes, h.packed())
    assert sorted(again.places(a, b).tolist()) == list(range(n))
    assert n < 1000 or len(h.packed()) * 8 < 6 * n
    other = again.places(b, a)
    assert ((other >= -1) & (other < max(n, 1))).all()


def brute_lines(rows):
    up = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(up) for x in (t or "").split("\n")] for _, t, _ in rows]
    none = float("inf")
    owner = {}
    for (i, _, _), ks in zip(rows, keys):
        for k in ks:
            owner[k] = min(owner.get(k, none), none if i is None else i)
    out = []
    for (i, t, _), ks in zip(rows, keys):
        keep = [x for x, k in zip((t or "").split("\n"), ks) if len(k) < 10 or owner[k] == (none if i is None else i)]
        out.append((i, "\n".join(keep), len(ks), len(ks) - len(keep)))
    return out


@pytest.mark.parametrize("shard_keys,shard_lines,sender_lines", [(1 << 18, 1 << 20, 1 << 20), (5, 40, 30)])
def test_lines(spark, shard_keys, shard_lines, sender_lines):
    rnd = random.Random(5)
    pool = ["A line that many share", "  a LINE that many share\t\r", "short", "ÄÖÜäöüßéèê", "äöüäöüßéèê", "日本語日本語日本語", "日本語日本語日本語日", "exactly 10", "nine char", "\x0bhidden  blanks\x0c", "hidden  blanks", "İstanbul is a long line", "x" * 5000]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else f"own line {rnd.randrange(60)} of this text" for _ in range(rnd.randrange(12))), "s") for i in range(-40, 120)]
    rows += [(None, "A line that many share\nonly where no id is", "s"), (None, "only where no id is\n\nown words, no copies", "s"), (3, None, "s"), (3, "", "s"), (500, "\n\n", "s"), (77, "only in one document\nonly in one document", "s"), (78, "\n".join(["A line that many share"] * 3000 + ["the long one ends here"]), "s"), (78, "same id, other text\nthe long one ends here", "s")]
    rows += rows[:3] + [rows[-8]]
    got = line_dedup.drop_repeated_lines(docs_of(spark, rows).repartition(5), shard_keys=shard_keys, shard_lines=shard_lines, sender_lines=sender_lines)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute_lines(rows))


def test_lines_empty(spark):
    assert line_dedup.drop_repeated_lines(docs_of(spark, [])).collect() == []
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(docs_of(spark, [(1, None, "s")])).collect()] == [(1, "", 1, 0)]


def test_line_counts(spark):
    """The arrays of the index: places, counts of lines, owners."""
    rows = [(i, "shared by all of them\nshared by all of them\nalone " + str(i) * 10, "s") for i in range(5, 9)]
    index, shards = line_dedup.line_index(docs_of(spark, rows))
    (r,) = index.collect()
    assert shards == 1 and np.frombuffer(r["counts"], r["width"]).tolist() == [8] and np.frombuffer(r["owners"], np.int64).tolist() == [5]


# --- conversations ------------------------------------------------------------------------------------


def brute_repair(rows):
    """rows: (role, text) in order. Cost, audit and repaired lines by the cheapest, then least, sequence of edits."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = {"": (0, "", [])}  # by what has been read: nothing, s, u, a
    nxt = {"": "u", "s": "u", "a": "u", "u": "a"}
    name = {"u": "user", "a": "assistant"}

    def better(a, b):
        return b is None or (a[0], a[1]) < (b[0], b[1])

    def put(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, audit, said) in list(out.items()):
                new = (c + 5, audit + "I", said + [f"{name[nxt[s]]}:"])
                if better(new, out.get(nxt[s])):
                    out[nxt[s]] = new
        return out

    for (role, text), fault in zip(rows, faults):
        out = {}
        for s, (c, audit, said) in put(best).items():
            options = [(s, (c + 2, audit + "D", said))]
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if role[:1] == nxt[s] or (role[:1] == "s" and s == ""):
                    options.append((role[:1], (c + more, audit + "K", said + [f"{role}:{text}"])))
                options.append((nxt[s], (c + more + 1, audit + "R", said + [f"{name[nxt[s]]}:{text}"])))
            for t, x in options:
                if better(x, out.get(t)):
                    out[t] = x
        best = out
    end = min((x for s, x in put(best).items() if s in ("", "a")), key=lambda x: (x[0], x[1]))
    wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [faults.count(k) for k in (1, 2, 3)] + [wrong, end[0], end[1]], "\n".join(end[2])


def talk(rnd, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    texts = ["Yes.", "no", "", "  ", "Well?", "Hm!  ", "What ", "Ü.", "long " * 40 + "."]
    return [(rnd.choice(roles[: rnd.choice([2, 3, 7])]), rnd.choice(texts) if rnd.random() < 0.5 else f"said {rnd.randrange(10**6)}" + rnd.choice([".", "", "?"])) for _ in range(n)]


@pytest.mark.parametrize("block_rows,fan", [(1024, 1024), (5, 3)])
def test_repair(spark, block_rows, fan):
    rnd = random.Random(block_rows)
    talks = {f"c{k}": talk(rnd, rnd.randrange(1, 9)) for k in range(60)} | {"hot": talk(rnd, 300), "turns": [("user", f"Q{i}.") if i % 2 == 0 else ("assistant", f"A{i}.") for i in range(41)], "same": [("user", "again.")] * 50, "users": [("user", f"{i}.") for i in range(23)]}
    rows = [(c, i, r, t, "x") for c, said in talks.items() for i, (r, t) in enumerate(said)]
    rnd.shuffle(rows)
    facts, repaired = conversation.repair(spark.createDataFrame(rows, "conv string, turn long, role string, text string, block string").repartition(7), block_rows, fan)
    got = {r["conv"]: [r[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")] for r in facts.collect()}
    sha_of = {r["conv"]: r["sha"] for r in conversation.hash_repaired(repaired).collect()}
    assert set(got) == set(talks)
    for c, said in talks.items():
        want, text = brute_repair(said)
        assert got[c] == want, c
        assert sha_of.get(c, sha("")) == sha(text), c


def test_damage_and_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, t, r, x, "extra", 1) for c in range(80) for t, (r, x) in enumerate(talk(rnd, rnd.randrange(1, 8))) if rnd.random() < 0.9]
    rows += [(None, None, None, None, "extra", 1), (None, 3, "user", "Hi.", "extra", 1), (7, None, "system", "Be good.", "extra", 1), (1000, 5, "user", None, "extra", 1), (1001, 5, "user", "x" * 200_000 + ".", "extra", 1)]
    rows += [(1002, 4, "user", "twice.", "extra", 1)] * 2
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, pos long").coalesce(3).write.parquet(f"{tmp_path}/conversations.parquet")
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        by[c]
        if kind:
            text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(kind, text)
            by[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = []
    for c, mine in by.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        turns = [x[0] for x in mine if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        numbers, text = brute_repair([x[1:] for x in mine])
        want.append((c, gaps, *numbers, sha(text)))
    got = [tuple(r) for r in conversation.op13_conversation(spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_talk_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversation.op13_conversation(spark, str(tmp_path)).collect() == []
