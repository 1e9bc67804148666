"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu), where
h' is h without its first word and P(w) = (c(w) + 1) / (N + V + 1). It becomes an automaton: every context h
that the training texts hold is a state; a word w seen after h has an arc of weight P(w|h) to the state of
the longest known suffix of hw; for every other word the failure arc of weight mu / (c(h) + mu) leads to
the state of h'. The state without context has an arc for every word. A text is read once, from left to
right, and the log10 weights of the arcs taken are added up.

The counts of the whole corpus never meet in one place. Documents are packed into blocks of bounded
size. A block sends its distinct n-grams, with their training counts, to owners of ranges of their
hashes; owners add up and answer each block, which builds the part of the automaton that its texts can
reach. Where one level of owners would mean too many short lists, blocks are grouped: a group's lists
are added up first, and group and owner exchange lists in the same way. Words are told apart by 64 bits
and longer n-grams by 56 bits of their hash.

Null texts are empty and score their end token; a null id counts as the id ''; repeated rows count and
score each for itself; an empty table gives an empty result; extra columns are ignored.
"""

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .hashing import BASE, mix, word_hashes

START, END = np.uint64(0x5BD1E995C2B2AE35), np.uint64(0x27D4EB2F165667C5)
WIDTH = (64, 56)  # bits of a word's key and of a longer n-gram's
LISTS = "parent long, range long, sender long, keys binary, counts binary"
ANSWERS = "parent long, range long, sender long, totals binary"


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end token; number of tokens of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h, start = word_hashes(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    last = np.searchsorted(start, ends)
    return np.insert(h, last, END), np.diff(last, prepend=0) + 1


class Level:
    """The distinct n-grams of one length in a block: sorted ``keys``, where each is ``first`` found, and which one ends at a token (``at``; -1: none)."""

    def __init__(self, grams: np.ndarray, valid: np.ndarray | None = None):
        if valid is None:
            self.keys, self.first, self.at = np.unique(grams, return_index=True, return_inverse=True)
        else:
            where = np.flatnonzero(valid)
            self.keys, first, at = np.unique(grams[where], return_index=True, return_inverse=True)
            self.first, self.at = where[first], np.full(len(grams), -1, np.int64)
            self.at[where] = at


def levels_of(vocab: np.ndarray, place: np.ndarray, sizes: np.ndarray, order: int) -> list[Level]:
    """n-grams of 1 to ``order`` words; the text's start counts as a word before its first."""
    begin = np.cumsum(sizes) - sizes
    number = np.arange(len(place)) - np.repeat(begin, sizes)
    words = Level.__new__(Level)
    words.keys, words.at = vocab, place
    words.first = np.zeros(len(vocab), np.int64)
    words.first[place[::-1]] = np.arange(len(place))[::-1]
    out, tokens = [words], vocab[place]
    last = tokens
    for n in range(2, order + 1):
        before = np.concatenate((last[:1], last[:-1]))
        if n == 2:
            before = np.where(number == 0, START, before)
        last = mix(before * np.uint64(BASE) + tokens + np.uint64(n)) >> np.uint64(64 - WIDTH[1])
        out.append(Level(last, number >= n - 2))
    return out


def range_of(keys: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The range of each key: its length and its first ``bits`` bits."""
    prefix = (keys >> np.uint64(WIDTH[length > 1] - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return prefix | length << 48


def cut(keys: np.ndarray, counts: np.ndarray, length: int, bits: int, sender: int, parent: int) -> pd.DataFrame:
    """One list for every range that the keys touch."""
    ranges = range_of(keys, length, bits)
    found, start = np.unique(ranges, return_index=True)
    stop = np.append(start[1:], len(keys))
    rows = [(parent, int(r), sender, pack_keys(keys[a:b]), pack(counts[a:b])) for r, a, b in zip(found, start, stop)]
    return pd.DataFrame(rows, columns=["parent", "range", "sender", "keys", "counts"])


def merged(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some lists, their counts added up, and where each list's keys are among them."""
    keys = [unpack_keys(k) for k in lists["keys"]]
    seen, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack(c, np.uint64) for c in lists["counts"]]).astype(np.float64), len(seen)).astype(np.uint64)
    return seen, total, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


MAX_PARTITIONS = 50_000


def answer(lists: pd.DataFrame) -> pd.DataFrame:
    """The owner of a range: totals for every list; of words also (sender -1) how many are in the training texts."""
    _, total, places = merged(lists)
    rows = [(int(p), int(r), int(s), pack(total[at])) for p, r, s, at in zip(lists["parent"], lists["range"], lists["sender"], places)]
    if int(lists["range"].iloc[0]) >> 48 == 1:
        rows.append((-1, 0, -1, pack(np.array([(total > 0).sum()], np.uint64))))
    return pd.DataFrame(rows, columns=["parent", "range", "sender", "totals"])


def partitions(groups: int) -> int:
    """So many that a partition holds few groups, and no more than a driver can follow: groups do not need one each."""
    return max(1, min(groups, MAX_PARTITIONS))


def exchange(lists: DataFrame, n_keys: int, bits: int, max_keys: int, fan_bits: int) -> DataFrame:
    """ANSWERS to all ``lists``, which are cut into ranges of ``bits`` bits and hold ``n_keys`` keys of each length at most.

    A group of lists holds about ``max_keys`` keys. An owner takes a whole range; where ranges are larger, each of several
    groups adds its lists up, cuts them ``fan_bits`` finer and asks in turn.
    """
    groups = -(-n_keys // (max_keys << bits))
    if groups <= 1 or bits + fan_bits > 40:
        return lists.repartition(partitions(3 << bits), "range").groupBy("range").applyInPandas(answer, ANSWERS)
    mine = stage(lists.withColumn("group", F.pmod(F.xxhash64("sender"), F.lit(groups))), "lm-lists")

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total, _ = merged(pdf)
        return cut(seen, total, int(key[0]) >> 48, bits + fan_bits, int(key[1]), int(key[0]))

    asked = mine.repartition(partitions(groups * 3 << bits), "range", "group").groupBy("range", "group").applyInPandas(ask, LISTS)
    answers = stage(exchange(asked, n_keys, bits + fan_bits, max_keys, fan_bits), "lm-totals")

    def pass_on(lists: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, places = merged(lists)
        total = np.concatenate([unpack(t, np.uint64) for t in answers.sort_values("range")["totals"]])
        rows = [(int(p), int(r), int(s), pack(total[at])) for p, r, s, at in zip(lists["parent"], lists["range"], lists["sender"], places)]
        return pd.DataFrame(rows, columns=["parent", "range", "sender", "totals"])

    told = mine.groupBy("range", "group").cogroup(answers.filter("parent >= 0").groupBy("parent", "sender")).applyInPandas(pass_on, ANSWERS)
    return told.unionByName(answers.filter("parent < 0"))


class Automaton:
    """States, arcs and failure arcs for the texts of a block.

    State 0 has no context, state 1 is the start of a text. ``arc`` is sorted by state and word; ``weight`` and ``to`` go with it.
    """

    def __init__(self, levels: list[Level], totals: list[np.ndarray], starts: np.ndarray, n: int, v: int, n_train: int, mu: float):
        words, order = levels[0], len(levels)
        self.width, self.at = len(words.keys), words.at
        first = np.zeros(len(words.at), bool)
        first[starts] = True
        is_end = words.keys == END
        fail, penalty = [np.array([0, 0])], [np.array([0.0, np.log10(mu / (n_train + mu))])]
        arcs, weights, targets, n_states = [], [], [], 2
        p_lower, state_lower = None, None
        for length, (level, total) in enumerate(zip(levels, totals), 1):
            where, seen = level.first, total > 0
            last = words.at[where]
            if length == 1:
                p, source = (total + 1) / (n + v + 1), np.zeros(len(total), np.int64)
                suffix, has_arc = np.zeros(len(total), np.int64), np.ones(len(total), bool)
            else:
                below = levels[length - 2]
                context = below.at[where - 1]
                count, source = totals[length - 2][context].astype(np.float64), state_lower[context]
                if length == 2:
                    count, source = np.where(first[where], n_train, count), np.where(first[where], 1, source)
                p = (total + mu * p_lower[below.at[where]]) / (count + mu)
                suffix, has_arc = state_lower[below.at[where]], seen
            state = suffix
            if length < order:
                known = np.flatnonzero(seen & ~is_end[last])
                state = suffix.copy()
                state[known] = n_states + np.arange(len(known))
                n_states += len(known)
                fail.append(suffix[known])
                penalty.append(np.log10(mu / (total[known] + mu)))
            arcs.append((source * self.width + last)[has_arc])
            weights.append(np.log10(p[has_arc]))
            targets.append(state[has_arc])
            p_lower, state_lower = p, state
        arc = np.concatenate(arcs)
        by = np.argsort(arc)
        self.arc, self.weight, self.to = arc[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        self.fail, self.penalty, self.memory = np.concatenate(fail), np.concatenate(penalty), order - 1

    def walk(self, sizes: np.ndarray, stretch: int = 256) -> np.ndarray:
        """log10 weight of the arcs taken for every token.

        Texts are read side by side, a long one in stretches of ``stretch`` tokens. A state forgets all but the last order - 1
        words, so a reader that starts so many words before its stretch is in the right state where it begins to count.
        """
        out, begin = np.zeros(len(self.at)), np.cumsum(sizes) - sizes
        n = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), n)
        start = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stretch
        stop = np.minimum(start + stretch, (begin + sizes)[text])
        at = np.maximum(begin[text], start - self.memory)
        by = np.argsort(at - stop, kind="stable")  # longest first, so that readers still at work are the first ones
        start, stop, at = start[by], stop[by], at[by]
        state, work = np.where((at == begin[text][by]) & (self.memory > 0), 1, 0), np.sort(at - stop)
        for step in range(int(-work[0]) if len(work) else 0):
            live = int(np.searchsorted(work, -step, "left"))
            pos = at[:live] + step
            word, now, cost = self.at[pos], state[:live].copy(), np.zeros(live)
            found = np.searchsorted(self.arc, now * self.width + word)
            lost = np.flatnonzero(self.arc[np.minimum(found, len(self.arc) - 1)] != now * self.width + word)
            while len(lost):  # failure arcs; state 0 has an arc for every word
                cost[lost] += self.penalty[now[lost]]
                now[lost] = self.fail[now[lost]]
                key = now[lost] * self.width + word[lost]
                found[lost] = np.searchsorted(self.arc, key)
                lost = lost[self.arc[np.minimum(found[lost], len(self.arc) - 1)] != key]
            counts = pos >= start[:live]
            out[pos[counts]] = (cost + self.weight[found])[counts]
            state[:live] = self.to[found]
        return out


def score_documents(
    docs: DataFrame,
    order: int = 3,
    mu: float = 4.0,
    block_chars: int = 6_000_000,
    max_keys: int = 4_000_000,
    fan_bits: int = 8,
    held_out_of: tuple[int, int] = (7, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``block_chars`` bounds a block (it may be exceeded by one text), ``max_keys`` the n-grams that meet in one group.
    """
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    read = docs.select(F.col(id_col).cast("string").alias("id"), (F.crc32(ids) % held_out_of[0] == held_out_of[1]).alias("held"), F.col(text_col).cast("string").alias("text"))

    def to_blocks(batches):
        part, made, held, found, chars = TaskContext.get().partitionId(), 0, [], [], 0
        meta: list = []

        def done():
            tokens = np.concatenate([f[0] for f in found])
            sizes = np.concatenate([f[1] for f in found])
            vocab, place = np.unique(tokens, return_inverse=True)
            return pd.DataFrame([(part << 24 | made, meta, held, sizes.tolist(), pack_keys(vocab), pack(place.astype(np.uint32)))], columns=["block", "ids", "held", "sizes", "vocab", "tokens"])

        for pdf in batches:
            texts, group = pdf["text"].tolist(), []
            id_list, held_list = [None if pd.isna(i) else i for i in pdf["id"]], pdf["held"].tolist()
            for i, t in enumerate(texts):
                group.append(t)
                chars += len(t or "") + 1
                meta.append(id_list[i])
                held.append(held_list[i])
                if chars >= block_chars or len(group) >= 2000 or i == len(texts) - 1:
                    found.append(tokens_of(group))
                    group = []
                if chars >= block_chars:
                    yield done()
                    made, held, found, chars, meta = made + 1, [], [], 0, []
        if found:
            yield done()

    blocks = stage(read.mapInPandas(to_blocks, "block long, ids array<string>, held array<boolean>, sizes array<int>, vocab binary, tokens binary"), "lm-blocks")
    per = blocks.select("block", F.explode(F.arrays_zip("held", "sizes")).alias("d"))
    train = F.when(~F.col("d.held"), F.col("d.sizes"))
    n_blocks, n_all, n, n_train = (int(x or 0) for x in per.agg(F.count_distinct("block"), F.sum("d.sizes"), F.sum(train), F.count(train)).first())
    bits = min(fan_bits, max(0, (-(-n_all // max_keys) - 1).bit_length()))

    def unfold(sizes, vocab, tokens):
        sizes = np.asarray(sizes, np.int64)
        return sizes, levels_of(unpack_keys(vocab), unpack(tokens, np.uint32).astype(np.int64), sizes, order)

    def ask(batches):
        for pdf in batches:
            for block, held, sizes, vocab, tokens in zip(pdf["block"], pdf["held"], pdf["sizes"], pdf["vocab"], pdf["tokens"]):
                sizes, levels = unfold(sizes, vocab, tokens)
                learned = np.repeat(~np.asarray(held, bool), sizes)
                for length, level in enumerate(levels, 1):
                    mine = level.at[learned]
                    yield cut(level.keys, np.bincount(mine[mine >= 0], minlength=len(level.keys)).astype(np.uint64), length, bits, int(block), int(block))

    answers = stage(exchange(blocks.mapInPandas(ask, LISTS), n_all, bits, max_keys, fan_bits), "lm-answers")

    def words(batches):
        """How many distinct training words the ranges of a batch hold."""
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(int(unpack(t, np.uint64)[0]) for t in pdf["totals"])]})

    v = int(answers.filter("parent < 0").select("totals").mapInPandas(words, "n long").agg(F.sum("n")).first()[0] or 0)

    def traverse(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        sizes, levels = unfold(row["sizes"], row["vocab"], row["tokens"])
        answers = answers.sort_values("range")
        length = answers["range"].to_numpy() >> 48
        totals = [np.concatenate([unpack(t, np.uint64) for t in answers["totals"][length == k]] or [np.empty(0, np.uint64)]).astype(np.float64) for k in range(1, order + 1)]
        begin = np.cumsum(sizes) - sizes
        automaton = Automaton(levels, totals, begin, n, v, n_train, mu)
        seen = totals[0][levels[0].at]
        total = lambda x: np.add.reduceat(x, begin)
        return pd.DataFrame({
            "id": row["ids"], "held_out": np.asarray(row["held"], bool), "n_tokens": sizes, "n_known": total((seen > 0).astype(np.int64)),
            "base_score": total(np.log10((seen + 1) / (n + v + 1))), "score": total(automaton.walk(sizes)),
        })

    sides = blocks.repartition(partitions(n_blocks), "block"), answers.filter("parent >= 0").withColumnRenamed("sender", "block").repartition(partitions(n_blocks), "block")
    scored = sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInPandas(traverse, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
