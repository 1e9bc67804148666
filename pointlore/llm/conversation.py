"""Damaged conversations: faults, the cheapest repair of each conversation, and its audit.

Rows of a conversation are taken by turn (a null turn first), rows of one turn by role, then by the MD5 of their text. The first
fault of a row counts: blank (only ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (the last
other character is none of ``.!?``). Edits: K keeps a row (0), R gives it the role user or assistant (1), D deletes it (2, a must for
blank and duplicate rows), I puts an empty-text row of user or assistant anywhere (5); a truncated row that stays costs 5 more. The
roles that are left must read ``(s?(ua)+)?`` by their initials. Of the cheapest repairs the one with the ASCII-least audit counts.

What has been read so far matters in four ways only (nothing, system, user, assistant), so a row is a table of costs between four
states. Rows lie in blocks of ``block_rows``. A block's table is the (min, +) product of its rows' tables; ``sweep`` carries the cost of
what follows to every block over groups of blocks, groups of groups and so on. Inside a block a cost programme from its end leaves the
optimal arcs. Nodes are then ranked by their least audits of 1, 2, 4, ... edits: a rank is a pair of ranks, its own and that of the node
that many edits on. The ranks choose each node's arc, and doubled pointers read off the paths. A block answers for each of the four
states it may be entered in; a second sweep composes these answers and tells the state. So a conversation may fill any number of tasks.

A null id is a conversation of its own; null roles and texts read as one space. Empty tables give empty results; extra columns are
ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC32_TABLE_SQL, crc32_sql, numbered, stage, table, with_groups

BLANK = " \t\n\x0b\x0c\r"
NONE, BLANK_ROW, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = np.int64(1) << 50  # no way
END = np.array([0, 10, 5, 0], np.int64)  # cost of ending in each state: after a user, or a system, row others have to be put in
NEXT_ROLE = np.array([USER, USER, ASSISTANT, USER])
LETTERS = np.frombuffer(b"DIKR", np.uint8)  # ascending
ROLES = np.array(["", "system", "user", "assistant"])


# --- costs and paths inside blocks ---------------------------------------------------------------------


def _step(after: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Costs to go before a row from those after it, by state: (edit, row, state), edits as in LETTERS; I only from what the others give."""
    stays = np.where(fault == TRUNCATED, 5, 0).astype(np.int64)[:, None]
    must = ((fault == BLANK_ROW) | (fault == DUPLICATE))[:, None]
    keep = np.full_like(after, FAR)
    for state in range(4):
        allowed = (initial == "u") if state != USER else (initial == "a")
        keep[:, state] = np.where(allowed, after[:, NEXT_ROLE[state]], FAR)
    keep[:, START] = np.where(initial == "s", after[:, SYSTEM], keep[:, START])
    keep = np.where(must, FAR, keep + stays)
    rerole = np.where(must, FAR, after[:, NEXT_ROLE] + 1 + stays)
    delete = after + 2
    best = np.minimum(np.minimum(keep, rerole), delete)
    # One row put in; two only to come from nothing, or from a system row, to an assistant's.
    put = best.copy()
    put[:, USER] = np.minimum(best[:, USER], best[:, ASSISTANT] + 5)
    put[:, ASSISTANT] = np.minimum(best[:, ASSISTANT], best[:, USER] + 5)
    insert = put[:, NEXT_ROLE] + 5
    return np.minimum(np.stack([delete, insert, keep, rerole]), FAR)


def block_table(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(block, state before, state after): the cheapest edits of each block's rows; nothing is put in after its last row."""
    out = np.empty((len(starts), 4, 4), np.int64)
    for end in range(4):
        cost = np.full((len(starts), 4), FAR)
        cost[:, end] = 0
        out[:, :, end] = _costs(initial, fault, starts, lengths, cost)[0]
    return out


def _costs(initial, fault, starts, lengths, at_end):
    """Costs to go before each block's first row, and by layer (rows before it, block after block, and the end) those by edit."""
    layers = np.cumsum(lengths + 1) - (lengths + 1)
    edits = np.full((4, int((lengths + 1).sum()), 4), FAR)
    togo = np.empty((edits.shape[1], 4), np.int64)
    togo[layers + lengths] = at_end
    order = np.argsort(-lengths, kind="stable")
    ascending = np.sort(lengths)
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        on = order[: len(lengths) - np.searchsorted(ascending, t, "right")]
        here, row = layers[on] + t, starts[on] + t
        found = _step(togo[here + 1], initial[row], fault[row])
        edits[:, here] = found
        togo[here] = found.min(0)
    return togo[layers], togo, edits, layers


def least_audits(initial, fault, starts, lengths, at_end, last):
    """For each block and state it is entered in: cost, audit, state after each edit, state at the end.

    ``at_end``: (block, state) costs of what follows; ``last``: whether a block is its conversation's last.
    """
    first, togo, edits, layers = _costs(initial, fault, starts, lengths, at_end)
    n = len(togo)
    ends = layers + lengths
    # Arcs by (edit, node): where they lead. A node is 4 * layer + state.
    layer, state = np.divmod(np.arange(4 * n), 4)
    row_of = np.minimum(np.repeat(starts, lengths + 1) + np.arange(n) - np.repeat(layers, lengths + 1), max(len(initial) - 1, 0))
    kept = np.where(initial[row_of] == "s", SYSTEM, np.where(initial[row_of] == "u", USER, ASSISTANT))[layer]
    to = np.stack([4 * (layer + 1) + state, 4 * layer + NEXT_ROLE[state], 4 * (layer + 1) + kept, 4 * (layer + 1) + NEXT_ROLE[state]])
    cost = edits.reshape(4, -1)
    optimal = (cost == togo.reshape(-1)) & (cost < FAR)
    # After the last row of a conversation what is missing is put in.
    closing = np.zeros(n, bool)
    closing[ends[last]] = True
    tail = closing[layer] & ((state == SYSTEM) | (state == USER))
    at_border = np.zeros(n, bool)
    at_border[ends] = True
    optimal[:, at_border[layer]] = False
    optimal[1, tail] = True
    to = np.where(optimal, to, np.arange(4 * n))

    # Ranks by least audits of 1, 2, 4, ... edits.
    order = np.where(optimal, np.arange(4)[:, None], 9)
    pick = order.argmin(0)
    jump = np.take_along_axis(to, pick[None], 0)[0]
    rank, steps = np.where(optimal.any(0), pick + 1, 0), optimal.any(0).astype(np.int64)
    jumps = [jump]
    while (steps[jump] > 0).any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        steps = steps + steps[jump]
        jump = jump[jump]
        jumps.append(jump)
    pick = np.where(optimal, order * (rank.max(initial=0) + 1) + rank[to], np.iinfo(np.int64).max).argmin(0)
    nxt = np.take_along_axis(to, pick[None], 0)[0]

    # Paths from all four states of each block's first layer.
    entry = (4 * layers[:, None] + np.arange(4)).ravel()
    size = steps[entry]
    far = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    node = np.repeat(entry, size)
    for k, j in enumerate(jumps):
        on = (far >> k) & 1 == 1
        node[on] = j[node[on]]
    audit, then = LETTERS[pick[node]], nxt[node] % 4
    end_state = entry.copy()
    for k, j in enumerate(jumps):
        on = (size >> k) & 1 == 1
        end_state[on] = j[end_state[on]]
    cuts = np.cumsum(size) - size
    return first.ravel(), audit, then.astype(np.uint8), cuts, size, end_state % 4


# --- groups of blocks ------------------------------------------------------------------------------------


def sweep(items: DataFrame, fold, spread, top: list[int], fan: int = 1024) -> DataFrame:
    """What reaches each item of a sequence from the sequence's end or start, over groups of ``fan`` items, groups of groups and so on.

    ``items``: conv, pos, m (array<long>). ``fold`` makes one m of a list of them in order; ``spread`` gives each of them its share of
    what reaches them all; ``top`` reaches a whole sequence. Returns conv, pos, got.
    """
    items = stage(items.withColumn("up", F.floor(F.col("pos") / fan)), "sweep-items")
    if items.filter("up > 0").isEmpty():
        above = items.select("conv", "up", F.array(*[F.lit(int(x)).cast("long") for x in top]).alias("got")).distinct()
    else:
        up = items.groupBy("conv", "up").applyInPandas(lambda pdf: pd.DataFrame({"conv": pdf["conv"].iloc[:1], "pos": pdf["up"].iloc[:1], "m": [list(fold(list(pdf.sort_values("pos")["m"])))]}), "conv string, pos long, m array<long>")
        above = sweep(up, fold, spread, top, fan).withColumnRenamed("pos", "up")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        return pd.DataFrame({"conv": pdf["conv"], "pos": pdf["pos"], "got": [list(x) for x in spread(list(pdf["m"]), pdf["got"].iloc[0])]})

    return items.join(above, ["conv", "up"]).groupBy("conv", "up").applyInPandas(share, "conv string, pos long, got array<long>")


def _times(a, b):
    return np.minimum((np.asarray(a).reshape(4, 4)[:, :, None] + np.asarray(b).reshape(4, 4)[None]).min(1), FAR)


def _fold_costs(tables):
    out = np.asarray(tables[0]).reshape(4, 4)
    for t in tables[1:]:
        out = _times(out, t)
    return out.ravel()


def _spread_costs(tables, end):
    """The cost of what follows each block: nothing is put in before its first row here, that is the next block's."""
    out, cost = [], np.asarray(end)
    for t in reversed(tables):
        out.append(cost)
        cost = np.minimum((np.asarray(t).reshape(4, 4) + cost[None]).min(1), FAR)
    return out[::-1]


def _fold_states(maps):
    out = np.arange(4)
    for m in maps:
        out = np.asarray(m)[out]
    return out


def _spread_states(maps, entry):
    out, state = [], int(entry[0])
    for m in maps:
        out.append([state])
        state = int(m[state])
    return out


# --- blocks in Arrow batches --------------------------------------------------------------------------


def _blocks(batches, each, schema):
    """``each`` over whole blocks: batches are sorted by (conv, block, pos), a block may go on in the next batch."""

    def run(t: pa.Table):
        t = t.combine_chunks()
        conv, block = t.column("conv").to_numpy(), t.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))))
        rows = each(t, starts, np.diff(np.append(starts, len(conv))))
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        conv, block = t.column("conv"), t.column("block")
        same = (conv.to_numpy() == conv[-1].as_py()) & (block.to_numpy() == block[-1].as_py())
        cut = int(np.argmax(same))
        if cut:
            yield run(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None:
        yield run(rest)


def _facts(t):
    return t.column("initial").to_numpy().astype("U1"), t.column("fault").to_numpy()


def _table_rows(batches):
    schema = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("m", pa.list_(pa.int64()))])

    def each(t, starts, lengths):
        tables = block_table(*_facts(t), starts, lengths)
        return {"conv": t.column("conv").to_numpy()[starts], "pos": t.column("block").to_numpy()[starts], "m": list(tables.reshape(len(starts), 16))}

    yield from _blocks(batches, each, schema)


def _audit_rows(batches):
    """One row per block: cost, audits, states and ends by the state the block is entered in, and its adjacent pairs of wrong roles."""
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("states", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("illegal", pa.int64())])

    def each(t, starts, lengths):
        initial, fault = _facts(t)
        end = np.stack([t.column(f"end{s}").to_numpy()[starts] for s in range(4)], 1)
        last = t.column("last").to_numpy(zero_copy_only=False)[starts].astype(bool)
        cost, audit, then, cuts, size, ends = least_audits(initial, fault, starts, lengths, end, last)
        letters, states = audit.tobytes().decode(), then.tobytes()
        of = [[4 * b + s for s in range(4)] for b in range(len(starts))]
        before, here = initial[:-1], initial[1:]
        legal = (before == "s") & (here == "u") | (before == "u") & (here == "a") | (before == "a") & (here == "u")
        wrong = np.concatenate(([0], ~legal)).astype(np.int64)
        wrong[starts] = 0
        return {
            "conv": t.column("conv").to_numpy()[starts], "block": t.column("block").to_numpy()[starts], "cost": [[int(cost[e]) for e in x] for x in of],
            "audit": [[letters[cuts[e] : cuts[e] + size[e]] for e in x] for x in of], "states": [[states[cuts[e] : cuts[e] + size[e]] for e in x] for x in of],
            "ends": [[int(ends[e]) for e in x] for x in of], "illegal": np.add.reduceat(wrong, starts),
        }

    yield from _blocks(batches, each, schema)


def _edit_rows(batches):
    """The rows that the audits leave: step, row of the block, whether it is a new one, and role (null where it is kept)."""
    schema = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("step", pa.int64()), ("row", pa.int64()), ("fresh", pa.bool_()), ("role", pa.string())])
    for batch in batches:
        audits = batch.column("audit").to_pylist()
        edits = np.frombuffer("".join(audits).encode(), np.uint8)
        states = np.frombuffer(b"".join(batch.column("states").to_pylist()), np.uint8)
        size = np.array([len(a) for a in audits], np.int64)
        start = np.repeat(np.cumsum(size) - size, size)
        eaten = np.cumsum(edits != ord("I"))
        before = np.concatenate(([0], eaten))[start]
        on = np.flatnonzero(edits != ord("D"))
        of = pa.array(np.repeat(np.arange(len(size)), size)[on])
        role = pa.array(ROLES[states[on]], pa.string(), mask=edits[on] == ord("K"))
        cols = [batch.column("conv").take(of), batch.column("block").take(of), pa.array((np.arange(len(edits)) - start)[on]), pa.array((eaten - before - 1)[on]), pa.array(edits[on] == ord("I")), role]
        yield pa.RecordBatch.from_arrays(cols, schema=schema)


# --- the operator --------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text damaged by the checksum of their conversation and turn."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    df = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_kind")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def repair(rows: DataFrame, block_rows: int = 1024, fan: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``rows``: conv (not null), turn, role, text. Facts by conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit;
    and the repaired rows: conv, block, step (their order), role, text."""
    rows = rows.select("conv", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    text = F.col("text")
    said = F.right(F.rtrim(text, F.lit(BLANK)), F.lit(1))
    slim = rows.select("conv", "turn", "role", F.md5(text.cast("binary")).alias("mark"), F.left("role", F.lit(1)).alias("initial"), (said == "").alias("_blank"), (~said.isin(".", "!", "?")).alias("_cut"))
    placed = stage(numbered(slim, ["conv"], [F.col("turn").asc_nulls_first(), "role", "mark"], "talk-rows"), "talk-placed")
    same = placed.groupBy("conv", "role", "mark").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_same")).filter("_same > 1")
    seen = with_groups(placed, same, ["conv", "role", "mark"], "_same", placed.count())
    fault = F.when(F.col("_blank"), BLANK_ROW).when(F.col("pos") > F.col("_first"), DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(NONE)
    facts = stage(seen.select("conv", "pos", "n", "turn", "role", "mark", "initial", fault.alias("fault"), F.floor(F.col("pos") / block_rows).alias("block")), "talk-facts")

    def sorted_blocks(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")

    many = facts.filter(F.col("n") > block_rows)
    long_ones = not many.isEmpty()
    no_more = F.col("block") == F.floor((F.col("n") - 1) / block_rows)
    asked = facts.select("conv", "block", "pos", "initial", "fault", no_more.alias("last"))
    ends = [F.lit(int(e)).cast("long").alias(f"end{s}") for s, e in enumerate(END)]
    asked_of = asked.join(many.select("conv").distinct(), "conv", "left_anti").select("*", *ends) if long_ones else asked.select("*", *ends)
    if long_ones:
        tables = sorted_blocks(many.select("conv", "block", "pos", "initial", "fault")).mapInArrow(_table_rows, "conv string, pos long, m array<long>")
        follow = stage(sweep(tables, _fold_costs, _spread_costs, list(END), fan).withColumnRenamed("pos", "block"), "talk-follow")
        told = many.select("conv", "block", "pos", "initial", "fault", no_more.alias("last")).join(follow, ["conv", "block"])
        asked_of = asked_of.unionByName(told.select("conv", "block", "pos", "initial", "fault", "last", *[F.col("got")[s].alias(f"end{s}") for s in range(4)]))
    shape = "conv string, block long, cost array<long>, audit array<string>, states array<binary>, ends array<long>, illegal long"
    answers = stage(sorted_blocks(asked_of).mapInArrow(_audit_rows, shape), "talk-answers")
    chosen = answers.withColumn("_in", F.lit(START))
    if long_ones:
        maps = answers.join(many.select("conv").distinct(), "conv", "left_semi").select("conv", F.col("block").alias("pos"), F.col("ends").alias("m"))
        entered = sweep(maps, _fold_states, _spread_states, [START], fan).select("conv", F.col("pos").alias("block"), F.col("got")[0].cast("int").alias("_state"))
        chosen = answers.join(entered, ["conv", "block"], "left").withColumn("_in", F.coalesce("_state", F.lit(START)))
    pick = lambda c: F.col(c)[F.col("_in")].alias(c)
    chosen = stage(chosen.select("conv", "block", pick("cost"), pick("audit"), pick("states"), "illegal"), "talk-chosen")

    left = chosen.select("conv", "block", "audit", "states").mapInArrow(_edit_rows, "conv string, block long, step long, row long, fresh boolean, role string")
    left = left.withColumn("pos", F.when(~F.col("fresh"), F.col("block") * block_rows + F.col("row")))
    # A row that stays is the only one of its role and text that does.
    texts = rows.select("conv", F.col("role").alias("said_by"), F.md5(text.cast("binary")).alias("mark"), "text").dropDuplicates(["conv", "said_by", "mark"])
    own = facts.select("conv", "pos", F.col("role").alias("said_by"), "mark")
    told = left.filter("pos is not null").join(own, ["conv", "pos"]).join(texts, ["conv", "said_by", "mark"]).select("conv", "block", "step", F.coalesce("role", "said_by").alias("role"), "text")
    repaired = told.unionByName(left.filter("pos is null").select("conv", "block", "step", "role", F.lit("").alias("text")))

    border = facts.filter(F.col("pos") % block_rows == block_rows - 1).select("conv", (F.col("pos") + 1).alias("pos"), F.col("initial").alias("_before"))
    pair = F.concat("_before", "initial")
    across = facts.filter((F.col("pos") % block_rows == 0) & (F.col("pos") > 0)).join(border, ["conv", "pos"]).filter(~pair.isin("su", "ua", "au")).groupBy("conv").agg(F.count(F.lit(1)).alias("_across"))
    count = lambda k, name: F.count(F.when(F.col("fault") == k, 1)).alias(name)
    per_turn = facts.groupBy("conv", "turn").agg(count(BLANK_ROW, "blank"), count(DUPLICATE, "duplicate"), count(TRUNCATED, "truncated"))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = per_turn.groupBy("conv").agg(span, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    edits = chosen.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"), audit.alias("audit"))
    out = counts.join(edits, "conv").join(across, "conv", "left").withColumn("illegal", F.col("illegal") + F.coalesce("_across", F.lit(0)))
    return out.drop("_across"), repaired


def _hash_stream(batches):
    """SHA-256 of each conversation's lines, joined by newlines: batches come sorted by (conv, block), one row per block."""
    at, h = None, None
    for batch in batches:
        out = []
        for conv, text in zip(batch.column("conv").to_pylist(), batch.column("text")):
            if conv != at:
                if h:
                    out.append((at, h.hexdigest()))
                at, h = conv, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(text.as_py().encode())
        if out:
            yield pa.RecordBatch.from_pydict({"conv": [o[0] for o in out], "sha": [o[1] for o in out]})
    if h:
        yield pa.RecordBatch.from_pydict({"conv": [at], "sha": [h.hexdigest()]})


def hash_repaired(repaired: DataFrame) -> DataFrame:
    """conv, sha: digest of the lines ``role:text``. A hash takes its input in order, so a conversation's blocks stream through one task."""
    line = F.struct("step", F.concat("role", F.lit(":"), "text").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    blocks = repaired.groupBy("conv", "block").agg(text.alias("text"))
    return blocks.repartition("conv").sortWithinPartitions("conv", "block").select("conv", "text").mapInArrow(_hash_stream, "conv string, sha string")


def op13_conversation(spark, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    # "c" before an id keeps it apart from none.
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    broken = damage(said).select(conv.alias("conv"), "turn", "role", "text")
    facts, repaired = repair(broken)
    every = said.select("conv_id", conv.alias("conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(facts, "conv", "left").join(hash_repaired(repaired), "conv", "left")
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op13_sql() -> str:
    """The cheapest repair row by row: by state, the least of (cost in seven digits, audit) so far."""
    put = lambda v, cost, letters: f"lpad(CAST(CAST(left({v}, 7) AS BIGINT) + {cost} AS VARCHAR), 7, '0') || substr({v}, 8) || '{letters}'"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    stay = "CASE WHEN fault IN (1, 2) THEN NULL ELSE {} END"
    cut = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    from_u = stay.format(f"least(CASE WHEN k = 'u' THEN {put('wu', cut, 'K')} END, {put('wu', f'1 + {cut}', 'R')})")
    from_a = stay.format(f"least(CASE WHEN k = 'a' THEN {put('w2', cut, 'K')} END, {put('w2', f'1 + {cut}', 'R')})")
    from_s = stay.format(f"CASE WHEN k = 's' THEN {put('w0', cut, 'K')} END")
    closed = f"least(v0, v3, {put('v2', 5, 'I')}, {put('v1', 10, 'II')})"
    return f"""WITH RECURSIVE {CRC32_TABLE_SQL},
h AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS kind FROM conversations, crc_table),
b AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS k, right(rtrim(text, {blank}), 1) AS e FROM b),
f AS MATERIALIZED (SELECT *, CASE WHEN e = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2 WHEN e NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  coalesce(lag(k) OVER (PARTITION BY conv ORDER BY i) || k NOT IN ('su', 'ua', 'au'), false) AS wrong FROM p),
g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal, count(*) AS n FROM f GROUP BY conv),
dp AS (SELECT conv, n, 0::BIGINT AS i, '0000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM g
  UNION ALL
  SELECT conv, n, i, {put('w0', 2, 'D')}, least({put('v1', 2, 'D')}, {from_s}), least({put('w2', 2, 'D')}, {from_u}), least({put('w3', 2, 'D')}, {from_a})
  FROM (SELECT *, least(w0, v1, w3) AS wu FROM (SELECT dp.conv, n, f.i, k, fault, v0 AS w0, v1, least(v2, {put('v0', 5, 'I')}, {put('v1', 5, 'I')}, {put('v3', 5, 'I')}) AS w2,
    least(v3, {put('v2', 5, 'I')}, {put('v0', 10, 'II')}, {put('v1', 10, 'II')}) AS w3
    FROM dp JOIN f ON f.conv IS NOT DISTINCT FROM dp.conv AND f.i = dp.i + 1))),
best AS (SELECT conv, {closed} AS v FROM dp WHERE i = n), a AS (SELECT conv, CAST(left(v, 7) AS BIGINT) AS cost, substr(v, 8) AS audit FROM best),
s AS (SELECT conv, j, audit[j] AS edit FROM a, unnest(range(1, length(audit) + 1)) t(j)),
r AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM s WINDOW w AS (PARTITION BY conv ORDER BY j)),
q AS (SELECT r.*, f.role, f.text, f.k FROM r LEFT JOIN f ON f.conv IS NOT DISTINCT FROM r.conv AND f.i = r.i AND r.edit <> 'I' WHERE edit <> 'D'),
z AS (SELECT *, (o - max(CASE WHEN o = 1 AND edit = 'K' AND k = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv)) % 2 AS odd FROM q),
t AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM z GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv IS NOT DISTINCT FROM c.conv_id
"""


OP13_SQL = _op13_sql()
