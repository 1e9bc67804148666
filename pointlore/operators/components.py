"""Connected components by contraction, and exact squared distances by lower envelopes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written


def connected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Each node's root, the least node of its component, and the number of rounds. ``nodes``: keys, id; ``edges``: keys, a, b.

    In a round every node turns to its least neighbour, if that is less than itself; pointers double until all point to roots; roots
    stand for their trees, and edges inside a tree and repeated ones go. A node that stays has a larger neighbour that goes with it, so
    the nodes with edges are at least halved: rounds grow with the logarithm of the largest component. No neighbourhood is gathered.
    """
    roots = written(nodes.select(*keys, "id", F.col("id").alias("root")), "roots")
    ends = lambda df: df.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, rounds = written(ends(edges), "edges"), 0
    while not left.isEmpty():
        rounds += 1
        both = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("_b")).select(*keys, "id", F.least("id", "_b").alias("to"))
        to = written(to, "pointers")
        while True:
            far = to.select(*keys, F.col("id").alias("to"), F.col("to").alias("far"))
            doubled = written(to.join(far, [*keys, "to"]).select(*keys, "id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "pointers")
            to = doubled.drop("moved")
            if doubled.filter("moved").isEmpty():
                break
        as_end = lambda c: to.select(*keys, F.col("id").alias(c), F.col("to").alias(f"_{c}"))  # noqa: E731, B023
        left = written(ends(left.join(as_end("a"), [*keys, "a"]).join(as_end("b"), [*keys, "b"]).select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b"))), "edges")
        new = to.select(*keys, F.col("id").alias("root"), "to")
        roots = written(roots.join(new, [*keys, "root"], "left").select(*keys, "id", F.coalesce("to", "root").alias("root")), "roots")
    return roots, rounds


def lower_envelope(pos: np.ndarray, height: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The least of ``height + (at - pos)**2`` over the parabolas, at each place asked; ``pos`` ascends."""
    on, start = [], []  # parabolas of the envelope and where each begins to be the least
    lifted = height + pos * pos
    for k in range(len(pos)):
        begin = -np.inf
        while on:
            begin = (lifted[k] - lifted[on[-1]]) / (2.0 * (pos[k] - pos[on[-1]]))
            if begin > start[-1]:
                break
            on.pop()
            start.pop()
            begin = -np.inf
        on.append(k)
        start.append(begin)
    best = np.array(on)[np.searchsorted(np.array(start), asked, "right") - 1]
    return height[best] + (asked - pos[best]) ** 2


def _envelope_lines(batches):
    """Batches sorted by (line, asked, pos): the height at each asked place of a line; lines without values give none."""
    schema = pa.schema([("line", pa.string()), ("pos", pa.int64()), ("height", pa.float64())])

    def solve(t: pa.Table):
        line, pos, asked, height = t.column("line").to_numpy(), t.column("pos").to_numpy(), t.column("asked").to_numpy(), t.column("height").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        lines, at, out = [], [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(line))):
            k = a + int(np.searchsorted(asked[a:b], 1))
            if a < k < b:
                lines += [line[a]] * (b - k)
                at.append(pos[k:b])
                out.append(lower_envelope(pos[a:k].astype(float), height[a:k], pos[k:b].astype(float)))
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(np.concatenate(at) if at else [], pa.int64()), pa.array(np.concatenate(out) if out else [], pa.float64())], schema=schema)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        line = t.column("line").to_numpy()
        cut = int(np.argmax(line == line[-1]))
        if cut:
            yield solve(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut)
    if rest is not None:
        yield solve(rest.combine_chunks())


def envelope_pass(values: DataFrame, asked: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """One axis of a distance transform: keys, the axis, height at each distinct place asked. ``values``: keys, axis, height; ``asked``: keys, axis."""
    line = F.to_json(F.struct(*keys)).alias("line")
    told = values.groupBy(*keys, axis).agg(F.min("height").alias("height")).select(line, F.lit(0).alias("asked"), F.col(axis).cast("long").alias("pos"), F.col("height").cast("double").alias("height"))
    wanted = asked.select(*keys, axis).distinct()
    rows = told.unionByName(wanted.select(line, F.lit(1).alias("asked"), F.col(axis).cast("long").alias("pos"), F.lit(0.0).alias("height")))
    got = rows.repartition("line").sortWithinPartitions("line", "asked", "pos").mapInArrow(_envelope_lines, "line string, pos long, height double")
    return wanted.select("*", line, F.col(axis).cast("long").alias("pos")).join(got, ["line", "pos"]).drop("line", "pos")


def squared_distances(voxels: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, z, d2: from each place asked to the nearest voxel of its keys, axis by axis.

    The first pass looks along z in every column of voxels, for the heights asked in that image; the second along y, for the (y, z)
    asked; the third along x. A pass hands on one number per line and place, whatever the number of voxels behind it.
    """
    places = written(asked.select(*keys, "x", "y", "z").distinct(), "asked")
    base = voxels.select(*keys, "x", "y", "z").distinct().withColumn("height", F.lit(0.0))
    columns = base.select(*keys, "x", "y").distinct()
    first = envelope_pass(base, columns.join(places.select(*keys, "z").distinct(), keys), [*keys, "x", "y"], "z")
    second_at = first.select(*keys, "x", "z").distinct().join(places.select(*keys, "y", "z").distinct(), [*keys, "z"])
    second = envelope_pass(written(first, "pass"), second_at, [*keys, "x", "z"], "y")
    third = envelope_pass(written(second, "pass"), places, [*keys, "y", "z"], "x")
    return third.select(*keys, "x", "y", "z", F.col("height").alias("d2"))
