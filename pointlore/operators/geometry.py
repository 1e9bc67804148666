"""Distances, surfaces, grids and components of point sets (C), as joins and column expressions."""

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.storage import written
from .components import connected, squared_distances
from .expressions import expand_box, round_out
from .surfaces import classify_points, grid_sizes, inside_grid, nearest, numbered_rows, of_surface, scaled_surface_distance, surface_distance  # noqa: F401

GROUP = ["mode", "cell_id", "seed"]
XYZ = ("x", "y", "z")


def distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in XYZ), F.lit(0.0)))


def pairwise_distances(points: DataFrame, keys: list[str] = GROUP, block: int = 1000) -> DataFrame:
    """All n(n-1)/2 distances inside each group.

    A group's points lie in blocks of about ``block``, and every two blocks meet once, so no task has the pairs of a whole group. A
    point's copies, one for each block that its own meets, are shuffled and never broadcast.
    """
    blocks = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks"))
    placed = points.join(blocks, keys).withColumn("_p", F.pmod(F.xxhash64("point_id"), F.col("_blocks")).cast("int"))
    # A pair of blocks is named by both; a has the points of the lesser one. The name is one text: keys may be constants, which a join
    # forgets. Tasks are given: copies are so few beside the pairs that they would be put into one or two.
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism)
    met = F.to_json(F.struct(*keys, "_lo", "_hi")).alias("_met")
    a = placed.withColumn("_lo", F.col("_p")).withColumn("_hi", F.explode(F.sequence(F.col("_p"), F.col("_blocks") - 1))).select("*", met).repartition(tasks, "_met").alias("a")
    b = placed.withColumn("_hi", F.col("_p")).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_p")))).select("point_id", *XYZ, met).repartition(tasks, "_met").hint("merge").alias("b")
    met = a.join(b, [F.col("a._met") == F.col("b._met"), (F.col("a._lo") < F.col("a._hi")) | (F.col("a.point_id") < F.col("b.point_id"))])
    ends = [f("a.point_id", "b.point_id").alias(f"point_{k}") for k, f in ((1, F.least), (2, F.greatest))]
    return met.select(*[F.col(f"a.{k}") for k in keys], *ends, distance().alias("value"))


def _cells(c: str, w: float) -> Column:
    return F.floor(F.col(c) / w).cast("long")


def nearest_neighbour(points: DataFrame, cell_width: float | None = None, keys: list[str] = GROUP) -> DataFrame:
    """Distance to the nearest other point (0 for duplicates); single points give no row.

    With ``cell_width`` w, points meet in the 27 neighbouring buckets of a grid; a best distance of at most w is then final, and
    only the other points are compared with their whole group.
    """
    cols = [*keys, "point_id"]

    def best(asked: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        a, b = asked.alias("a"), other.alias("b")
        joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [F.col("a.point_id") != F.col("b.point_id")])
        return joined.groupBy(*[F.col(f"a.{k}").alias(k) for k in cols]).agg(F.min(distance()).alias("value"))

    if cell_width is None:
        return best(points, points, keys)
    cell = [f"_{c}" for c in XYZ]
    placed = points.select("*", *[_cells(c, cell_width).alias(f"_{c}") for c in XYZ])
    offsets = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    spread = placed
    for c in cell:
        spread = spread.withColumn("_o", F.explode(offsets)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    near = best(placed, spread, [*keys, *cell]).filter(F.col("value") <= cell_width)
    rest = points.join(near.select(*cols), cols, "left_anti")
    return near.unionByName(best(rest, points, keys))


def z_distances(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Height over the cell's bottom, and that over the cell's height (null for flat cells)."""
    j = points.join(cells.select("cell_id", F.col("mem_z_min").alias("_lo"), F.col("mem_z_max").alias("_hi")), "cell_id")
    up, span = F.abs(F.col("z") - F.col("_lo")), F.col("_hi") - F.col("_lo")
    return j.withColumn("z_distance", up).withColumn("scaled_z_distance", F.when(span > 1e-8, up / F.when(span > 1e-8, span))).drop("_lo", "_hi")


def grid_points(boxes: DataFrame, spacing: float) -> DataFrame:
    """Regular grid of each box; an axis runs from its least value by ``spacing`` to at most half a step beyond the greatest."""
    df = grid_sizes(boxes, spacing)
    for c in XYZ:
        df = df.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{c}")))).withColumn(c, F.col(f"{c}_min") + F.col(f"_{c}") * spacing)
    return df.drop("_x", "_y", "_z", "_nx", "_ny", "_nz", *[f"{c}_{e}" for c in XYZ for e in ("min", "max")])


def available_space(cells: DataFrame, triangles: DataFrame, spacing: float, scaled: bool = False) -> DataFrame:
    """Grid points inside the membrane with their distances to both surfaces and the bottom; long: measure, value.

    Only points inside are ever made. Heights are kept outside the nucleus only. ``cells``: cell_id, x_min .. z_max of the membrane.
    """
    ends = [round_out(F.col(f"{c}_{e}")).alias(f"{c}_{e}") for c in XYZ for e in ("min", "max")]
    mem, keys = of_surface(triangles, "mem"), ("cell_id",)
    rows = numbered_rows(inside_grid(cells.select("cell_id", *ends), mem, spacing))
    far = nearest(rows, mem, keys).select("_row", F.sqrt("_d2").alias("membrane")).filter("membrane > 0")
    named = rows.withColumnRenamed("_row", "_point")
    inner = surface_distance(named, triangles, keys, "nuc").select(F.col("_point").alias("_row"), "cell_id", *XYZ, F.col("distance").alias("nucleus"))
    facts = cells.select("cell_id", F.col("z_min").alias("mem_z_min"), F.col("z_max").alias("mem_z_max"))
    both = z_distances(inner.join(far, "_row"), facts)
    outside = F.col("nucleus") >= 0
    pairs = [("membrane", F.col("membrane")), ("nucleus", F.col("nucleus")), ("z", F.when(outside, F.col("z_distance"))), ("scaled_z", F.when(outside, F.col("scaled_z_distance")))]
    if scaled:
        ratio = scaled_surface_distance(named, triangles).select(F.col("_point").alias("_row"), "scaled_distance")
        both = both.join(ratio, "_row")
        pairs.append(("scaled_nucleus", F.col("scaled_distance")))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in pairs])).alias("p")
    return both.select("cell_id", *XYZ, long).select("p.measure", "cell_id", *XYZ, "p.value").filter("value is not null")


def median_slice(points: DataFrame, axis: str, spacing: float, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Points near the median of an axis."""
    mid = points.groupBy(*keys).agg(F.percentile(axis, F.lit(0.5)).alias("_m"))
    return points.join(mid, list(keys)).filter(F.abs(F.col(axis) - F.col("_m")) <= spacing / 2 + 1e-5 * F.abs(F.col("_m"))).drop("_m")


def cytoplasm_qc(distances: DataFrame, keys: list[str] = GROUP, limit: float = 0.1) -> DataFrame:
    """Shares of points in the nucleus and outside the membrane. ``distances``: keys, nucleus, membrane."""
    share = lambda c: F.avg(F.when(F.col(c) < 0, 1.0).otherwise(0.0))
    g = distances.groupBy(*keys).agg(share("nucleus").alias("in_nucleus"), share("membrane").alias("outside_membrane"))
    return g.withColumn("flagged", F.col("in_nucleus") + F.col("outside_membrane") > limit)


def distances(points: DataFrame, measures: list[str], cells: DataFrame | None = None, triangles: DataFrame | None = None, cell_width: float | None = None) -> DataFrame:
    """C11: the requested measures as long samples; branches that are not asked for are not built."""

    def long(df: DataFrame, measure: str, column: str) -> DataFrame:
        return df.select(F.lit(measure).alias("measure"), *GROUP, F.col(column).alias("value"))

    out = []
    for m in measures:
        if m == "pairwise":
            out.append(long(pairwise_distances(points), m, "value"))
        elif m == "nearest":
            out.append(long(nearest_neighbour(points, cell_width), m, "value"))
        elif m in ("z", "scaled_z"):
            out.append(long(z_distances(points, cells), m, "z_distance" if m == "z" else "scaled_z_distance").filter("value is not null"))
        elif m in ("nucleus", "membrane"):
            out.append(long(surface_distance(points, triangles, surface="nuc" if m == "nucleus" else "mem"), m, "distance"))
        elif m == "scaled_nucleus":
            out.append(long(scaled_surface_distance(points, triangles), m, "scaled_distance").filter("value is not null"))
        else:
            raise ValueError(f"unknown measure {m}")
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    return df


def pair_counts(points: DataFrame, scales: DataFrame, r_max: float, n: int, keys: list[str] = GROUP, splits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs of a group by the first of ``n`` grid points from 0 to ``r_max`` that their distance, over the group's scale, does not exceed.

    Points lie in buckets of ``r_max / splits``. Two buckets whose boxes are further apart than r_max count nothing; where the least and the
    greatest distance of their boxes fall on one grid point the product of their sizes counts, and the pairs of all other buckets are
    looked at. Returns keys, i, count; and those pairs, for plans and tests. ``scales``: keys, scale.
    """
    step = r_max / (n - 1)

    def first(v: Column) -> Column:
        i = F.ceil(v / step)
        return F.greatest(F.lit(0), F.when((i - 1) * step >= v, i - 1).when(i * step < v, i + 1).otherwise(i)).cast("int")

    b, other = [f"_b{c}" for c in XYZ], [f"_d{c}" for c in XYZ]
    placed = points.select(*keys, "point_id", *XYZ).join(scales.select(*keys, "scale"), keys)
    placed = placed.select("*", *[F.floor(F.col(c) / (F.col("scale") * (r_max / splits))).cast("long").alias(k) for c, k in zip(XYZ, b)])
    box = [f(c).alias(f"_{m}{c}") for c in XYZ for f, m in ((F.min, "lo"), (F.max, "hi"))]
    buckets = written(placed.groupBy(*keys, "scale", *b).agg(*box, F.count(F.lit(1)).alias("_n")), "buckets")
    ahead = [(i, j, k) for i in range(-splits, splits + 1) for j in range(-splits, splits + 1) for k in range(-splits, splits + 1) if (i, j, k) >= (0, 0, 0)]
    ways = F.array(*[F.struct(*[F.lit(o).alias(c) for c, o in zip(XYZ, w)]) for w in ahead])
    sent = buckets.withColumn("_o", F.explode(ways)).select(*keys, "scale", *b, "_n", *[f"_{m}{c}" for c in XYZ for m in ("lo", "hi")], *[(F.col(k) + F.col(f"_o.{c}")).alias(d) for c, k, d in zip(XYZ, b, other)])
    there = buckets.select(*keys, *[F.col(k).alias(d) for k, d in zip(b, other)], F.col("_n").alias("_m"), *[F.col(f"_{m}{c}").alias(f"_{m}2{c}") for c in XYZ for m in ("lo", "hi")])
    met = sent.join(there, [*keys, *other])
    apart = [F.greatest(F.lit(0.0), F.col(f"_lo{c}") - F.col(f"_hi2{c}"), F.col(f"_lo2{c}") - F.col(f"_hi{c}")) for c in XYZ]
    reach = [F.greatest(F.abs(F.col(f"_hi{c}") - F.col(f"_lo2{c}")), F.abs(F.col(f"_hi2{c}") - F.col(f"_lo{c}"))) for c in XYZ]
    length = lambda parts: F.sqrt(sum((x * x for x in parts), F.lit(0.0))) / F.col("scale")
    met = met.withColumn("_least", length(apart) * (1 - 1e-12)).withColumn("_most", length(reach) * (1 + 1e-12)).filter(F.col("_least") <= r_max)
    met = written(met.withColumn("_i", first(F.col("_least"))).withColumn("_whole", first(F.col("_least")) == first(F.col("_most"))), "bucket-pairs")
    own = sum(((F.col(k) == F.col(d)).cast("int") for k, d in zip(b, other)), F.lit(0)) == 3
    whole = met.filter("_whole").select(*keys, F.col("_i").alias("i"), F.when(own, F.col("_n") * (F.col("_n") - 1) / 2).otherwise(F.col("_n") * F.col("_m")).cast("long").alias("_c"))
    one = placed.select(*keys, *b, F.struct("point_id", *XYZ).alias("a"), "scale")
    two = placed.select(*keys, *[F.col(k).alias(d) for k, d in zip(b, other)], F.struct("point_id", *XYZ).alias("b"))
    looked = met.filter("not _whole").select(*keys, *b, *other, own.alias("_own")).join(one, [*keys, *b]).join(two, [*keys, *other])
    looked = looked.filter(~F.col("_own") | (F.col("a.point_id") < F.col("b.point_id"))).select(*keys, (distance() / F.col("scale")).alias("_v"))
    near = looked.filter(F.col("_v") <= r_max * (1 + 1e-9)).groupBy(*keys, first(F.col("_v")).alias("i")).agg(F.count(F.lit(1)).alias("_c"))
    return whole.unionByName(near).groupBy(*keys, "i").agg(F.sum("_c").alias("_c")), looked


def ripley_k(points: DataFrame, volumes: DataFrame, r_max: float = 0.5, n: int = 100, keys: list[str] = GROUP) -> DataFrame:
    """Volume times the share of pairs up to r, on a grid from 0 to ``r_max``; fewer than two points give 0.

    ``volumes``: keys, volume, and scale (distances are divided by it). Pairs are counted at their first grid point and a running sum
    follows.
    """
    step = r_max / (n - 1)
    counted, _ = pair_counts(points, volumes, r_max, n, keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(volumes, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    by = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    k = F.sum(F.coalesce("_c", F.lit(0))).over(by) * F.col("volume") * F.coalesce(F.try_divide(F.lit(2.0), F.col("_n") * (F.col("_n") - 1)), F.lit(0.0))
    return sizes.join(counted, [*keys, "i"], "left").select(*keys, "i", (F.col("i") * step).alias("r"), k.alias("k"))


def ripley_k_summary(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean and 95 % range over cells and seeds; volume of the cell's sphere, distances in cell diameters."""
    radius = F.lit(0.5)
    v = points.select(*GROUP).distinct().join(cells.select("cell_id", F.col("mem_diameter").alias("scale")), "cell_id").withColumn("volume", F.lit(4 / 3 * math.pi) * radius * radius * radius)
    k = ripley_k(points, v)
    return k.groupBy("mode", "i").agg(F.max("r").alias("r"), F.avg("k").alias("mean"), F.percentile("k", F.lit(0.025)).alias("lo"), F.percentile("k", F.lit(0.975)).alias("hi"))


#: Half of the eight lines around a line of voxels.
BESIDE = ((0, 1), (1, -1), (1, 0), (1, 1))


def voxel_runs(voxels: DataFrame, key: list[str]) -> DataFrame:
    """Stretches of voxels along z: keys, x, y, z (the first one's), last."""
    by = W.partitionBy(*key, "x", "y").orderBy("z")
    return voxels.select(*key, *XYZ).distinct().withColumn("_run", F.col("z") - F.row_number().over(by)).groupBy(*key, "x", "y", "_run").agg(F.min("z").alias("z"), F.max("z").alias("last")).drop("_run")


def component_centroids(voxels: DataFrame, keys: tuple[str, ...] = ("image_id", "channel", "value")) -> DataFrame:
    """C14: components of equal voxels (26 neighbours): label (the least voxel), centroid, size and whether it is the image's largest
    (first on ties); and the voxels with their labels.

    Voxels are folded into runs along z. Two runs on neighbouring lines touch where their stretches, one longer at both ends, overlap.
    """
    key = list(keys)
    runs = written(voxel_runs(voxels, key).withColumn("id", F.struct(*XYZ)), "runs")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in BESIDE])
    moved = runs.withColumn("_o", F.explode(offsets)).select(*key, (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y"), F.col("z").alias("_z"), F.col("last").alias("_last"), F.col("id").alias("a"))
    touching = (F.col("z") <= F.col("_last") + 1) & (F.col("last") >= F.col("_z") - 1)
    edges = moved.join(runs.withColumnRenamed("id", "b"), [*key, "x", "y"]).filter(touching).select(*key, "a", "b")
    roots, _ = connected(runs.select(*key, "id"), edges, key)
    labelled = written(runs.join(roots, [*key, "id"]).withColumnRenamed("root", "label"), "labels")
    n = (F.col("last") - F.col("z") + 1).cast("long")
    total = {"x": F.col("x") * n, "y": F.col("y") * n, "z": (F.col("z") + F.col("last")) * n / 2}
    size = labelled.groupBy(*key, "label").agg(*[(F.sum(total[c]) / F.sum(n)).alias(f"c{c}") for c in XYZ], F.sum(n).alias("size"))
    place = F.row_number().over(W.partitionBy(*[k for k in key if k != "value"]).orderBy(F.col("size").desc(), "label"))
    each = labelled.select(*key, "x", "y", F.explode(F.sequence("z", "last")).alias("z"), "label")
    return size.withColumn("largest", place == 1), each


def distance_to_component(centroids: DataFrame, voxels: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """From each centroid, rounded half to even, to the nearest voxel of the component (0 inside), by a distance transform."""
    key = list(keys)
    c = written(centroids.select(*key, "label", *[F.bround(F.col(f"c{k}")).cast("long").alias(k) for k in XYZ]), "centroids")
    voxels = voxels.select(*key, *[F.col(k).cast("long").alias(k) for k in XYZ])
    return c.join(squared_distances(voxels, c, key), [*key, *XYZ]).select(*key, "label", F.sqrt("d2").alias("distance"))


def mesh_bounds(vertices: DataFrame, keys: tuple[str, ...] = ("file",), expand: float = 1.2) -> DataFrame:
    """Centre, bounds and expanded box."""
    g = vertices.groupBy(*keys).agg(*[F.avg(c).alias(f"centre_{c}") for c in XYZ], *[f(c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])
    for c in XYZ:
        lo, hi = expand_box(F.col(f"{c}_min"), F.col(f"{c}_max"), expand)
        g = g.withColumn(f"{c}_min_expanded", lo).withColumn(f"{c}_max_expanded", hi)
    return g


def scaled_radius(stats: DataFrame, cells: DataFrame, kind: str = "mem_diameter") -> DataFrame:
    """C17: structure radius over the cell's size: mean and deviation over cells that both tables have."""
    j = stats.join(cells.select("cell_id", F.col(kind).alias("_s")), "cell_id").withColumn("_r", F.col("radius") / F.col("_s"))
    return j.groupBy("structure_id").agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"), F.count("_r").alias("n"))


def distance_agreement(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("cell_id", "point_id")) -> DataFrame:
    """Two distances of the same points: difference per point."""
    return a.select(*keys, F.col("distance").alias("d_a")).join(b.select(*keys, F.col("distance").alias("d_b")), list(keys)).withColumn("difference", F.col("d_a") - F.col("d_b"))


def agreement_summary(differences: DataFrame, distances: DataFrame, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Per cell, how far two distances of its points differ, and the shares of points inside the nucleus and outside the membrane.

    ``differences``: keys, difference; ``distances``: keys, nucleus (negative inside), membrane (negative outside).
    """
    apart = differences.groupBy(*keys).agg(F.count("difference").alias("n"), F.avg("difference").alias("mean_difference"), F.sqrt(F.avg(F.col("difference") * F.col("difference"))).alias("rms_difference"))
    return apart.join(cytoplasm_qc(distances, list(keys)), list(keys), "left")


def weight_maps(points: DataFrame, cells: DataFrame, length: float | None = None) -> DataFrame:
    """Distance and decay weight of slice points by kind. ``points``: cell_id, point_id, z, nucleus, membrane."""
    from .expressions import decay_weights

    z = points.join(cells.select("cell_id", "mem_z_max"), "cell_id")
    kinds = {"nucleus": F.col("nucleus"), "membrane": F.col("membrane"), "top": F.col("mem_z_max") - F.col("z"), "uniform": F.lit(None).cast("double")}
    long = z.select("cell_id", "point_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("distance")) for k, v in kinds.items()])).alias("p")).select("cell_id", "point_id", "p.kind", "p.distance")
    return decay_weights(long, length, ["cell_id", "kind"]).withColumn("weight", F.when(F.col("kind") == "uniform", 1.0).otherwise(F.col("weight")))
