"""Closed surfaces of triangles (C04, C05, C07, C08): a tree of boxes for distances and rays, columns of crossings for what lies inside.

Triangles of a surface lie in buckets of a grid by their centroids, about ``LEAF`` in each; buckets have the tight box of their
triangles, and four by four by four buckets make one of the next level, up to ``TOP`` along an axis. Points lie in blocks of half a
bucket. A block goes down the tree with those boxes that may hold the nearest triangle of one of its points: the least distance of the
two boxes is no more than the least upper bound over all boxes. What is left at the bottom, a number that does not grow with the
surface near it, meets the block's points.

What lies inside is told by counting, for each point, the triangles above it with their turning sense: it is the winding number of a
closed surface, exact up to rounding. Only triangles over the point's own column of a grid are looked at. A point under an edge or a
corner counts as moved a little to the side, in the same way for all triangles, so that it crosses one of them.
"""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.storage import written

XYZ = ("x", "y", "z")
CORNERS = [f"{k}{c}" for k in "abc" for c in XYZ]
LEAF = 16
TOP = 6
PIECE = 4096

# --- vectors as structs ------------------------------------------------------------------------


def vec(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def sub(a: Column, b: Column) -> Column:
    return vec(*[a[c] - b[c] for c in XYZ])


def add(a: Column, b: Column, t: Column) -> Column:
    return vec(*[a[c] + t * b[c] for c in XYZ])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def _segment(p: Column, a: Column, d: Column) -> Column:
    """Nearest point to p on the segment from a along d."""
    t = F.coalesce(F.try_divide(dot(sub(p, a), d), dot(d, d)), F.lit(0.0))
    return add(a, d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def nearest_on_triangle(df: DataFrame) -> DataFrame:
    """``_q``, nearest point of the triangle (the projection where it falls inside, else the best of the three edges), and ``_d2``."""
    corner = lambda k: vec(*[F.col(f"{k}{c}") for c in XYZ])
    df = df.withColumn("_p", vec(*[F.col(k) for k in XYZ])).withColumn("_a", corner("a")).withColumn("_b", corner("b")).withColumn("_c", corner("c"))
    df = df.withColumn("_ab", sub(F.col("_b"), F.col("_a"))).withColumn("_ac", sub(F.col("_c"), F.col("_a"))).withColumn("_ap", sub(F.col("_p"), F.col("_a")))
    d00, d01, d11 = (dot(F.col(u), F.col(v)) for u, v in (("_ab", "_ab"), ("_ab", "_ac"), ("_ac", "_ac")))
    d20, d21 = dot(F.col("_ap"), F.col("_ab")), dot(F.col("_ap"), F.col("_ac"))
    den = d00 * d11 - d01 * d01
    df = df.withColumn("_v", F.try_divide(d11 * d20 - d01 * d21, den)).withColumn("_w", F.try_divide(d00 * d21 - d01 * d20, den))
    face = add(add(F.col("_a"), F.col("_ab"), F.col("_v")), F.col("_ac"), F.col("_w"))
    inside = (F.col("_v") >= 0) & (F.col("_w") >= 0) & (F.col("_v") + F.col("_w") <= 1)
    edges = [_segment(F.col("_p"), F.col("_a"), F.col("_ab")), _segment(F.col("_p"), F.col("_a"), F.col("_ac")), _segment(F.col("_p"), F.col("_b"), sub(F.col("_c"), F.col("_b")))]
    for k, e in enumerate(edges):
        df = df.withColumn(f"_e{k}", e)
    square = lambda q: dot(sub(F.col("_p"), q), sub(F.col("_p"), q))
    best = F.array_min(F.array(*[F.struct(square(F.col(f"_e{k}")).alias("d"), F.col(f"_e{k}").alias("q")) for k in range(3)]))
    df = df.withColumn("_best", best)
    return df.withColumn("_q", F.when(inside, face).otherwise(F.col("_best.q"))).withColumn("_d2", square(F.col("_q")))


# --- the tree -------------------------------------------------------------------------------------


def _low(c: str) -> Column:
    return F.least(*[F.col(f"{k}{c}") for k in "abc"])


def _high(c: str) -> Column:
    return F.greatest(*[F.col(f"{k}{c}") for k in "abc"])


def _node(level: int) -> Column:
    """The bucket's number at a level: its three places, 21 bits each."""
    b = [F.shiftright(F.col(f"_b{c}"), 2 * level) for c in XYZ]
    return F.shiftleft(b[0], 42) + F.shiftleft(b[1], 21) + b[2]


class Tree:
    """``facts``: keys, n, least corner, width of a bucket; ``leaves``: keys, node and corners; ``boxes``: by level, keys, node, parent and box."""

    def __init__(self, triangles: DataFrame, keys: tuple[str, ...]):
        keys = list(keys)
        ends = [f(g(c)).alias(f"_{n}{c}") for c in XYZ for f, g, n in ((F.min, _low, "lo"), (F.max, _high, "hi"))]
        facts = triangles.groupBy(*keys).agg(*ends, F.count(F.lit(1)).alias("_n"))
        span = F.greatest(*[F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in XYZ])
        # A closed surface of that span has about three squares of it.
        width = F.greatest(span * F.sqrt(F.lit(3.0 * LEAF) / F.col("_n")), F.lit(1e-12))
        self.keys, self.facts = keys, written(facts.withColumn("_w", width).withColumn("_span", span), "surfaces")
        placed = triangles.select(*keys, *CORNERS).join(self.facts, keys)
        for c in XYZ:
            placed = placed.withColumn(f"_b{c}", F.floor(((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 - F.col(f"_lo{c}")) / F.col("_w")).cast("long"))
        leaves = written(placed.select(*keys, *CORNERS, *[f"_b{c}" for c in XYZ], _node(0).alias("node")), "leaves")
        most = self.facts.agg(F.max(F.col("_span") / F.col("_w"))).first()[0] or 0
        self.boxes, level = [], 0
        while True:
            box = [f(g(c)).alias(f"_{n}{c}") for c in XYZ for f, g, n in ((F.min, _low, "nlo"), (F.max, _high, "nhi"))]
            self.boxes.append(leaves.groupBy(*keys, _node(level).alias("node"), _node(level + 1).alias("parent")).agg(*box))
            if most / 4**level <= TOP:
                break
            level += 1
        self.leaves = leaves.select(*keys, "node", *CORNERS)

    def descend(self, items: DataFrame, among: list[str], keep) -> DataFrame:
        """``items`` (keys, ``among`` and further columns) with each leaf ``node`` that ``keep`` leaves them: it gets items with the boxes of a level."""
        found = items.join(self.boxes[-1].drop("parent"), self.keys)
        for level in range(len(self.boxes) - 1, -1, -1):
            found = keep(found).select(*items.columns, "node")
            if level:
                found = found.withColumnRenamed("node", "parent").join(self.boxes[level - 1], [*self.keys, "parent"]).drop("parent")
        return found


def numbered_rows(points: DataFrame) -> DataFrame:
    """Points with a number each, written so that it stays."""
    return written(points.withColumn("_row", F.monotonically_increasing_id()), "points")


def meetings(rows: DataFrame, triangles: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points with their blocks, triangles with the blocks they may be nearest in, and the columns that both are joined on."""
    tree = Tree(triangles, keys)
    on = [*tree.keys, "_kx", "_ky", "_kz"]
    placed = rows.select(*tree.keys, "_row", *XYZ).join(tree.facts.select(*tree.keys, *[f"_lo{c}" for c in XYZ], "_w"), tree.keys)
    placed = placed.select(*tree.keys, "_row", *XYZ, *[F.floor((F.col(c) - F.col(f"_lo{c}")) / F.col("_w") * 2).cast("long").alias(f"_k{c}") for c in XYZ])
    box = [f(c).alias(f"_{n}{c}") for c in XYZ for f, n in ((F.min, "plo"), (F.max, "phi"))]
    blocks = written(placed.groupBy(*on).agg(*box, F.ceil(F.count(F.lit(1)) / PIECE).alias("_pieces")), "blocks")

    def near(found: DataFrame) -> DataFrame:
        apart = [F.greatest(F.lit(0.0), F.col(f"_plo{c}") - F.col(f"_nhi{c}"), F.col(f"_nlo{c}") - F.col(f"_phi{c}")) for c in XYZ]
        reach = [F.greatest(F.abs(F.col(f"_nhi{c}") - F.col(f"_plo{c}")), F.abs(F.col(f"_phi{c}") - F.col(f"_nlo{c}"))) for c in XYZ]
        far = sum((x * x for x in reach), F.lit(0.0))
        bound = F.min(far).over(W.partitionBy(*on))
        return found.withColumn("_least", sum((x * x for x in apart), F.lit(0.0))).withColumn("_bound", bound).filter(F.col("_least") <= F.col("_bound") * (1 + 1e-9))

    pairs = tree.descend(blocks, on, near).join(tree.leaves, [*tree.keys, "node"])
    # A block of very many points is dealt in pieces.
    several = blocks.filter("_pieces > 1").select(*on, "_pieces")
    if several.isEmpty():
        pairs, placed = pairs.withColumn("_piece", F.lit(0).cast("long")), placed.withColumn("_piece", F.lit(0).cast("long"))
    else:
        pairs = pairs.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
        placed = placed.join(several, on, "left").withColumn("_piece", F.pmod(F.xxhash64("_row"), F.coalesce("_pieces", F.lit(1)))).drop("_pieces")
    on = [*on, "_piece"]
    return placed, pairs.select(*on, *CORNERS), on


def nearest(rows: DataFrame, triangles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """_row, _d2 and the nearest point nx, ny, nz of the surface. ``rows``: keys, _row, x, y, z."""
    placed, pairs, on = meetings(rows, triangles, keys)
    best = [F.min_by(F.col(f"_q.{c}"), F.col("_d2")).alias(f"n{c}") for c in XYZ]
    return nearest_on_triangle(placed.join(pairs, on)).groupBy(*on, "_row").agg(F.min("_d2").alias("_d2"), *best).select("_row", "_d2", "nx", "ny", "nz")


# --- crossings ----------------------------------------------------------------------------------------


def _side(p: str, q: str, u: str, v: str) -> tuple[Column, Column]:
    """Twice the area of (p, q, point) in the plane u, v and its sign. Both ways along an edge give opposite values, zero never."""
    at = lambda k, c: F.col(f"{k}{c}")
    turned = (at(p, u) > at(q, u)) | ((at(p, u) == at(q, u)) & (at(p, v) > at(q, v)))
    pick = lambda a, b, c: F.when(turned, at(b, c)).otherwise(at(a, c))
    du, dv = pick(q, p, u) - pick(p, q, u), pick(q, p, v) - pick(p, q, v)
    area = du * (F.col(v) - pick(p, q, v)) - dv * (F.col(u) - pick(p, q, u))
    sign = F.when(area > 0, 1).when(area < 0, -1).when(dv != 0, -F.signum(dv)).otherwise(F.signum(du))
    return F.when(turned, -area).otherwise(area), F.when(turned, -sign).otherwise(sign)


def crossed(df: DataFrame, u: str, v: str, h: str) -> DataFrame:
    """Rows whose triangle the line through (u, v) along h meets: ``_turn`` (1 or -1) and ``_at``, the place along h."""
    for k, (p, q) in enumerate((("b", "c"), ("c", "a"), ("a", "b"))):
        area, sign = _side(p, q, u, v)
        df = df.withColumn(f"_s{k}", area).withColumn(f"_g{k}", sign.cast("int"))
    met = df.filter((F.col("_g0") == F.col("_g1")) & (F.col("_g1") == F.col("_g2")) & (F.col("_g0") != 0))
    at = F.try_divide(F.col("_s0") * F.col(f"a{h}") + F.col("_s1") * F.col(f"b{h}") + F.col("_s2") * F.col(f"c{h}"), F.col("_s0") + F.col("_s1") + F.col("_s2"))
    return met.withColumn("_turn", F.col("_g0")).withColumn("_at", at).drop(*[f"_{n}{k}" for n in "sg" for k in range(3)]).filter("_at is not null")


def windings(rows: DataFrame, triangles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """_row and _wind, the winding number, of the points that lie under a triangle; all others have 0."""
    keys = list(keys)
    ends = [f(g(c)).alias(f"_{n}{c}") for c in "xy" for f, g, n in ((F.min, _low, "lo"), (F.max, _high, "hi"))]
    facts = triangles.groupBy(*keys).agg(*ends, F.count(F.lit(1)).alias("_n"))
    # Columns about as wide as a triangle.
    width = F.greatest(F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy")) * 3 / F.sqrt("_n"), F.lit(1e-12))
    facts = facts.select(*keys, "_lox", "_loy", width.alias("_w"))
    column = lambda c, value: F.floor((value - F.col(f"_lo{c}")) / F.col("_w")).cast("long")
    laid = triangles.select(*keys, *CORNERS).join(facts, keys)
    for c in "xy":
        laid = laid.withColumn(f"_k{c}", F.explode(F.sequence(column(c, _low(c)), column(c, _high(c)))))
    asked = rows.select(*keys, "_row", *XYZ).join(facts, keys).select(*keys, "_row", *XYZ, *[column(c, F.col(c)).alias(f"_k{c}") for c in "xy"])
    met = crossed(asked.join(laid.select(*keys, "_kx", "_ky", *CORNERS), [*keys, "_kx", "_ky"]), "x", "y", "z").filter(F.col("_at") > F.col("z"))
    return met.groupBy("_row").agg(F.sum("_turn").alias("_wind"))


def of_surface(triangles: DataFrame, surface: str | None) -> DataFrame:
    return triangles.filter(F.col("surface") == surface) if surface else triangles


def insides(rows: DataFrame, triangles: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``."""
    return rows.join(windings(rows, triangles, keys), "_row", "left").withColumn(name, F.coalesce(F.col("_wind") != 0, F.lit(False))).drop("_wind")


# --- the operators ------------------------------------------------------------------------------------------


def surface_distance(points: DataFrame, triangles: DataFrame, keys: tuple[str, ...] = ("cell_id",), surface: str | None = None) -> DataFrame:
    """Distance to a closed surface, positive inside; for ``surface`` 'nuc' the sign is turned.

    Adds distance, inside and the nearest point nx, ny, nz. Points that lack a coordinate, or whose keys have no surface, are left out.
    """
    t = of_surface(triangles, surface)
    rows = numbered_rows(points)
    out = insides(rows, t, keys, "inside").join(nearest(rows, t, keys), "_row")
    sign = F.when(F.col("inside"), -1.0 if surface == "nuc" else 1.0).otherwise(1.0 if surface == "nuc" else -1.0)
    return out.select(*points.columns, (sign * F.sqrt("_d2")).alias("distance"), "inside", "nx", "ny", "nz")


def classify_points(points: DataFrame, triangles: DataFrame, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """in_nucleus, in_membrane, in_cytoplasm; by crossings alone."""
    rows = numbered_rows(points)
    for surface, name in (("nuc", "in_nucleus"), ("mem", "in_membrane")):
        rows = insides(rows, of_surface(triangles, surface), keys, name)
    return rows.drop("_row").withColumn("in_cytoplasm", F.col("in_membrane") & ~F.col("in_nucleus"))


def scaled_surface_distance(points: DataFrame, triangles: DataFrame, keys: tuple[str, ...] = ("cell_id",), inner: str = "nuc", outer: str = "mem") -> DataFrame:
    """Along the ray from the nearest inner point through the point: its distance over the distance to the outer surface.

    Null inside the inner or outside the outer surface, for rays of no length or without a hit, and outside [0, 1]. A ray meets the
    triangles of those boxes of the outer surface's tree that it passes.
    """
    own = points.columns
    inside, outside = of_surface(triangles, inner), of_surface(triangles, outer)
    rows = numbered_rows(points)
    near = nearest(rows, inside, keys)
    asked = written(insides(insides(rows, inside, keys, "_in"), outside, keys, "_out").join(near, "_row"), "rays")
    ray = sum(((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) for c in XYZ), F.lit(0.0))
    rays = asked.filter(~F.col("_in") & F.col("_out") & (F.sqrt(ray) > 1e-8)).select(*keys, "_row", *[F.col(f"n{c}").alias(f"_o{c}") for c in XYZ], *[(F.col(c) - F.col(f"n{c}")).alias(f"_r{c}") for c in XYZ])
    tree = Tree(outside, keys)

    def passed(found: DataFrame) -> DataFrame:
        """Where the ray runs between two faces of a box on each axis; a little more, for what lies on a face."""
        far = F.lit(1e300)
        enter, leave = [F.lit(0.0)], [far]
        for c in XYZ:
            slack = (F.abs(F.col(f"_nlo{c}")) + F.abs(F.col(f"_nhi{c}")) + F.abs(F.col(f"_o{c}"))) * 1e-9 + 1e-12
            lo, hi, r = F.col(f"_nlo{c}") - slack - F.col(f"_o{c}"), F.col(f"_nhi{c}") + slack - F.col(f"_o{c}"), F.col(f"_r{c}")
            there = (lo <= 0) & (hi >= 0)
            t1, t2 = F.try_divide(lo, r), F.try_divide(hi, r)
            enter.append(F.when(r == 0, F.when(there, 0.0).otherwise(far)).otherwise(F.least(t1, t2)))
            leave.append(F.when(r == 0, far).otherwise(F.greatest(t1, t2)))
        return found.filter(F.greatest(*enter) <= F.least(*leave))

    j = tree.descend(rays, ["_row"], passed).join(tree.leaves, [*tree.keys, "node"])
    corner = lambda k: vec(*[F.col(f"{k}{c}") for c in XYZ])
    j = j.withColumn("_o", corner("_o")).withColumn("_ray", corner("_r"))
    j = j.withColumn("_a", corner("a")).withColumn("_e1", sub(corner("b"), F.col("_a"))).withColumn("_e2", sub(corner("c"), F.col("_a")))
    j = j.withColumn("_h", cross(F.col("_ray"), F.col("_e2"))).withColumn("_s", sub(F.col("_o"), F.col("_a")))
    j = j.withColumn("_det", dot(F.col("_e1"), F.col("_h"))).withColumn("_u", F.try_divide(dot(F.col("_s"), F.col("_h")), F.col("_det"))).withColumn("_qv", cross(F.col("_s"), F.col("_e1")))
    j = j.withColumn("_v2", F.try_divide(dot(F.col("_ray"), F.col("_qv")), F.col("_det"))).withColumn("_t", F.try_divide(dot(F.col("_e2"), F.col("_qv")), F.col("_det")))
    eps = 1e-9
    hit = (F.col("_u") >= -eps) & (F.col("_v2") >= -eps) & (F.col("_u") + F.col("_v2") <= 1 + eps) & (F.col("_t") > eps)
    first = j.filter(hit).groupBy("_row").agg(F.min("_t").alias("_t"))
    # The point lies at parameter 1 of the ray, the hit at t.
    scaled = F.try_divide(F.lit(1.0), F.col("_t"))
    return asked.join(first, "_row", "left").withColumn("scaled_distance", F.when((scaled >= 0) & (scaled <= 1), scaled)).select(*own, "scaled_distance")


def grid_sizes(boxes: DataFrame, spacing: float) -> DataFrame:
    """Boxes with the greatest index of each axis, _nx, _ny, _nz: an axis runs to at most half a step beyond its greatest value."""
    for c in XYZ:
        boxes = boxes.withColumn(f"_n{c}", F.greatest(F.lit(0), F.ceil((F.col(f"{c}_max") + spacing / 2 - F.col(f"{c}_min")) / spacing) - 1).cast("long"))
    return boxes


def inside_grid(boxes: DataFrame, triangles: DataFrame, spacing: float, keys: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """The points of a regular grid that lie inside a closed surface: keys, x, y, z.

    The grid's lines along x are met with the triangles over them once. Between two hits, in order, a line lies inside or outside as a
    whole; grid points are made only where it lies inside. A triangle is laid under the lines of its own box.
    """
    keys = list(keys)
    sized = grid_sizes(boxes.select(*keys, *[f"{c}_{e}" for c in XYZ for e in ("min", "max")]), spacing)
    laid = triangles.select(*keys, *CORNERS).join(sized, keys)
    for c in "yz":
        first = F.greatest(F.lit(0), F.floor((_low(c) - F.col(f"{c}_min")) / spacing)).cast("long")
        last = F.least(F.col(f"_n{c}"), F.ceil((_high(c) - F.col(f"{c}_min")) / spacing)).cast("long")
        laid = laid.filter(first <= last).withColumn(f"_i{c}", F.explode(F.sequence(first, last))).withColumn(c, F.col(f"{c}_min") + F.col(f"_i{c}") * spacing)
    hits = crossed(laid, "y", "z", "x").select(*keys, "_iy", "_iz", "y", "z", "x_min", "_nx", "_at", "_turn")
    along = W.partitionBy(*keys, "_iy", "_iz").orderBy("_at", "_turn")
    lines = hits.withColumn("_wind", F.sum("_turn").over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("_to", F.lead("_at").over(along)).filter("_wind <> 0 and _to > _at")
    first = F.greatest(F.lit(0), F.floor((F.col("_at") - F.col("x_min")) / spacing)).cast("long")
    last = F.least(F.col("_nx"), F.ceil((F.col("_to") - F.col("x_min")) / spacing)).cast("long")
    filled = lines.filter(first <= last).withColumn("_ix", F.explode(F.sequence(first, last))).withColumn("x", F.col("x_min") + F.col("_ix") * spacing)
    return filled.filter((F.col("x") > F.col("_at")) & (F.col("x") < F.col("_to"))).select(*keys, *XYZ)
