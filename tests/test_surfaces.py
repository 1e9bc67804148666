"""Distances, rays and insides of fine surfaces against closed forms and plain loops over all triangles; how many rows meet."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlore.operators import geometry as C
from pointlore.operators import surfaces as S


def icosphere(levels: int, radius: float) -> np.ndarray:
    """20 * 4**levels triangles, corners on the sphere, turned outwards: (n, 3, 3)."""
    g = (1 + 5**0.5) / 2
    v = np.array([(0, s, t * g) for s in (-1, 1) for t in (-1, 1)] + [(s, t * g, 0) for s in (-1, 1) for t in (-1, 1)] + [(t * g, 0, s) for s in (-1, 1) for t in (-1, 1)], float)
    near = [(i, j, k) for i in range(12) for j in range(i) for k in range(j) if max(np.linalg.norm(v[a] - v[b]) for a, b in ((i, j), (j, k), (i, k))) < 2.1]
    t = np.array([[v[i], v[j], v[k]] for i, j, k in near])
    t[np.einsum("ij,ij->i", np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), t[:, 0]) < 0] = t[np.einsum("ij,ij->i", np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), t[:, 0]) < 0][:, ::-1]
    for _ in range(levels):
        a, b, c = t[:, 0], t[:, 1], t[:, 2]
        ab, bc, ca = (a + b) / 2, (b + c) / 2, (c + a) / 2
        t = np.concatenate([np.stack(x, 1) for x in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])
    return t / np.linalg.norm(t, axis=2, keepdims=True) * radius


def mesh(spark, surfaces):
    """surfaces: (cell, surface, triangles)."""
    parts = [pd.DataFrame(t.reshape(-1, 9), columns=S.CORNERS).assign(cell_id=c, surface=s) for c, s, t in surfaces]
    return spark.createDataFrame(pd.concat(parts))


def cloud(spark, at, cell="c"):
    return spark.createDataFrame(pd.DataFrame(at, columns=["x", "y", "z"]).assign(cell_id=cell, point_id=np.arange(len(at))))


def plain_distance(p, t):
    """Least distance of each point to all triangles, by projecting on faces and edges."""
    out = np.full(len(p), np.inf)
    a, ab, ac = t[:, 0], t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    for k, x in enumerate(p):
        n = np.cross(ab, ac)
        d = np.einsum("ij,ij->i", x - a, n) / np.einsum("ij,ij->i", n, n)
        q = x - d[:, None] * n
        u = np.einsum("ij,ij->i", np.cross(q - a, ac), n) / np.einsum("ij,ij->i", n, n)
        v = np.einsum("ij,ij->i", np.cross(ab, q - a), n) / np.einsum("ij,ij->i", n, n)
        face = np.where((u >= 0) & (v >= 0) & (u + v <= 1), np.linalg.norm(x - q, axis=1), np.inf)
        for s, e in ((0, 1), (1, 2), (2, 0)):
            w = t[:, e] - t[:, s]
            f = np.clip(np.einsum("ij,ij->i", x - t[:, s], w) / np.einsum("ij,ij->i", w, w), 0, 1)
            face = np.minimum(face, np.linalg.norm(x - t[:, s] - f[:, None] * w, axis=1))
        out[k] = face.min()
    return out


def shell(rng, n, lo, hi):
    d = rng.normal(size=(n, 3))
    return d / np.linalg.norm(d, axis=1, keepdims=True) * rng.uniform(lo, hi, (n, 1))


def test_fine_spheres(spark):
    """20,480 faces a surface: signed distances, insides and scaled distances."""
    rng = np.random.default_rng(2)
    inner, outer = icosphere(5, 5.0), icosphere(5, 10.0)
    tri = mesh(spark, [("c", "nuc", inner), ("c", "mem", outer)])
    p = np.concatenate([shell(rng, 150, 0.5, 12), [[0, 0, 0], [2, 0, 0], [12, 0, 0], [0, 0, 7.5], [0, 7.5, 0], [30, 40, 50]]])
    df, r = cloud(spark, p), np.linalg.norm(p, axis=1)
    mem = {x["point_id"]: x for x in S.surface_distance(df, tri, surface="mem").collect()}
    want = plain_distance(p, outer)
    for k in range(len(p)):
        assert abs(mem[k]["distance"]) == pytest.approx(want[k], abs=1e-9)
        assert mem[k]["inside"] == (r[k] < 9.99) and (mem[k]["distance"] > 0) == mem[k]["inside"]
        near = np.array([mem[k][c] for c in ("nx", "ny", "nz")])
        assert np.linalg.norm(p[k] - near) == pytest.approx(want[k], abs=1e-9)
    got = {x["point_id"]: x for x in C.classify_points(df, tri).collect()}
    assert all(got[k]["in_nucleus"] == (r[k] < 4.99) and got[k]["in_cytoplasm"] == (5 < r[k] < 9.99) for k in range(len(p)) if abs(r[k] - 5) > 0.02 and abs(r[k] - 10) > 0.02)
    scaled = {x["point_id"]: x["scaled_distance"] for x in S.scaled_surface_distance(df, tri).collect()}
    for k in range(len(p)):
        if 5.05 < r[k] < 9.95:
            assert scaled[k] == pytest.approx((r[k] - 5) / 5, abs=0.02)
        elif r[k] < 4.95 or r[k] > 10.05:
            assert scaled[k] is None


def rows_met(spark, p, t):
    rows = S.numbered_rows(cloud(spark, p))
    placed, pairs, on = S.meetings(rows, mesh(spark, [("c", "mem", t)]), ("cell_id",))
    per_block = pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("t"))
    return placed.join(per_block, on).agg(F.sum("t")).first()[0] / len(p)


def test_rows_a_point(spark):
    """Triangles that a point meets do not follow the number of triangles: near the surface as many, far from it far fewer than all."""
    rng = np.random.default_rng(3)
    near = {}
    for levels in (2, 3, 5):
        t = icosphere(levels, 10.0)
        edge = 10 * math.sqrt(4 * math.pi / len(t))
        near[levels] = rows_met(spark, shell(rng, 300, 10 - edge, 10 + edge), t)
    assert near[5] < 1.5 * near[3] and near[5] < 20480 / 30
    assert rows_met(spark, shell(rng, 300, 4, 9), icosphere(5, 10.0)) < 20480 / 6


def test_crossings_on_edges_and_corners(spark):
    """A cube's faces meet over the points: lines through edges and corners cross each boundary once."""
    quads = []
    for axis in range(3):
        for side in (0.0, 4.0):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            corner = lambda a, b: [side if k == axis else (a if k == u else b) for k in range(3)]  # noqa: E731, B023
            q = [corner(0.0, 0.0), corner(4.0, 0.0), corner(4.0, 4.0), corner(0.0, 4.0)]
            quads += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]] if side else [[q[0], q[2], q[1]], [q[0], q[3], q[2]]]
    tri = mesh(spark, [("c", "mem", np.array(quads)), ("c", "nuc", np.array(quads) / 4 + 1)])
    p = np.array([(x, y, z) for x in (-1.0, 1.0, 2.0, 3.0, 5.0) for y in (-1.0, 1.0, 2.0, 3.0, 5.0) for z in (-1.0, 0.5, 2.0, 3.5, 5.0)])
    got = {r["point_id"]: r for r in C.classify_points(cloud(spark, p), tri).collect()}
    for k, x in enumerate(p):
        assert got[k]["in_membrane"] == bool(((x > 0) & (x < 4)).all()), x
    # Turned inwards it winds the other way and holds the same points.
    back = {r["point_id"]: r["inside"] for r in S.surface_distance(cloud(spark, p), mesh(spark, [("c", "mem", np.array(quads)[:, ::-1])]), surface="mem").collect()}
    assert all(back[k] == got[k]["in_membrane"] for k in back)


def test_inside_grid(spark):
    """Scanlines give the grid points that the test of single points keeps, also for a surface with a hollow."""
    shellish = np.concatenate([icosphere(2, 7.3), icosphere(2, 4.1)[:, ::-1]])
    tri = mesh(spark, [("c", "mem", shellish), ("d", "mem", icosphere(1, 3.2) + 1.5)])
    boxes = spark.createDataFrame([("c", -8.0, -8.0, -8.0, 8.0, 8.0, 8.0), ("d", -2.0, -3.0, -2.0, 5.0, 5.0, 5.0), ("none", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "cell_id string, x_min double, y_min double, z_min double, x_max double, y_max double, z_max double")
    key = lambda r: (r["cell_id"], round(r["x"], 6), round(r["y"], 6), round(r["z"], 6))
    got = sorted(map(key, S.inside_grid(boxes, tri, 0.7).collect()))
    every = C.grid_points(boxes, 0.7)
    want = sorted(map(key, S.surface_distance(every, tri).filter("inside").collect()))
    assert got == want and len(got) == len(set(got)) and len(got) > 1000


def test_piled_points(spark, monkeypatch):
    """Many points in one block are dealt in pieces; repeated rows stay rows of their own; other columns pass."""
    monkeypatch.setattr(S, "PIECE", 16)
    t = icosphere(1, 5.0)
    p = np.concatenate([np.full((100, 3), 1.0), np.zeros((3, 3)), [[9.0, 0, 0]]])
    got = S.surface_distance(cloud(spark, p).withColumn("point_id", F.lit(1)).withColumn("node", F.lit("x")), mesh(spark, [("c", "mem", t)])).collect()
    assert len(got) == 104 and all(r["node"] == "x" for r in got)
    want = plain_distance(np.array([[1.0, 1, 1]]), t)[0]
    assert sum(abs(r["distance"] - want) < 1e-9 for r in got) == 100


def test_no_points(spark):
    empty = cloud(spark, np.zeros((1, 3))).filter("x > 5")
    tri = mesh(spark, [("c", "mem", icosphere(0, 1.0)), ("c", "nuc", icosphere(0, 0.5))])
    assert S.surface_distance(empty, tri, surface="mem").collect() == [] and S.scaled_surface_distance(empty, tri).collect() == []
    assert C.classify_points(cloud(spark, np.zeros((1, 3)), "other"), tri).first()["in_membrane"] is False
