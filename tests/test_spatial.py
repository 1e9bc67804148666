"""Components over runs, distance transforms, range-limited pair counts and tiled distances against plain loops; rounds and rows of the plans."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlore.operators import components as K
from pointlore.operators import geometry as C
from pointlore.operators import twosample as T

VOX = "image_id string, channel string, value int, x int, y int, z int"


def flood(voxels):
    """Label (least voxel) of each voxel by flooding."""
    left, out = set(voxels), {}
    for v in sorted(voxels):
        if v in left:
            left.discard(v)
            todo = [v]
            while todo:
                p = todo.pop()
                out[p] = v
                for o in itertools.product((-1, 0, 1), repeat=3):
                    q = (p[0] + o[0], p[1] + o[1], p[2] + o[2])
                    if q in left:
                        left.discard(q)
                        todo.append(q)
    return out


def snake(n):
    """A path that doubles back on every other line and layer: one component whose voxels touch only along it."""
    out = []
    for layer in range(n):
        for y in range(n):
            zs = range(n) if y % 2 == 0 else range(n - 1, -1, -1)
            out += [(2 * layer, 2 * y, z) for z in zs]
            if y < n - 1:
                out.append((2 * layer, 2 * y + 1, n - 1 if y % 2 == 0 else 0))
        if layer < n - 1:
            end = n - 1 if n % 2 else 0
            out.append((2 * layer + 1, 2 * (n - 1), end))
            out += [(2 * layer + 2, 2 * (n - 1), z) for z in range(n)]
    return sorted(set(out))


def test_components(spark):
    rnd = random.Random(4)
    images = {("a", "p"): [v for v in itertools.product(range(12), repeat=3) if rnd.random() < 0.07], ("a", "q"): [(0, 0, 0)], ("b", "p"): snake(6), ("c", "p"): [(0, 0, z) for z in range(50)] + [(1, 1, 50)] + [(-3, 5, z) for z in range(51)]}
    rows = [(i, c, 1, *v) for (i, c), vs in images.items() for v in vs]
    size, labels = C.component_centroids(spark.createDataFrame(rows + rows[:5], VOX).repartition(5))
    got, sizes = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in labels.collect():
        got[r["image_id"], r["channel"]][r["x"], r["y"], r["z"]] = tuple(r["label"])
    for r in size.collect():
        sizes[r["image_id"], r["channel"]][tuple(r["label"])] = r
    for k, voxels in images.items():
        want = flood(voxels)
        assert got[k] == want
        members = collections.defaultdict(list)
        for v, lab in want.items():
            members[lab].append(v)
        for lab, vs in members.items():
            r = sizes[k][lab]
            assert r["size"] == len(vs) and np.allclose([r["cx"], r["cy"], r["cz"]], np.mean(vs, 0))
        best = min(members, key=lambda m: (-len(members[m]), m))
        assert [m for m, r in sizes[k].items() if r["largest"]] == [best]


def test_contraction_rounds(spark):
    """A snake, and a path whose nodes come in random order: rounds grow with the logarithm."""
    rnd = random.Random(9)
    order = list(range(3000))
    rnd.shuffle(order)
    for path, most in ((list(range(3000)), 2), (order, math.ceil(math.log2(3000)))):
        edges = spark.createDataFrame([("k", a, b) for a, b in zip(path, path[1:])], "k string, a long, b long")
        roots, rounds = K.connected(spark.createDataFrame([("k", v) for v in [*path, 5000]], "k string, id long"), edges, ["k"])
        got = {r["id"]: r["root"] for r in roots.collect()}
        assert rounds <= most and set(got) == {*path, 5000} and all(v == (5000 if i == 5000 else 0) for i, v in got.items())
    voxels = spark.createDataFrame([("i", "c", 1, *v) for v in snake(9)], VOX)
    runs = C.voxel_runs(voxels, ["image_id", "channel", "value"]).count()
    assert runs < voxels.count() / 3
    size, _ = C.component_centroids(voxels)
    assert [r["size"] for r in size.collect()] == [voxels.count()]


def test_lower_envelope():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 200):
        pos = np.sort(rng.choice(500, n, replace=False)).astype(float)
        height = rng.integers(0, 400, n).astype(float) ** rng.choice([1, 2])
        asked = np.arange(-20.0, 520.0)
        want = (height[None] + (asked[:, None] - pos[None]) ** 2).min(1)
        assert np.array_equal(K.lower_envelope(pos, height, asked), want)


def test_squared_distances(spark):
    rng = np.random.default_rng(6)
    voxels, asked = {}, {}
    for image, n, m in (("a", 300, 80), ("b", 1, 20), ("c", 40, 1)):
        voxels[image] = np.unique(rng.integers(-15, 25, (n, 3)), axis=0)
        asked[image] = np.concatenate([rng.integers(-30, 40, (m, 3)), voxels[image][:2]])
    frame = lambda d: spark.createDataFrame([(i, *map(int, p)) for i, ps in d.items() for p in ps], "image_id string, x long, y long, z long")
    got = {(r["image_id"], r["x"], r["y"], r["z"]): r["d2"] for r in K.squared_distances(frame(voxels), frame(asked | {"none": [(0, 0, 0)]}), ["image_id"]).collect()}
    want = {(i, *map(int, p)): float(((voxels[i] - p) ** 2).sum(1).min()) for i, ps in asked.items() for p in ps}
    assert got == want


def test_pair_counts(spark):
    rng = np.random.default_rng(8)
    groups = {"spread": rng.uniform(-50, 50, (600, 3)), "knots": np.repeat(rng.uniform(-50, 50, (6, 3)), 60, axis=0), "two": np.array([[0, 0, 0], [0, 0, 1.0]]), "one": np.zeros((1, 3))}
    rows = [(g, "c", "0", k, *map(float, p)) for g, ps in groups.items() for k, p in enumerate(ps)]
    points = spark.createDataFrame(rows, "mode string, cell_id string, seed string, point_id long, x double, y double, z double")
    scales = points.select(*C.GROUP).distinct().withColumn("scale", F.lit(100.0)).withColumn("volume", F.lit(2.0))
    for r_max, n, splits in ((0.1, 21, 2), (0.5, 11, 3)):
        counted, looked = C.pair_counts(points, scales, r_max, n, splits=splits)
        got = collections.defaultdict(lambda: [0] * n)
        for r in counted.collect():
            got[r["mode"]][r["i"]] = r["_c"]
        grid = np.array([i * (r_max / (n - 1)) for i in range(n)])
        for g, ps in groups.items():
            a, b = np.triu_indices(len(ps), 1)
            d = np.sqrt(((ps[a] - ps[b]) ** 2).sum(1)) / 100.0
            assert np.cumsum(got[g]).tolist() == [int((d <= x).sum()) for x in grid], (g, r_max)
        if r_max == 0.1:
            # A tenth of the extent: few pairs are looked at, and none inside the knots.
            per = {r["mode"]: r["n"] for r in looked.groupBy("mode").agg(F.count("*").alias("n")).collect()}
            assert per["spread"] < 600 * 599 / 2 / 5 and per.get("knots", 0) < 360 * 359 / 2 / 5
    k = {(r["mode"], r["i"]): r["k"] for r in C.ripley_k(points, scales, 0.5, 11).collect()}
    assert k["two", 0] == 0 and k["two", 1] == pytest.approx(2.0) and k["one", 10] == 0


def test_tiles(spark):
    """Any cut into tiles gives the distances of all pairs."""
    rng = np.random.default_rng(5)
    groups = {(m, f"c{c}"): np.round(rng.normal(c, 1 + c, rng.integers(1, 40)), 1) for m in "xy" for c in range(6)}
    samples = spark.createDataFrame([("d", m, c, "0", float(v)) for (m, c), vs in groups.items() for v in vs], "measure string, mode string, cell_id string, seed string, value double")
    for how in ({}, {"tile_samples": 3}, {"tile_values": 20}, {"tile_samples": 1}):
        got = {(r["mode_1"], r["cell_id_1"], r["mode_2"], r["cell_id_2"]): r for r in T.emd_all_pairs(samples, ["y", "x"], **how).collect()}
        order = sorted(groups, key=lambda k: ("yx".index(k[0]), k[1]))
        assert set(got) == {(*a, *b) for a, b in itertools.combinations(order, 2)}
        for (a, b, c, d), r in got.items():
            x, y = np.sort(groups[a, b]), np.sort(groups[c, d])
            every = np.sort(np.concatenate([x, y]))
            gap = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y))
            assert r["emd"] == pytest.approx(float(gap[:-1] @ np.diff(every)), abs=1e-12) and (r["n1"], r["n2"]) == (len(x), len(y))


def plain_walk(x, y):
    every = np.sort(np.concatenate([x, y]))
    gap = np.abs(np.searchsorted(np.sort(x), every, "right") / len(x) - np.searchsorted(np.sort(y), every, "right") / len(y))
    return gap.max(), gap[:-1] @ np.diff(every)


def test_walk_over_ranges(spark):
    """One key over many ranges, beside small, tied and one-sided ones."""
    rng = np.random.default_rng(13)
    groups = {"big": (rng.normal(0, 1, 6000).round(3), rng.normal(0.3, 2, 9000).round(3)), "tied": (np.zeros(50), np.zeros(70)), "small": (np.array([1.0, 2.0]), np.array([1.5])), "apart": (np.array([0.0]), np.array([10.0]))}
    rows = [(g, side, float(v), 1.0) for g, pair in groups.items() for side, vs in enumerate(pair) for v in vs] + [("lone", 0, 1.0, 1.0)]
    got = {r["k"]: r for r in T.signed_walk(spark.createDataFrame(rows, "k string, side int, value double, w double").repartition(8), ["k"]).collect()}
    assert set(got) == set(groups)
    for g, (x, y) in groups.items():
        ks, emd = plain_walk(x, y)
        assert got[g]["ks"] == pytest.approx(ks, abs=1e-9) and got[g]["emd"] == pytest.approx(emd, abs=1e-9) and (got[g]["n1"], got[g]["n2"]) == (len(x), len(y))


def test_large_samples_take_the_ranges(spark):
    """Samples as arrays and as rows give the same; baselines by seed, else by the smallest seed."""
    rng = np.random.default_rng(14)
    rows = [("d", m, c, s, float(v)) for m in "abc" for c in "pq" for s in "01" if not (m == "a" and s == "0" and c == "q") for v in rng.normal(ord(m) - 97, 1, rng.integers(2, 60)).round(1)]
    samples = spark.createDataFrame(rows + [("d", "b", "only here", "0", 1.0)], "measure string, mode string, cell_id string, seed string, value double")
    base = spark.createDataFrame([("a",), ("c",)], "baseline string")
    key = lambda r: (r["baseline"], r["mode"], r["cell_id"], r["seed"])
    runs = [{key(r): (r["n1"], r["n2"], round(r["ks"], 9), round(r["emd"], 9)) for r in T.against_baselines(samples, base, whole).collect()} for whole in (T.WHOLE, 25, 1)]
    assert runs[0] == runs[1] == runs[2]
    of = collections.defaultdict(list)
    for _, m, c, s, v in rows:
        of[m, c, s].append(v)
    assert set(runs[0]) == {(b, m, c, s) for b in "ac" for m, c, s in of if m != b}
    for (b, m, c, s), (n1, n2, ks, emd) in runs[0].items():
        y = of[b, c, s] or of[b, c, "1"]
        want = plain_walk(np.array(of[m, c, s]), np.array(y))
        assert (n1, n2) == (len(of[m, c, s]), len(y)) and (ks, emd) == (pytest.approx(want[0], abs=1e-8), pytest.approx(want[1], abs=1e-8))
