"""Closed forms, invariants and small brute-force twins for what SQL does not express."""

import hashlib
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlore.functions import special as S
from pointlore.operators import catalog as K
from pointlore.operators import curves as D
from pointlore.operators import envelopes as E
from pointlore.operators import expressions as B
from pointlore.operators import geometry as C
from pointlore.operators import mixture as H
from pointlore.operators import occupancy as G
from pointlore.operators import profiles as P
from pointlore.operators import twosample as T
from pointlore.plans import workflows as Q
from pointlore.plans.space_queries import sphere
from pointlore.sources import files as A


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)


def both(spark, a, b):
    return frame(spark, [("k", 0, float(x)) for x in a] + [("k", 1, float(x)) for x in b], "k string, side int, value double")


@pytest.mark.parametrize("shift", [0.0, 1.0, 5.0])
def test_emd_shift(spark, shift):
    a = np.linspace(0, 10, 50)
    r = T.emd(both(spark, a, a + shift), ["k"], "side").first()
    assert r["emd"] == pytest.approx(shift, abs=1e-9)


def test_emd_unequal_and_symmetric(spark):
    g = np.random.default_rng(1)
    a, b = g.exponential(2, 70), g.uniform(0, 3, 41)
    x, y = (T.emd(both(spark, p, q), ["k"], "side").first() for p, q in ((a, b), (b, a)))
    every = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(v), every, "right") / len(v) for v in (a, b))
    assert x["emd"] == pytest.approx(y["emd"])
    assert x["emd"] == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(every)))
    assert x["ks"] == pytest.approx(np.abs(fa - fb).max())


def test_ks_exact_by_enumeration():
    n, m = 4, 3
    for d in (1 / 3, 0.5, 2 / 3, 0.75, 1.0):
        hits = total = 0
        for pick in itertools.combinations(range(n + m), n):
            fa = np.cumsum([1 / n if i in pick else 0 for i in range(n + m)])
            fb = np.cumsum([0 if i in pick else 1 / m for i in range(n + m)])
            hits += np.abs(fa - fb).max() >= d - 1e-9
            total += 1
        # The statistic takes multiples of 1 / lcm; d is one of them or rounds to the next.
        if round(d * 12) == d * 12:
            assert S._ks_exact(d, n, m) == pytest.approx(hits / total, abs=1e-12)
    assert S._ks_exact(0.0, 5, 5) == 1.0


def test_student_tail():
    assert S._beta_tail(1 / (1 + 1.0), 0.5, 0.5) == pytest.approx(0.5)  # one degree of freedom, t = 1
    assert S._beta_tail(10 / (10 + 2.228**2), 5.0, 0.5) == pytest.approx(0.05, abs=1e-4)


def test_nnls_finds_the_generator():
    g = np.random.default_rng(3)
    a = g.uniform(0, 1, (40, 4))
    for truth in ([1.0, 0, 2.0, 0], [0, 0, 0, 3.0], [0.5, 0.5, 0.5, 0.5]):
        b = a @ np.array(truth)
        assert np.allclose(S.nnls_small(a.T @ a, a.T @ b), truth, atol=1e-8)
    c = S.nnls_small(a.T @ a, -(a.T @ np.ones(40)))
    assert (c == 0).all()


def test_rank_envelope_extremes(spark):
    g = np.random.default_rng(42)
    sims = np.sort(g.uniform(0, 1, (99, 50)), axis=1)
    rows = [("k", str(c), i, float(y)) for c, curve in enumerate(sims) for i, y in enumerate(curve)]
    s = frame(spark, rows, "k string, curve_id string, i int, y double")
    for shift, sign, p in ((None, None, None), (1.0, 1, 0.01), (-1.0, -1, 0.01)):
        obs = sims.mean(0) if shift is None else (sims.max(0) + 1 if shift > 0 else sims.min(0) - 1)
        o = frame(spark, [("k", i, float(y)) for i, y in enumerate(obs)], "k string, i int, y double")
        t, bounds = E.rank_envelope(o, s, ["k"])
        r = t.first()
        if shift is None:
            assert r["p_value"] > 0.05
            assert bounds.filter("lo > hi").count() == 0
        else:
            assert (r["sign"], r["p_value"]) == (sign, pytest.approx(p))


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    q = E.bh_qvalues(frame(spark, [("k", str(i), x) for i, x in enumerate(p)], "k string, id string, p double"), "p", ["k"], ["id"])
    got = [r["q_value"] for r in q.orderBy("id").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_valid_samples_rules(spark):
    s = frame(spark, [("m", "a", "c", "0", v) for v in (1.0, float("nan"), float("inf"), -float("inf"), None, -5.0)] + [("m", "b", "c", "0", float("nan"))], "measure string, mode string, cell_id string, seed string, value double")
    kept, empty = B.filter_samples(s, -1.0)
    assert [r["value"] for r in kept.collect()] == [1.0]
    assert [r["mode"] for r in empty.collect()] == ["b"]


def test_interp_like_numpy(spark):
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, 2.0, 5.0])
    at = np.array([-1.0, 0.0, 0.5, 1.0, 2.0, 4.0, 9.0])
    c = frame(spark, [("k", i, a, b) for i, (a, b) in enumerate(zip(x, y))], "k string, i int, x double, y double")
    g = frame(spark, [("k", i, a) for i, a in enumerate(at)], "k string, i int, x double")
    for outside, left, right in (("clamp", 1.0, 5.0), ("zero", 0.0, 0.0)):
        got = [r["y"] for r in D.interp(c, g, ["k"], ["k"], outside).orderBy("i").collect()]
        assert got == pytest.approx(np.interp(at, x, y, left, right).tolist())
    assert D.interp(c, g, ["k"], ["k"], "null").filter("y is null").count() == 2


def test_pdf_integral_and_kde_small(spark):
    g = np.random.default_rng(0)
    s = frame(spark, [("m", float(v)) for v in g.normal(5, 1, 300)] + [("t", 1.0), ("t", 2.0)], "measure string, value double")
    grid = D.r_grid(s, ["measure"], bin_width=0.2)
    pdf = D.histogram_pdf(s, grid, ["measure"], ["measure"], 0.2, 1.0)
    for m in ("m", "t"):
        rows = pdf.filter(F.col("measure") == m).orderBy("i").collect()
        assert np.trapezoid([r["y"] for r in rows], [r["x"] for r in rows]) == pytest.approx(1)
    assert D.kde(s, grid, ["measure"], ["measure"]).filter("measure = 't' and y <> 0").count() == 0


def test_occupancy_of_equal_distributions_is_one(spark):
    g = np.random.default_rng(42)
    v = g.exponential(3, 3000)
    av = frame(spark, [("d", "S1", "c", float(x)) for x in v], "measure string, structure_id string, cell_id string, value double")
    s = frame(spark, [("d", "a", "c", "0", float(x)) for x in v], "measure string, mode string, cell_id string, seed string, value double")
    occ, avail, _ = G.occupied_available(s, av, frame(spark, [("a", "S1")], "mode string, structure_id string"), pixel=None)
    rows = G.binned_occupancy(occ, avail, 0.5).collect()
    assert any(r["occupancy"] is None for r in rows)  # sparse bins are masked
    assert all(r["occupancy"] == pytest.approx(1.0) for r in rows if r["occupancy"] is not None)


def test_mixture_recovers_the_true_mode(spark):
    g = np.random.default_rng(0)
    x = np.linspace(0, 5, 50)
    true, noise = np.exp(-0.5 * x) + 0.1, g.uniform(0, 2, 50)
    occ = frame(spark, [("d", "base", f"c{c}", i, float(a), float(b)) for c in range(10) for i, (a, b) in enumerate(zip(x, true))], "measure string, mode string, cell_id string, i int, x double, occupancy double")
    comb = frame(spark, [("d", m, i, float(a), float(b)) for m, y in (("base", true), ("t", true), ("n", noise), ("h", true * 2)) for i, (a, b) in enumerate(zip(x, y))], "measure string, mode string, i int, x double, occupancy double")
    cv = H.cross_validate(occ, comb, ["t", "n"], "base", 5, 2)
    coefs = {(r["scope"], r["mode"]): r for r in H.cv_summary(cv)[0].collect()}
    assert coefs["joint", "t"]["share_mean"] > 0.99
    folds = cv["folds"].groupBy("repeat", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [2] * 10
    three, mse = H.fit_mixture(comb.filter("mode = 'base'").select("measure", "i", F.col("occupancy").alias("b")), H.design(comb, H.baseline_grid(comb, "base"), ["t", "n", "h"]), ["t", "n", "h"], [])
    assert mse.filter("mse > 1e-9").count() == 0
    assert three.filter("coef < 0").count() == 0


def test_information_criteria_known(spark):
    r = H.information_criteria(frame(spark, [(100, 2, 50.0), (3, 2, 1.0)], "n int, k int, rss double")).orderBy("n").collect()
    assert r[0]["aicc"] == math.inf
    assert r[1]["aic"] == pytest.approx(100 * math.log(0.5) + 6)
    assert r[1]["bic"] == pytest.approx(100 * math.log(0.5) + 3 * math.log(100))


def test_spheres(spark):
    cells = frame(spark, [("c", 10.0)], "cell_id string, radius double")
    tri = sphere(spark, cells, 3)
    axes = [(1, 0, 0), (0, -1, 0), (0, 0, 1)]
    rows = [("c", i * 10 + j, *[float(a * (5 + 5 * f)) for a in ax]) for i, ax in enumerate(axes) for j, f in enumerate((0.1, 0.5, 0.9))] + [("c", 90, 2.0, 0.0, 0.0), ("c", 91, 12.0, 0.0, 0.0)]
    p = frame(spark, rows, "cell_id string, point_id int, x double, y double, z double")
    got = {r["point_id"]: r["scaled_distance"] for r in C.scaled_surface_distance(p, tri).collect()}
    assert got[90] is None and got[91] is None
    for k, v in got.items():
        if k < 90:
            assert v == pytest.approx((0.1, 0.5, 0.9)[k % 10], abs=0.05)
    mem = {r["point_id"]: r for r in C.surface_distance(p, tri, surface="mem").collect()}
    nuc = {r["point_id"]: r for r in C.surface_distance(p, tri, surface="nuc").collect()}
    assert mem[91]["distance"] == pytest.approx(-2, abs=0.1) and not mem[91]["inside"]
    assert nuc[90]["distance"] == pytest.approx(-3, abs=0.1) and nuc[0]["distance"] == pytest.approx(0.5, abs=0.1)


def test_names_and_positions(spark, tmp_path):
    f = frame(spark, [("results_p_c_743916_seed_1",), ("results_p_c_743916",), ("results_p_c_743916_seed_2_seed_9",)], "s string")
    assert [r[0] for r in f.select(B.cell_id_from_stem(F.col("s"), "p", "c")).collect()] == ["743916", "743916", "743916_seed_2"]
    (tmp_path / "a.json").write_text('{"7": {"dot": [[1, 2, 3]]}, "8_4": {"dot": [[1, 1, 1], [2, 2, 2]]}}')
    got = sorted(tuple(r) for r in A.read_points(spark, str(tmp_path / "a.json"), "dot").collect())
    assert got == [("7", "0", 0, 1.0, 2.0, 3.0), ("8", "4", 0, 1.0, 1.0, 1.0), ("8", "4", 1, 2.0, 2.0, 2.0)]
    with pytest.raises(Exception, match="no ingredient"):
        A.read_points(spark, str(tmp_path / "a.json"), "other").collect()
    for n in ("positions_rule_1.json", "positions_rule_2.json", "positions_rule_invert_3.json"):
        (tmp_path / n).write_text('{"0": {"dot": [[1, 2, 3]]}}')
    assert {r["cell_id"] for r in A.read_point_files(spark, str(tmp_path), "rule", "dot").collect()} == {"1", "2"}


def test_pad_and_binary_correlation(spark):
    a = frame(spark, [(1, [1.0]), (2, []), (3, [1.0, 2.0, 3.0])], "k int, v array<double>")
    assert {r["k"]: r["v"] for r in D.pad_arrays(a, "v").collect()} == {1: [1.0, None, None], 2: [None] * 3, 3: [1.0, 2.0, 3.0]}
    g = np.random.default_rng(5)
    m = g.normal(size=(4, 20))
    p = frame(spark, [(r, i, float(v)) for r, row in enumerate(m) for i, v in enumerate(row)], "profile_id int, i int, value double")
    got = {(r["id_1"], r["id_2"]): r["r"] for r in P.binary_correlation(p).collect()}
    want = np.corrcoef((m[:, 10:] > 0).astype(float))
    for (i, j), r in got.items():
        assert r == pytest.approx(want[i, j])
    assert len(got) == 10


def test_column_metadata_and_missing_work(spark):
    from pointlore.operators import catalog as K

    df = frame(spark, [("a", 1.0)], "CellId string, radius double")
    rows = {r["column"]: (r["type"], r["description"]) for r in K.column_metadata(df, {"radius": "unit radius"}).collect()}
    assert rows == {"CellId": ("string", ""), "radius": ("double", "unit radius")}
    expected = frame(spark, [("x", 1), ("x", 2), ("y", 1)], "item string, seed int")
    missing, done = K.missing_work(expected, frame(spark, [("x", 1), ("y", 1), ("y", 1)], "item string, seed int"))
    assert [(r["item"], r["seed"]) for r in missing.collect()] == [("x", 2)]
    assert {r["item"]: r["done"] for r in done.collect()} == {"x": False, "y": True}


def test_norm_factor_errors(spark):
    df = frame(spark, [("d", 0.0), ("scaled_d", 0.0)], "measure string, f double")
    ok = df.filter("measure = 'scaled_d'").select(B.norm_factor("intracellular_radius", F.col("measure"), F.col("f")).alias("x"))
    assert ok.first()["x"] == 1.0
    with pytest.raises(Exception, match="no factor"):
        df.select(B.norm_factor("intracellular_radius", F.col("measure"), F.col("f")).alias("x")).collect()


def test_components_of_voxels(spark):
    v = frame(spark, [("i", "c", 1, *p) for p in [(0, 0, 0), (1, 1, 1), (2, 2, 2), (5, 5, 5), (5, 6, 5), (9, 9, 9)]], "image_id string, channel string, value int, x int, y int, z int")
    c, _ = C.component_centroids(v)
    got = sorted((r["size"], r["largest"], r["cx"]) for r in c.collect())
    assert got == [(1, False, 9.0), (2, False, 5.0), (3, True, 1.0)]


# --- rank tests ------------------------------------------------------------------------------------


def _rank_sum_by_enumeration(a, b):
    """Two-sided p of untied samples: every way to choose which values are a's."""
    every = sorted(a + b)
    u = lambda one: sum(x > y for x in one for y in every if y not in one)
    n, m = len(a), len(b)
    seen = u(set(a))
    tail = max(seen, n * m - seen)
    counts = [u(set(c)) for c in itertools.combinations(every, n)]
    return min(1.0, 2 * sum(c >= tail for c in counts) / len(counts))


def _signed_rank_by_enumeration(d):
    order = sorted(map(abs, d))
    ranks = [order.index(abs(x)) + 1 for x in d]
    seen = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    return min(1.0, 2 * sum(s <= seen for s in sums) / len(sums))


def test_exact_rank_tests(spark):
    rng = np.random.default_rng(11)
    groups = {f"g{n}_{m}": (rng.normal(0, 1, n).round(9).tolist(), rng.normal(0.8, 1, m).round(9).tolist()) for n, m in [(1, 1), (1, 7), (3, 4), (5, 5), (8, 6), (6, 8), (2, 12)]}
    rows = [(g, s, v) for g, (a, b) in groups.items() for s, x in (("a", a), ("b", b)) for v in x]
    rows += [("lone", "a", 1.0), ("tied", "a", 1.0), ("tied", "b", 1.0), ("tied", "b", 2.0)] + [("big", "ab"[i % 2], float(i * i % 977)) for i in range(100)]
    got = {r["k"]: r for r in T.mann_whitney(spark.createDataFrame(rows, "k string, side string, value double"), "side", "a", "b", keys=["k"]).collect()}
    for g, (a, b) in groups.items():
        assert got[g]["p_value"] == pytest.approx(_rank_sum_by_enumeration(a, b), abs=1e-12), g
        assert got[g]["u"] == sum(x > y for x in a for y in b)
    assert got["lone"]["p_value"] is None and got["lone"]["rank_biserial"] is None
    # Tied: normal with corrections; z from U = 0.5 of 2 pairs.
    assert 0 < got["tied"]["p_value"] <= 1 and got["big"]["p_value"] == pytest.approx(math.erfc(max(got["big"]["z"], 0) / math.sqrt(2)), abs=1e-12)


def test_exact_signed_ranks(spark):
    rng = np.random.default_rng(12)
    groups = {f"g{n}": rng.normal(0.4, 1, n).round(9).tolist() for n in (1, 2, 3, 6, 11, 14)}
    rows = [(g, x + 5, 5.0) for g, d in groups.items() for x in d]
    rows += [("zeros", 2.0, 2.0), ("zeros", 1.0, 1.0)] + [("mixed", float(v), 0.0) for v in (0, 1, -2, 3, 4)] + [("tied", float(v), 0.0) for v in (1, -1, 2)] + [("even", 1.0, 0.0), ("even", -1.0, 0.0)] + [("big", float(i % 7 - 2) + i / 1000, 0.0) for i in range(60)]
    got = {r["k"]: r for r in T.wilcoxon(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ["k"]).collect()}
    for g, d in groups.items():
        p = _signed_rank_by_enumeration([x + 5 - 5.0 for x in d])
        assert got[g]["p_value"] == pytest.approx(p, abs=1e-12), g
        z = NormalDist().inv_cdf(1 - p / 2) if p < 1 else 0.0
        assert got[g]["effect"] == pytest.approx((-1 if np.mean(d) < 0 else 1) * z / math.sqrt(len(d)), abs=1e-9)
    assert (got["zeros"]["statistic"], got["zeros"]["p_value"], got["zeros"]["effect"]) == (0.0, None, None)
    # A zero turns to the normal p, and counts as a pair in the effect.
    z = (2 - 5) / math.sqrt(4 * 5 * 9 / 24)
    assert got["mixed"]["p_value"] == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=1e-12)
    assert got["mixed"]["effect"] == pytest.approx(-z / math.sqrt(5), abs=1e-9)
    assert got["even"]["effect"] == pytest.approx(0.0, abs=1e-9) and got["even"]["p_value"] == pytest.approx(1.0)
    assert got["big"]["p_value"] == pytest.approx(math.erfc(abs(got["big"]["z"]) / math.sqrt(2)), abs=1e-12)


def test_rank_sum_counts_of_uneven_sides():
    """The counted tail against the recurrence over sizes."""
    from functools import lru_cache

    from pointlore.functions import special

    @lru_cache(None)
    def ways(n, m, u):
        if u < 0 or n < 0 or m < 0:
            return 0
        return 1 if u == 0 and (n == 0 or m == 0) else 0 if n == 0 or m == 0 else ways(n - 1, m, u - m) + ways(n, m - 1, u)

    for n, m in [(1, 30), (4, 17), (8, 25)]:
        for u in (0, 1, n * m // 3, n * m // 2):
            assert special._rank_sum_tail(u, n, m) == sum(ways(n, m, k) for k in range(u + 1))


# --- files in blocks -------------------------------------------------------------------------------


def test_meshes_in_blocks(spark, tmp_path):
    """A file far larger than a block is read by several tasks, with the same vertices and triangles."""
    rng = np.random.default_rng(20)
    vertices = rng.normal(0, 1, (40_000, 3)).round(6)
    faces = [rng.choice(len(vertices), rng.integers(3, 6), replace=False) + 1 for _ in range(30_000)]
    lines = ["# a mesh", *[f"v {x} {y} {z}" for x, y, z in vertices[:20_000]], "vn 0 0 1", *["f " + " ".join(f"{c}/1/1" for c in f) for f in faces[:10]], *[f"v  {x}\t{y} {z} " for x, y, z in vertices[20_000:]], *["f " + " ".join(map(str, f)) for f in faces[10:]]]
    (tmp_path / "big.obj").write_text("\r\n".join(lines))
    (tmp_path / "small.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        assert spark.read.text(str(tmp_path / "*.obj")).rdd.getNumPartitions() > 8
        v, t = A.read_meshes(spark, str(tmp_path / "*.obj"))
        got = {(r["file"].rpartition("/")[2], r["vertex"]): (r["x"], r["y"], r["z"]) for r in v.collect()}
        tri = sorted((r["file"].rpartition("/")[2], r["tri_id"], *[(r[f"{k}x"], r[f"{k}y"], r[f"{k}z"]) for k in "abc"]) for r in t.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("big.obj", i + 1): tuple(p) for i, p in enumerate(vertices.tolist())} | {("small.obj", 1): (0, 0, 0), ("small.obj", 2): (1, 0, 0), ("small.obj", 3): (0, 1, 0)}
    at = lambda c: tuple(vertices[c - 1].tolist())
    want = [("big.obj", (n << 32) + k, at(f[0]), at(f[k]), at(f[k + 1])) for n, f in enumerate(faces) for k in range(1, len(f) - 1)]
    assert tri == sorted(want + [("small.obj", 1, (0, 0, 0), (1, 0, 0), (0, 1, 0))])


def test_histogram_last_bin_ends_half_a_width_beyond_its_point(spark):
    """Edges -0.5, 1.5, 3.5 and 4.5: what lies between 4.5 and the next step, 5.5, is outside."""
    grid = frame(spark, [("m", i, 2.0 * i, 0.0, 2.0, 3) for i in range(3)], "measure string, i int, x double, x0 double, step double, n int")
    s = frame(spark, [("m", v) for v in (-0.5, 1.5, 3.4, 3.5, 4.5, 4.6, 5.4, 5.5)], "measure string, value double")
    got = {r["i"]: r["y"] for r in D.histogram(s, grid, ["measure"], ["measure"], 1.0).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0}


def test_metric_histogram_value_on_an_edge(spark):
    """32931.52 is the eighth edge, 931.52 + 8 * 4000, though its distance from 931.52 is a little less than 32000."""
    c = frame(spark, [("k", v) for v in (931.52, 32931.52, 40000.0)], "k string, v double")
    got = {r["bin"]: r["count"] for r in K.metric_histogram(c, "v", ["k"], 4000.0).collect()}
    assert (got[7], got[8]) == (0, 1) and sum(got.values()) == 3


@pytest.mark.parametrize("n, v", [(20, 0.21), (50, 0.11)])
def test_quantile_of_equal_values_is_their_value(spark, n, v):
    """To the last bit: edges of bins are made from it, and values lie on them."""
    s = frame(spark, [("m", v)] * n, "measure string, value double")
    assert D.exact_quantile(s, ["measure"], "value", 0.995, "q").first()["q"] == v


def test_bootstrap_lists_draws_in_stretches(spark, monkeypatch):
    """Stretches change no draw."""
    rows = [("m", "b", mode, str(c), "0", (c * k) % 3 == 0) for c in range(25) for k, mode in enumerate(("p", "q"), 1)]
    ks = frame(spark, rows, "measure string, baseline string, mode string, cell_id string, seed string, similar boolean")
    got = []
    for size in (4, 10_000):
        monkeypatch.setattr(T, "DRAWS", size)
        got.append(sorted(tuple(r) for r in T.ks_bootstrap(ks, 5).collect()))
    assert got[0] == got[1] and len(got[0]) == 10


def test_bootstrap_broadcasts_no_draws(spark):
    """A key has a row for each stretch of its draws, and 30 times as many draws: they are shuffled to the cells, which no window numbers."""
    rows = [("m", "b", mode, f"{c:03d}", (c * k) % 3 == 0) for c in range(300) for k, mode in enumerate(("p", "q"), 1) if (c + k) % 7]
    out = T.ks_bootstrap(frame(spark, rows, "measure string, baseline string, mode string, cell_id string, similar boolean"), 4)
    got = {(r["mode"], r["experiment_number"]): r["similar_fraction"] for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "Join [" in line and "_no#" in line and "ShuffledHashJoin" not in line] == []
    assert "ShuffledHashJoin" in plan and "Window" not in plan
    for e in range(4):
        drawn = [f"{int(hashlib.md5(f'm|b|{e}|{j}'.encode()).hexdigest()[:8], 16) % 300:03d}" for j in range(300)]
        for mode in "pq":
            of = {c: s for _, _, m, c, s in rows if m == mode}
            assert got[mode, e] == pytest.approx(np.mean([of[c] for c in drawn if c in of]))


def test_own_envelopes_make_no_test(spark, monkeypatch):
    """The envelopes of the modes come without curves of tests, and are those that the whole test gives."""
    g = np.random.default_rng(3)
    s = frame(spark, [("m", m, str(c), "0", float(v)) for m in "ab" for c in range(3) for v in g.uniform(size=9)], "measure string, mode string, cell_id string, seed string, value double")
    whole = E.pairwise_envelope_test(s, n=10)[2].orderBy("mode", "i").collect()
    monkeypatch.setattr(E, "pairwise_curve_test", None)
    own = E.own_envelopes(s, n=10).orderBy("mode", "i").collect()
    assert own == whole and len(own) == 20


def test_curves_are_laid_out_without_windows(spark):
    """One row a curve: neither the running shares nor the even curves sort points in windows."""
    s = frame(spark, [("m", "a", v) for v in (0.1, 0.5, 0.5, 2.0)], "measure string, mode string, value double")
    grid = D._grid(frame(spark, [("m", 3, 0.0, 1.0)], "measure string, n int, x0 double, x1 double"), ["measure"])
    c = D.ecdf(s, grid, ["measure", "mode"], ["measure"])
    assert [(r["x"], r["y"]) for r in c.orderBy("i").collect()] == [(0.0, 0.0), (0.5, 0.75), (1.0, 0.75)]
    even = D.unit_curves(c, ["measure", "mode"], 5)
    assert [r["y"] for r in even.orderBy("i").collect()] == [0.0, 0.375, 0.75, 0.75, 0.75]
    assert "Window" not in even._jdf.queryExecution().executedPlan().toString()


def test_envelope_of_folded_values(spark):
    y = [0.25] * 5 + [0.5] * 3 + [1.0]
    c = frame(spark, [("m", 0, 0.0, v) for v in y], "measure string, i int, x double, y double")
    r = D.pointwise_envelope(c, ["measure"], 0.1).first()
    assert [r["lo"], r["hi"], r["mean"], r["sd"]] == pytest.approx([np.quantile(y, 0.05), np.quantile(y, 0.95), np.mean(y), np.std(y, ddof=1)])


def test_facts_of_pairs_join_the_profiles(spark):
    """The pairs meet no other table, and carry the facts of both sides."""
    df = frame(spark, [(p, i, float((p * 7 + i * i) % 3 - 1)) for p in range(5) for i in range(12)], "profile_id long, i int, value double")
    ids = frame(spark, [(p, f"s{p % 2}", "r", str(p)) for p in range(5)], "profile_id long, structure string, rule string, cell_id string")
    pairs = P.correlation_pairs(df, ids)
    want = {(r["id_1"], r["id_2"]): r["r"] for r in P.binary_correlation(df).collect()}
    got = {(r["id_1"], r["id_2"]): r["r"] for r in pairs.collect()}
    assert got == want and len(got) == 15
    assert all((r["structure_1"], r["cell_id_2"]) == (f"s{r['id_1'] % 2}", str(r["id_2"])) for r in pairs.collect())
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_copies_of_profiles_are_not_broadcast(spark):
    """A profile has a copy for each block that it meets: their number grows with the square of the table. All pairs are there, whatever the blocks."""
    g = np.random.default_rng(9)
    m = g.normal(size=(30, 140))
    df = frame(spark, [(r, i, float(v)) for r, row in enumerate(m) for i, v in enumerate(row)], "profile_id int, i int, value double")
    pairs = P.binary_correlation(df, block=3)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r["id_1"], r["id_2"]): r["r"] for r in pairs.collect()}
    want = np.corrcoef((m[:, 70:] > 0).astype(float))
    assert set(got) == {(i, j) for i in range(30) for j in range(i, 30)}
    assert all(r == pytest.approx(want[i, j]) for (i, j), r in got.items())
    long = frame(spark, [(r, i, float(m[r, i % 140] * (1 if i < 1200 else -1))) for r in range(4) for i in range(2200)], "profile_id int, i int, value double")
    wide = {(r["id_1"], r["id_2"]): r["r"] for r in P.binary_correlation(long).collect()}
    want = np.corrcoef([[m[r, i % 140] * (1 if i < 1200 else -1) > 0 for i in range(1100, 2200)] for r in range(4)])
    assert len(wide) == 10 and all(r == pytest.approx(want[i, j]) for (i, j), r in wide.items())


def test_histogram_keeps_samples_without_a_value_inside(spark):
    """A sample whose values all lie outside is counted as 0 everywhere; its points meet no join with the samples."""
    grid = D._grid(frame(spark, [("m", 3, 0.0, 2.0)], "measure string, n int, x0 double, x1 double"), ["measure"])
    s = frame(spark, [("m", "a", 0.0), ("m", "a", 2.0), ("m", "b", 9.0), ("m", "c", None), ("m", None, 1.0), ("z", "a", 1.0)], "measure string, mode string, value double")
    h = D.histogram(s, grid, ["measure", "mode"], ["measure"], 1.0)
    got = {(r["mode"], r["i"]): (r["x"], r["y"]) for r in h.collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == {("a", 0): 1.0, ("a", 2): 1.0}
    assert len(got) == 12 and all(v[0] == float(k[1]) for k, v in got.items())
    assert h._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def monte_carlo_rows(df):
    return sorted((r["measure"], r["mode"], r["cell_id"], r["sign"], round(r["statistic"], 6), round(r["p_value"], 9)) for r in df.collect())


@pytest.mark.parametrize("statistic", ["integrated", "supremum"])
def test_cells_are_tested_as_rows_of_their_own(spark, statistic, monkeypatch):
    """Whole cells and cells spread over rows give the same tests; a run without a measure has a curve of 0 there."""
    g = np.random.default_rng(11)
    obs = [(m, c, float(v)) for m in ("p", "q") for c in ("1", "2") for v in g.gamma(2, size=12) if (m, c) != ("q", "2")]
    sims = [(m, mode, c, str(r), float(v)) for m in ("p", "q") for mode in "ab" for c in ("1", "2", "3") for r in range(4) for v in g.gamma(2 if mode == "a" else 5, size=9) if (m, r) != ("q", 3)]
    obs, sims = frame(spark, obs, "measure string, cell_id string, value double"), frame(spark, sims, "measure string, mode string, cell_id string, seed string, value double")
    spread = monte_carlo_rows(E.monte_carlo_per_cell(obs, sims, 10, statistic, whole=0))
    mixed = monte_carlo_rows(E.monte_carlo_per_cell(obs, sims, 10, statistic, whole=130))
    monkeypatch.setattr(E, "_monte_carlo_rows", None)
    assert monte_carlo_rows(E.monte_carlo_per_cell(obs, sims, 10, statistic)) == spread == mixed
    assert len(spread) == 10


def test_tables_of_an_analysis_are_made_when_asked_for(spark, monkeypatch):
    """Rejection rates need no distances of all pairs of samples."""
    monkeypatch.setattr(Q.T, "emd_all_pairs", None)
    g = np.random.default_rng(5)
    s = frame(spark, [("m", m, str(c), "0", float(v)) for m in "ab" for c in range(3) for v in g.uniform(size=9)], "measure string, mode string, cell_id string, seed string, value double")
    out = Q.variation_analysis(s, "a", n_grid=10)
    assert {"pdfs", "emd", "emd_views", "emd_summary", "ks", "tests", "rates", "envelopes"} <= set(out)
    assert out["rates"].count() == 4


def test_distances_in_ranges_are_those_of_whole_samples(spark):
    """Samples cut into ranges, one without a value in most of them, give the distances that sorting them whole does."""
    g = np.random.default_rng(7)
    values = {"a": g.uniform(size=40), "b": g.uniform(size=23) * 2, "c": np.array([0.4, 0.4, 0.41])}
    s = frame(spark, [("m", k, "1", "0", float(v)) for k, vs in values.items() for v in vs], "measure string, mode string, cell_id string, seed string, value double")
    for size in (4, 1000):
        got = {(r["mode_1"], r["mode_2"]): r["emd"] for r in T.emd_all_pairs(s, range_values=size).collect()}
        for (x, y), d in got.items():
            every = np.sort(np.concatenate([values[x], values[y]]))
            apart = [np.searchsorted(np.sort(values[k]), every, "right") / len(values[k]) for k in (x, y)]
            assert d == pytest.approx((np.abs(apart[0] - apart[1])[:-1] * np.diff(every)).sum())
        assert len(got) == 3


def test_pairs_of_points_meet_in_blocks(spark):
    """Every pair once, whatever the blocks."""
    p = frame(spark, [("a", "1", "0", k, float(k), 0.0, 0.0) for k in range(30)], "mode string, cell_id string, seed string, point_id long, x double, y double, z double")
    got = sorted((r["point_1"], r["point_2"], r["value"]) for r in C.pairwise_distances(p, block=7).collect())
    assert got == [(a, b, float(b - a)) for a in range(30) for b in range(a + 1, 30)]


def test_copies_of_profiles_follow_the_profiles(spark, monkeypatch):
    """Many profiles lie in wider blocks, not in more of them; all pairs are there."""
    laid, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, label="table": laid.append(write(df, label)) or laid[-1])
    rows = [(p, i, float((p * 7 + i * i) % 5 - 2)) for p in range(120) for i in range(12)]
    pairs = P.binary_correlation(frame(spark, rows, "profile_id int, i int, value double"), block=1, most=9)
    got = {(r["id_1"], r["id_2"]): r["r"] for r in pairs.collect()}
    assert laid[-1].select("own").distinct().count() <= 9
    assert set(got) == {(i, j) for i in range(120) for j in range(i, 120)}


def test_coefficients_are_rounded_without_decimals(spark):
    """All correlations of 32 positions and what lies near a tie: arithmetic gives the bits that the decimal gives."""
    from pointlore.model import r6, r6_unit

    n = spark.range(33 * 33 * 33).select((F.col("id") % 33).alias("a"), (F.floor(F.col("id") / 33) % 33).alias("b"), F.floor(F.col("id") / 1089).alias("k"))
    r = n.filter("k <= a and k <= b").select(F.try_divide(32.0 * F.col("k") - F.col("a") * F.col("b"), F.sqrt((F.col("a") * (32 - F.col("a")) * F.col("b") * (32 - F.col("b"))).cast("double"))).alias("r"))
    ties = spark.createDataFrame([(x * s,) for x in (1 / 128, 3 / 128, 0.0, 1.0, 0.1234564, 0.1234566, 1e-7) for s in (1, -1)], "r double")
    both = r.unionByName(ties).select("r", r6("r").alias("x"), r6_unit("r").alias("y"))
    assert both.filter("not (x <=> y)").collect() == [] and both.filter("y is not null").count() > 5000
    plan = r.select(r6_unit("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


def test_copies_of_points_are_not_broadcast(spark):
    """Pairs of blocks keep their tasks where a key is a constant, and no copy of a point is broadcast."""
    p = frame(spark, [("a", "1", k, float(k), 0.0, 0.0) for k in range(40)], "mode string, cell_id string, point_id long, x double, y double, z double").withColumn("seed", F.lit("0"))
    pairs = C.pairwise_distances(p, block=4)
    assert pairs.count() == 780
    tasks = pairs.select(F.spark_partition_id().alias("t")).distinct().count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join [" in line and "point_id" in line and "<" in line]
    assert tasks >= 3 and met and all("SortMergeJoin" in line for line in met)


def test_values_of_samples_are_folded_once(spark, monkeypatch):
    """Of all tables that distances of pairs write, two read the samples: their names, and their values with counts."""
    g = np.random.default_rng(8)
    s = frame(spark, [("m", k, "1", "0", float(v)) for k in "abc" for v in g.uniform(size=40)], "measure string, mode string, cell_id string, seed string, value double")
    read, write = [], T.written
    monkeypatch.setattr(T, "written", lambda df, label="table": read.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")) or write(df, label))
    pairs = T.emd_all_pairs(s, range_values=7)
    assert pairs.count() == 3 and sum(read) == 2


def test_rank_test_spreads_a_point_over_ranges(spark, monkeypatch):
    """A point has a row for each curve: its rows fill as many ranges as their number asks for, ties too, and no window holds them all."""
    from pointlore.functions import storage

    g = np.random.default_rng(4)
    n, m, points = 60, 9, 5
    sims, seen = g.integers(0, 6, (n, points)) / 4, g.integers(-1, 7, (m, points)) / 4
    long = lambda y, name: [("k", f"{name}{c:02d}", i, float(v)) for c, row in enumerate(y) for i, v in enumerate(row)]
    schema, ranges, write = "k string, curve_id string, i int, y double", [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, label="table": ranges.append(write(df, label)) or ranges[-1])
    before = storage.running_before
    monkeypatch.setattr(E, "running_before", lambda *a: before(*a, size=20))
    got = {r["curve_id"]: (r["sign"], r["statistic"], r["p_value"]) for r in E.rank_test(frame(spark, long(seen, "o"), schema), frame(spark, long(sims, "s"), schema), ["k"]).collect()}
    laid = next(r for r in ranges if "_range" in r.columns and "i" in r.columns)
    assert laid.groupBy("i").agg(F.countDistinct("_range").alias("n")).agg(F.min("n")).first()[0] >= 3
    low = np.array([[sum((sims[d, i], d) < (sims[c, i], c) for d in range(n)) + 1 for i in range(points)] for c in range(n)])
    for k, y in enumerate(seen):
        b = (sims < y).sum(0)
        push = y <= sims  # an observed value stands before equal simulated ones
        up = np.mean(y - sims.mean(0)) >= 0
        own = (n - b).min() + 1 if up else b.min() + 1
        other = (n + 2 - low - push).min(1) if up else (low + push).min(1)
        assert got[f"o{k:02d}"] == (1 if up else -1, own, pytest.approx(((other <= own).sum() + 1) / (n + 1)))
    assert len(got) == m
