"""Queries of occupancy, mixtures, geometry and profiles (G, H, C, P) and the pipelines (Q)."""

import math

from pyspark.sql import functions as F

from ..functions.storage import shared_path, written
from ..model import ORACLE_SQL, AVAILABLE_ORDERS, CELLS_VEC, POINTS_VEC, SAMPLES_EVENTS, SAMPLES_ITEMS, SAMPLES_ORDERS, available_orders, cells_vec, modes_of, points_vec, query, r6, r6_unit, samples_events, samples_items, samples_orders, table
from ..operators import curves as D
from ..operators import envelopes as E
from ..operators import geometry as C
from ..operators import mixture as H
from ..operators import occupancy as G
from ..operators import profiles as P
from ..operators import twosample as T
from ..sources import files as A
from .curve_queries import KSKEYS, KSP, PAIRS, _cell_rates, _rates, base_sql, cell_rates_sql, e03_sql, grid_sql, hist_sql, norm_sql, pair_test_sql, walk_sql
from . import workflows as Q

W0 = 25.0
MIN_COUNT = 5

# --- occupancy -----------------------------------------------------------------------------------

OCC = f"""{SAMPLES_ORDERS}, {AVAILABLE_ORDERS}, {grid_sql('measure, structure_id, cell_id', w=W0, name='cg', source='available')},
{hist_sql('measure, structure_id, cell_id', 'measure, structure_id, cell_id', W0, 'ha', 'available', 'cg')},
occ AS (SELECT s.*, 'S1' AS structure_id FROM samples s JOIN (SELECT measure, cell_id, max(value) AS top FROM available GROUP BY ALL) USING (measure, cell_id) WHERE value <= top),
{hist_sql('measure, mode, cell_id, structure_id', 'measure, structure_id, cell_id', W0, 'ho', 'occ', 'cg')},
ha1 AS (SELECT measure, structure_id, cell_id, i, x, y AS raw_avail, y + 1e-10::DOUBLE AS yp FROM ha), {norm_sql('measure, structure_id, cell_id', 'pa', 'ha1', 'yp')},
ho1 AS (SELECT measure, mode, cell_id, i, x, y AS raw_occ, y + 1e-10::DOUBLE AS yp FROM ho), {norm_sql('measure, mode, cell_id', 'po', 'ho1', 'yp')},
cell AS (SELECT po.measure, po.mode, po.cell_id, po.i, po.x, CASE WHEN ha1.raw_avail >= {MIN_COUNT} THEN exp(ln(greatest(po.y, 1e-10)) - ln(greatest(pa.y, 1e-10))) END AS occupancy
FROM po JOIN pa USING (measure, cell_id, i) JOIN ha1 USING (measure, cell_id, i))"""

COMMON = f"""{OCC}, {grid_sql('measure', w=W0, name='mg', source='available')},
known AS (SELECT * FROM cell WHERE occupancy IS NOT NULL), seg AS (SELECT measure, mode, cell_id, x AS x0, occupancy AS y0, lead(x) OVER w AS x1, lead(occupancy) OVER w AS y1 FROM known WINDOW w AS (PARTITION BY measure, mode, cell_id ORDER BY i)),
common AS (SELECT c.measure, c.mode, c.cell_id, g.i, g.x, max(CASE WHEN g.x = s.x0 THEN s.y0 ELSE s.y0 + (s.y1 - s.y0) * (g.x - s.x0) / (s.x1 - s.x0) END) AS occupancy FROM (SELECT DISTINCT measure, mode, cell_id FROM cell) c JOIN mg g USING (measure)
LEFT JOIN seg s ON s.measure = c.measure AND s.mode = c.mode AND s.cell_id = c.cell_id AND g.x >= s.x0 AND (g.x <= s.x1 OR g.x = s.x0) GROUP BY ALL)"""


def _inputs(spark, d):
    s = samples_orders(spark, d)
    return s, available_orders(spark, d), modes_of(s)


def _binned(spark, d):
    return G.occupancy_binned(*_inputs(spark, d), width=W0, min_count=MIN_COUNT, pixel=None)


@query(f"WITH {OCC} SELECT measure, mode, cell_id, i, round(x, 6) + 0.0 AS x, round(occupancy, 5) + 0.0 AS occupancy FROM cell")
def g03_binned_occupancy(spark, d):
    occ, av, _ = G.occupied_available(*_inputs(spark, d), pixel=None)
    o = G.binned_occupancy(occ, av, W0, min_count=MIN_COUNT)
    return o.select("measure", "mode", "cell_id", "i", r6("x").alias("x"), (F.round("occupancy", 5) + 0.0).alias("occupancy"))


@query(f"WITH {SAMPLES_ITEMS}, c AS (SELECT DISTINCT 'S1' AS structure_id, cell_id FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY md5('cells|' || structure_id || '|' || cell_id), cell_id) AS o FROM c) SELECT structure_id, cell_id FROM r WHERE o <= 40")
def g01_cells_by_structure(spark, d):
    s = samples_items(spark, d)
    return G.cells_by_structure(s, modes_of(s), 40)


@query(f"""WITH {SAMPLES_EVENTS}, av AS (SELECT measure, cell_id, max(value) * 0.108 AS top FROM samples WHERE mode <> 'view' GROUP BY ALL)
SELECT s.measure, s.mode, s.cell_id, count(*) FILTER (value * 0.108 > top) AS beyond, max(top) IS NULL AS no_space FROM samples s LEFT JOIN av USING (measure, cell_id) GROUP BY ALL""")
def g02_occupied_available(spark, d):
    s = samples_events(spark, d)
    av = s.filter("mode <> 'view'").select("measure", F.lit("S1").alias("structure_id"), "cell_id", "value")
    return G.occupied_available(s, av, modes_of(s))[2].select("measure", "mode", "cell_id", "beyond", "no_space")


@query(f"WITH {SAMPLES_ORDERS}, {AVAILABLE_ORDERS}, {grid_sql('measure', w=W0, name='mg', source='available')} SELECT measure, i, round(x, 6) + 0.0 AS x FROM mg")
def g04_common_grid(spark, d):
    return G.common_grid(available_orders(spark, d), W0).select("measure", "i", r6("x").alias("x"))


@query(f"WITH {COMMON} SELECT measure, mode, cell_id, i, round(x, 6) + 0.0 AS x, round(occupancy, 5) + 0.0 AS occupancy FROM common")
def g05_occupancy_common(spark, d):
    c, _ = _binned(spark, d)
    return c.select("measure", "mode", "cell_id", "i", r6("x").alias("x"), (F.round("occupancy", 5) + 0.0).alias("occupancy"))


@query(f"""WITH {COMMON}, {hist_sql('measure, mode', 'measure', W0, 'pho', 'occ', 'mg')}, pho1 AS (SELECT measure, mode, i, x, y + 1e-10::DOUBLE AS y FROM pho), {norm_sql('measure, mode', 'ppo', 'pho1')},
{hist_sql('measure, cell_id', 'measure', W0, 'pha0', 'available', 'mg')}, pha1 AS (SELECT h.measure, m.mode, i, x, sum(y) + 1e-10::DOUBLE AS y FROM pha0 h JOIN (SELECT DISTINCT measure, mode, cell_id FROM occ) m USING (measure, cell_id) GROUP BY ALL), {norm_sql('measure, mode', 'ppa', 'pha1')},
st AS (SELECT measure, mode, i, round(max(x), 6) + 0.0 AS x, round(coalesce(avg(occupancy), 0), 5) + 0.0 AS mean, round(coalesce(stddev_pop(occupancy), 0), 5) + 0.0 AS std, round(quantile_cont(coalesce(occupancy, 0), 0.025), 5) + 0.0 AS lo, round(quantile_cont(coalesce(occupancy, 0), 0.975), 5) + 0.0 AS hi FROM common GROUP BY ALL)
SELECT st.*, round(exp(ln(greatest(o.y, 1e-10)) - ln(greatest(a.y, 1e-10))), 5) + 0.0 AS pooled FROM st JOIN ppo o USING (measure, mode, i) JOIN ppa a USING (measure, mode, i)""")
def g07_occupancy_binned(spark, d):
    _, c = _binned(spark, d)
    return c.select("measure", "mode", "i", r6("x").alias("x"), *[(F.round(k, 5) + 0.0).alias(k) for k in ("mean", "std", "lo", "hi", "pooled")])


@query()
def g10_occupancy_kde(spark, d):
    c, _ = G.occupancy_kde(*_inputs(spark, d), n=50, percentile=100.0, pixel=None)
    return c.select("measure", "mode", "cell_id", "i", r6("x").alias("x"), (F.round("occupancy", 5) + 0.0).alias("occupancy"))


@query(f"WITH {SAMPLES_ORDERS}, {AVAILABLE_ORDERS}, t AS (SELECT measure, cell_id, max(value) AS top FROM available GROUP BY ALL), e AS (SELECT measure, quantile_cont(top, 0.5) AS x1 FROM t GROUP BY 1) SELECT measure, i::INT AS i, round(i * x1 / 49, 6) + 0.0 AS x FROM e, range(50) r(i)")
def g09_kde_common_grid(spark, d):
    return G.kde_common_grid(available_orders(spark, d), 50, 50.0).select("measure", "i", r6("x").alias("x"))


@query(f"WITH {SAMPLES_ITEMS} SELECT measure, mode, min(value) AS lo, max(value) AS hi FROM samples GROUP BY ALL")
def g11_sample_range(spark, d):
    return G.sample_range(samples_items(spark, d), ["measure", "mode"])


@query(f"WITH {COMMON} SELECT measure, round(quantile_cont(x, 0.9), 6) + 0.0 AS x_limit FROM common GROUP BY 1")
def g12_x_limit(spark, d):
    return G.x_limit(_binned(spark, d)[0], 90).select("measure", r6("x_limit").alias("x_limit"))


FINITE = f"{COMMON}, ov AS (SELECT measure, mode, cell_id, round(occupancy, 9) AS value, count(*)::DOUBLE AS w FROM common WHERE occupancy IS NOT NULL GROUP BY ALL), og AS (SELECT DISTINCT measure, mode, cell_id FROM common)"


def _rounded(spark, d):
    return _binned(spark, d)[0].withColumn("occupancy", F.round("occupancy", 9))


@query(f"""WITH {FINITE}, p AS (SELECT a.measure, a.mode AS mode_1, a.cell_id AS cell_id_1, b.mode AS mode_2, b.cell_id AS cell_id_2 FROM og a JOIN og b ON a.measure = b.measure AND (a.mode, a.cell_id) < (b.mode, b.cell_id)),
sides AS (SELECT p.*, 0 AS side, value, w FROM p JOIN ov v ON v.measure = p.measure AND v.mode = mode_1 AND v.cell_id = cell_id_1 UNION ALL SELECT p.*, 1, value, w FROM p JOIN ov v ON v.measure = p.measure AND v.mode = mode_2 AND v.cell_id = cell_id_2),
{walk_sql('measure, mode_1, cell_id_1, mode_2, cell_id_2', 'sides')} SELECT p.*, round(emd, 5) + 0.0 AS emd FROM p LEFT JOIN walk USING (measure, mode_1, cell_id_1, mode_2, cell_id_2)""")
def f05_occupancy_emd(spark, d):
    o = G.occupancy_emd(_rounded(spark, d))
    return o.select("measure", "mode_1", "cell_id_1", "mode_2", "cell_id_2", (F.round("emd", 5) + 0.0).alias("emd"))


@query(f"""WITH {FINITE}, sides AS (SELECT a.measure, a.mode, a.cell_id, 0 AS side, value, w FROM ov a WHERE mode <> '1-URGENT' UNION ALL SELECT m.measure, m.mode, m.cell_id, 1, value, w FROM (SELECT DISTINCT measure, mode, cell_id FROM ov WHERE mode <> '1-URGENT') m JOIN ov b ON b.measure = m.measure AND b.cell_id = m.cell_id AND b.mode = '1-URGENT'),
{walk_sql('measure, mode, cell_id', 'sides')} SELECT measure, mode, cell_id, n1, n2, round(ks, 6) + 0.0 AS ks FROM walk""")
def f06_occupancy_ks(spark, d):
    o = G.occupancy_ks(_rounded(spark, d), spark.createDataFrame([("1-URGENT",)], "baseline string"))
    return o.select("measure", "mode", "cell_id", "n1", "n2", r6("ks").alias("ks"))


@query(f"""WITH {COMMON}, oc AS (SELECT measure, mode, cell_id, i, coalesce(round(occupancy, 9), 0) AS y FROM common), top AS (SELECT greatest(quantile_cont(y, 0.95), 1e-9) AS x1 FROM oc),
curves AS (SELECT 'ratio' AS measure, mode, cell_id AS curve_id, i, y FROM oc UNION ALL SELECT 'ecdf', mode, cell_id, k::INT, avg((y <= k * (x1 / 39))::INT::DOUBLE) FROM oc, top, range(40) t(k) GROUP BY ALL), {pair_test_sql('integrated')}
SELECT measure AS comparison, mode_a, mode_b, curve_id, sign, round(p_value, 6) + 0.0 AS p_value FROM tests""")
def e08_envelope_occupancy(spark, d):
    """Ratio curves and their value distributions, all ordered pairs of modes; the only measure, without its joint test."""
    c = written(_rounded(spark, d))
    out = None
    for kind in ("ratio", "ecdf"):
        t = E.pairwise_envelope_test_occupancy(c, kind, n=40)[0].filter("measure <> 'joint'").withColumn("comparison", F.lit(kind))
        out = t if out is None else out.unionByName(t)
    return out.select("comparison", "mode_a", "mode_b", "curve_id", "sign", r6("p_value").alias("p_value"))


# --- mixtures ------------------------------------------------------------------------------------

MODES2 = ["N", "R"]
CURVE = f"""{SAMPLES_ITEMS}, {grid_sql('measure', w=5.0)}, {hist_sql('measure, mode, cell_id', 'measure', 5.0)}, oc AS (SELECT measure, mode, cell_id, i, x, y / sum(y) OVER (PARTITION BY measure, mode, cell_id) AS y FROM hist),
mat AS (SELECT measure, i, max(a0) AS a0, max(a1) AS a1 FROM (SELECT measure, i, avg(y) FILTER (mode = 'N') AS a0, avg(y) FILTER (mode = 'R') AS a1 FROM oc GROUP BY ALL) GROUP BY ALL)"""


def fit_sql(target: str, keys: str) -> str:
    """CTEs ``fit`` (keys, scope, n, c0, c1, mse) from target(keys, measure, i, b): two columns, in closed form."""
    k = keys + ", " if keys else ""
    rss = lambda a, b: f"bb - 2 * ({a} * r0 + {b} * r1) + {a} * {a} * g00 + 2 * {a} * {b} * g01 + {b} * {b} * g11"
    return f"""fr AS (SELECT {k}unnest([measure, 'joint']) AS scope, b, a0, a1 FROM {target} JOIN mat USING (measure, i)),
fs AS (SELECT {k}scope, sum(a0 * a0) AS g00, sum(a0 * a1) AS g01, sum(a1 * a1) AS g11, sum(a0 * b) AS r0, sum(a1 * b) AS r1, sum(b * b) AS bb, count(*) AS n FROM fr GROUP BY ALL),
fc AS (SELECT *, (r0 * g11 - r1 * g01) / (g00 * g11 - g01 * g01) AS f0, (r1 * g00 - r0 * g01) / (g00 * g11 - g01 * g01) AS f1, greatest(0, r0 / g00) AS s0, greatest(0, r1 / g11) AS s1 FROM fs),
fd AS (SELECT *, CASE WHEN f0 >= 0 AND f1 >= 0 THEN f0 WHEN s0 * s0 * g00 - 2 * s0 * r0 <= s1 * s1 * g11 - 2 * s1 * r1 THEN s0 ELSE 0 END AS c0, CASE WHEN f0 >= 0 AND f1 >= 0 THEN f1 WHEN s0 * s0 * g00 - 2 * s0 * r0 <= s1 * s1 * g11 - 2 * s1 * r1 THEN 0 ELSE s1 END AS c1 FROM fc),
fit AS (SELECT {k}scope, n, c0, c1, greatest(0, {rss('c0', 'c1')}) AS rss, greatest(0, {rss('c0', 'c1')}) / n AS mse, greatest(0, bb - 2 * s0 * r0 + s0 * s0 * g00) AS rss0, greatest(0, bb - 2 * s1 * r1 + s1 * s1 * g11) AS rss1, s0, s1 FROM fd)"""


def _curves(spark, d):
    s = samples_items(spark, d)
    h = D.histogram(s, D.r_grid(s, ["measure"], bin_width=5.0), ["measure", "mode", "cell_id"], ["measure"], 5.0)
    from pyspark.sql import Window

    # The fits read both tables many times: they are made once.
    occ = written(h.withColumn("occupancy", F.col("y") / F.sum("y").over(Window.partitionBy("measure", "mode", "cell_id"))).drop("y"), "occupancy")
    comb = occ.groupBy("measure", "mode", "i").agg(F.max("x").alias("x"), F.avg("occupancy").alias("occupancy"))
    return occ, written(comb, "combined")


def _target(occ, comb):
    grid = H.baseline_grid(comb, "A")
    target = comb.filter("mode = 'A'").select("measure", "i", F.col("occupancy").alias("b"))
    return grid, target, H.design(comb, grid, MODES2)


TARGET = "tg AS (SELECT measure, i, avg(y) AS b FROM oc WHERE mode = 'A' GROUP BY ALL)"


@query(f"WITH {CURVE}, {TARGET}, {fit_sql('tg', '')} SELECT scope, m AS mode, round(CASE WHEN m = 'N' THEN c0 ELSE c1 END, 5) + 0.0 AS coef, round(CASE WHEN c0 + c1 > 0 THEN CASE WHEN m = 'N' THEN c0 ELSE c1 END / (c0 + c1) ELSE 0 END, 5) + 0.0 AS share, round(mse, 9) + 0.0 AS mse FROM fit, (VALUES ('N'), ('R')) v(m)")
def h04_fit_mixture(spark, d):
    occ, comb = _curves(spark, d)
    _, target, matrix = _target(occ, comb)
    t = H.fit_table(*H.fit_mixture(target, matrix, MODES2, []), [])
    return t.select("scope", "mode", (F.round("coef", 5) + 0.0).alias("coef"), (F.round("share", 5) + 0.0).alias("share"), (F.round("mse", 9) + 0.0).alias("mse"))


@query(f"WITH {CURVE}, {TARGET}, {fit_sql('tg', '')} SELECT scope, 'N' AS mode, round(s0, 5) + 0.0 AS coef, round(rss0, 8) + 0.0 AS rss, n FROM fit UNION ALL SELECT scope, 'R', round(s1, 5) + 0.0, round(rss1, 8) + 0.0, n FROM fit")
def h05_fit_single(spark, d):
    _, target, matrix = _target(*_curves(spark, d))
    return H.fit_single(target, matrix, MODES2, []).select("scope", "mode", (F.round("coef", 5) + 0.0).alias("coef"), (F.round("rss", 8) + 0.0).alias("rss"), "n")


@query(f"WITH {CURVE} SELECT measure, i, round(a0, 8) + 0.0 AS a0, round(a1, 8) + 0.0 AS a1 FROM mat")
def h03_design(spark, d):
    _, _, matrix = _target(*_curves(spark, d))
    return matrix.select("measure", "i", *[(F.round(F.col("a")[k], 8) + 0.0).alias(f"a{k}") for k in (0, 1)])


@query(f"WITH {CURVE}, c AS (SELECT DISTINCT measure, cell_id FROM oc WHERE mode = 'A') SELECT cell_id FROM c WHERE measure = (SELECT min(measure) FROM c)")
def h01_baseline_cells(spark, d):
    return H.baseline_cells(_curves(spark, d)[0], "A")[0]


CV = f"""{CURVE}, cl AS (SELECT DISTINCT cell_id FROM oc WHERE mode = 'A'), fo AS (SELECT r::INT AS repeat, cell_id, ntile(5) OVER (PARTITION BY r ORDER BY md5('cv|' || r || '|' || cell_id), cell_id)::INT - 1 AS fold FROM cl, range(3) t(r)),
tr AS (SELECT f.repeat, k::INT AS fold, cell_id FROM fo f, range(5) t(k) WHERE k <> f.fold), ab AS (SELECT measure, cell_id, i, y FROM oc WHERE mode = 'A'),
tg AS (SELECT repeat, fold, measure, i, avg(y) AS b FROM tr JOIN ab USING (cell_id) GROUP BY ALL), {fit_sql('tg', 'repeat, fold')},
te AS (SELECT repeat, fold, measure, i, avg(y) AS b FROM fo JOIN ab USING (cell_id) GROUP BY ALL),
tm AS (SELECT te.repeat, te.fold, f.scope, avg((b - c0 * a0 - c1 * a1) * (b - c0 * a0 - c1 * a1)) AS test_mse FROM te JOIN mat USING (measure, i) JOIN fit f ON f.repeat = te.repeat AND f.fold = te.fold AND (f.scope = te.measure OR f.scope = 'joint') GROUP BY ALL)"""


def _cv(spark, d):
    occ, comb = _curves(spark, d)
    return H.cross_validate(occ, comb, MODES2, "A", 5, 3), comb


@query(f"WITH {CV} SELECT repeat, fold, scope, 'train' AS split, NULL AS cell_id, round(mse, 8) + 0.0 AS mse FROM fit UNION ALL SELECT repeat, fold, scope, 'test', NULL, round(test_mse, 8) + 0.0 FROM tm")
def h07_cross_validate(spark, d):
    return H.cv_long(_cv(spark, d)[0]).withColumn("mse", F.round("mse", 8) + 0.0)


@query(f"WITH {CV} SELECT f.scope, round(avg(mse), 8) + 0.0 AS train_mse, round(stddev_pop(mse), 8) + 0.0 AS train_mse_std, round(avg(test_mse), 8) + 0.0 AS test_mse, round(stddev_pop(test_mse), 8) + 0.0 AS test_mse_std FROM fit f JOIN tm USING (repeat, fold, scope) GROUP BY 1")
def h08_cv_summary(spark, d):
    s = H.cv_summary(_cv(spark, d)[0])[1]
    return s.select("scope", *[(F.round(c, 8) + 0.0).alias(c) for c in ("train_mse", "train_mse_std", "test_mse", "test_mse_std")])


@query(f"WITH {CV}, mc AS (SELECT scope, avg(c0) AS c0, avg(c1) AS c1 FROM fit GROUP BY 1), al AS (SELECT measure, i, avg(y) AS b FROM ab GROUP BY ALL) SELECT scope, round(avg((b - c0 * a0 - c1 * a1) * (b - c0 * a0 - c1 * a1)), 8) + 0.0 AS mse FROM mc JOIN al ON scope = measure OR scope = 'joint' JOIN mat USING (measure, i) GROUP BY 1")
def h10_fit_from_cv(spark, d):
    cv, comb = _cv(spark, d)
    return H.fit_from_cv(cv, comb, MODES2, "A")[1].withColumn("mse", F.round("mse", 8) + 0.0)


@query(f"WITH {CV}, j AS (SELECT repeat, fold, c0, c1 FROM fit WHERE scope = 'joint'), b AS (SELECT * FROM j UNION ALL SELECT NULL, NULL, avg(c0), avg(c1) FROM j) SELECT repeat, fold, 'R' AS mode, 'radial' AS gradient, round(c1 / (c0 + c1), 5) + 0.0 AS weight FROM b")
def h11_mixture_weights(spark, d):
    w = H.mixture_weights(_cv(spark, d)[0], spark.createDataFrame([("R", "radial")], "mode string, gradient string"))
    return w.withColumn("weight", F.round("weight", 5) + 0.0)


@query("""SELECT p_partkey, round(n * ln(r / n) + 2 * (k + 1), 6) + 0.0 AS aic, round(CASE WHEN p_size <= k + 2 THEN 'inf'::DOUBLE ELSE n * ln(r / n) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / (n - k - 2) END, 6) + 0.0 AS aicc, round(n * ln(r / n) + (k + 1) * ln(n), 6) + 0.0 AS bic FROM (SELECT *, p_size::DOUBLE AS n, 2 AS k, p_retailprice AS r FROM part)""")
def h12_information_criteria(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("n"), F.lit(2).alias("k"), F.col("p_retailprice").alias("rss"))
    return H.information_criteria(p).select("p_partkey", r6("aic").alias("aic"), r6("aicc").alias("aicc"), r6("bic").alias("bic"))


@query(f"""WITH {CURVE}, {TARGET}, {fit_sql('tg', '')}, nu AS (SELECT scope, count(*) AS n, var_pop(b) * count(*) AS rss FROM (SELECT unnest([measure, 'joint']) AS scope, b FROM tg) GROUP BY 1),
m AS (SELECT scope, 'mixed' AS model, n, 2 AS k, rss FROM fit UNION ALL SELECT scope, 'single:N', n, 1, rss0 FROM fit UNION ALL SELECT scope, 'single:R', n, 1, rss1 FROM fit UNION ALL SELECT scope, 'null', n, 1, rss FROM nu),
a AS (SELECT *, n * ln(rss / n) + 2 * (k + 1) AS aic FROM m), dd AS (SELECT *, aic - min(aic) OVER (PARTITION BY scope) AS delta_aic FROM a)
SELECT scope, model, n, k, round(aic, 2) + 0.0 AS aic, round(exp(-delta_aic / 2) / sum(exp(-delta_aic / 2)) OVER (PARTITION BY scope), 4) + 0.0 AS weight_aic, delta_aic = 0 AS best FROM dd""")
def h13_compare_candidates(spark, d):
    _, target, matrix = _target(*_curves(spark, d))
    t = H.comparison_table(H.compare_candidates(target, matrix, MODES2))
    return t.select("scope", "model", "n", "k", (F.round("aic", 2) + 0.0).alias("aic"), (F.round("weight_aic", 4) + 0.0).alias("weight_aic"), "best")


# --- geometry ------------------------------------------------------------------------------------

G3 = "a.mode = b.mode AND a.cell_id = b.cell_id AND a.seed = b.seed"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH {POINTS_VEC} SELECT a.point_id AS point_1, b.point_id AS point_2, round({DIST}, 6) + 0.0 AS value FROM points a JOIN points b ON {G3} AND a.point_id < b.point_id")
def c01_pairwise_distances(spark, d):
    return C.pairwise_distances(points_vec(spark, d)).select("point_1", "point_2", r6("value").alias("value"))


NEAREST = f"WITH {POINTS_VEC} SELECT a.point_id, round(min({DIST}), 6) + 0.0 AS value FROM points a JOIN points b ON {G3} AND a.point_id <> b.point_id GROUP BY 1"


@query(NEAREST)
def c02_nearest_neighbour(spark, d):
    return C.nearest_neighbour(points_vec(spark, d)).select("point_id", r6("value").alias("value"))


@query(NEAREST)
def c02_nearest_neighbour_bucketed(spark, d):
    return C.nearest_neighbour(points_vec(spark, d), 4.0).select("point_id", r6("value").alias("value"))


@query(f"WITH {POINTS_VEC}, {CELLS_VEC} SELECT point_id, round(abs(z - mem_z_min), 6) + 0.0 AS z_distance, round(abs(z - mem_z_min) / (mem_z_max - mem_z_min), 6) + 0.0 AS scaled_z_distance FROM points JOIN cells USING (cell_id)")
def c03_z_distances(spark, d):
    z = C.z_distances(points_vec(spark, d), cells_vec(spark, d))
    return z.select("point_id", r6("z_distance").alias("z_distance"), r6("scaled_z_distance").alias("scaled_z_distance"))


def sphere(spark, cells, levels: int = 1, radii=(("nuc", 0.5), ("mem", 1.0))):
    """Triangles of concentric spheres, one pair per cell: an octahedron, each face cut in four per level, put on the sphere.

    ``cells``: cell_id, radius. The faces come from a rule; every corner is scaled by the cell's radius.
    """
    signs = spark.range(8).select(*[(1 - 2 * F.shiftright(F.col("id").cast("int"), k).bitwiseAND(F.lit(1))).cast("double").alias(f"s{k}") for k in range(3)])
    zero = F.lit(0.0)
    t = signs.select(F.struct(F.col("s0").alias("x"), zero.alias("y"), zero.alias("z")).alias("a"), F.struct(zero.alias("x"), F.col("s1").alias("y"), zero.alias("z")).alias("b"), F.struct(zero.alias("x"), zero.alias("y"), F.col("s2").alias("z")).alias("c"), (F.col("s0") * F.col("s1") * F.col("s2") < 0).alias("flip"))
    t = t.select("a", F.when(F.col("flip"), F.col("c")).otherwise(F.col("b")).alias("b"), F.when(F.col("flip"), F.col("b")).otherwise(F.col("c")).alias("c"))
    mid = lambda p, q: F.struct(*[((F.col(f"{p}.{k}") + F.col(f"{q}.{k}")) / 2).alias(k) for k in "xyz"])
    for _ in range(levels):
        t = t.withColumn("ab", mid("a", "b")).withColumn("bc", mid("b", "c")).withColumn("ca", mid("c", "a"))
        faces = [("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")]
        t = t.withColumn("_f", F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c")) for p, q, r in faces]))).select("_f.*")
    out = None
    for surface, factor in radii:
        length = lambda p: F.sqrt(sum((F.col(f"{p}.{k}") * F.col(f"{p}.{k}") for k in "xyz"), F.lit(0.0)))
        s = cells.crossJoin(F.broadcast(t)).select("cell_id", F.lit(surface).alias("surface"), *[(F.col(f"{p}.{k}") / length(p) * F.col("radius") * factor).alias(f"{p}{k}") for p in "abc" for k in "xyz"])
        out = s if out is None else out.unionByName(s)
    return out


def _surfaces(spark, d, levels=1):
    """Spheres about the origin whose radii follow each cell's points."""
    p = points_vec(spark, d)
    r = p.groupBy("cell_id").agg(F.percentile(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(0.8)).alias("radius"))
    return p, sphere(spark, r, levels), r


@query()
def c04_surface_distance(spark, d):
    """Signed distances to the nucleus and membrane; spheres are tested against the closed form."""
    p, t, _ = _surfaces(spark, d)
    keep = p.select("cell_id", "point_id", "x", "y", "z")
    s = lambda k: C.surface_distance(keep, t, surface=k).select("point_id", r6("distance").alias(k))
    return s("nuc").join(s("mem"), "point_id")


@query()
def c05_scaled_surface_distance(spark, d):
    p, t, _ = _surfaces(spark, d)
    return C.scaled_surface_distance(p.select("cell_id", "point_id", "x", "y", "z"), t).select("point_id", r6("scaled_distance").alias("scaled_distance"))


@query(f"""WITH {POINTS_VEC}, b AS (SELECT cell_id, floor(min(x)) AS x0, floor(max(x)) + 1 AS x1, floor(min(y)) AS y0, floor(max(y)) + 1 AS y1, floor(min(z)) AS z0, floor(max(z)) + 1 AS z1 FROM points GROUP BY 1)
SELECT cell_id, count(*) AS n, round(sum(x0 + i * 2), 4) AS sx, round(sum(z0 + k * 2), 4) AS sz FROM b, range(60) r1(i), range(60) r2(j), range(60) r3(k) WHERE x0 + i * 2 < x1 + 1 AND y0 + j * 2 < y1 + 1 AND z0 + k * 2 < z1 + 1 GROUP BY 1""")
def c06_grid_points(spark, d):
    b = points_vec(spark, d).groupBy("cell_id").agg(*[f for c in "xyz" for f in (F.floor(F.min(c)).cast("double").alias(f"{c}_min"), (F.floor(F.max(c)) + 1).cast("double").alias(f"{c}_max"))])
    return C.grid_points(b, 2.0).groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("z"), 4).alias("sz"))


@query()
def c07_available_space(spark, d):
    _, t, r = _surfaces(spark, d)
    box = r.select("cell_id", *[f for c in "xyz" for f in ((-F.col("radius")).alias(f"{c}_min"), F.col("radius").alias(f"{c}_max"))])
    a = C.available_space(box, t, 4.0)
    return a.groupBy("measure", "cell_id").agg(F.count("*").alias("n"), (F.round(F.avg("value"), 5) + 0.0).alias("mean"))


@query()
def c08_classify_points(spark, d):
    p, t, _ = _surfaces(spark, d)
    return C.classify_points(p.select("cell_id", "point_id", "x", "y", "z"), t).select("point_id", "in_nucleus", "in_membrane", "in_cytoplasm")


@query(f"WITH {POINTS_VEC}, m AS (SELECT cell_id, quantile_cont(z, 0.5) AS m FROM points GROUP BY 1) SELECT point_id FROM points JOIN m USING (cell_id) WHERE abs(z - m) <= 1.5 + 1e-5 * abs(m)")
def c09_median_slice(spark, d):
    return C.median_slice(points_vec(spark, d), "z", 3.0).select("point_id")


@query(f"WITH {POINTS_VEC}, g AS (SELECT mode, cell_id, avg((x < 0)::INT::DOUBLE) AS a, avg((y < 0)::INT::DOUBLE) AS b FROM points GROUP BY ALL) SELECT mode, cell_id, round(a, 6) + 0.0 AS in_nucleus, round(b, 6) + 0.0 AS outside_membrane, a + b > 0.1 AS flagged FROM g")
def c10_cytoplasm_qc(spark, d):
    p = points_vec(spark, d).withColumn("nucleus", F.col("x")).withColumn("membrane", F.col("y"))
    return C.cytoplasm_qc(p).select("mode", "cell_id", r6("in_nucleus").alias("in_nucleus"), r6("outside_membrane").alias("outside_membrane"), "flagged")


@query(f"""WITH {POINTS_VEC}, {CELLS_VEC}, s AS (SELECT 'pairwise' AS measure, a.mode, a.cell_id, {DIST} AS value FROM points a JOIN points b ON {G3} AND a.point_id < b.point_id
UNION ALL SELECT 'nearest', mode, cell_id, v FROM (SELECT a.mode, a.cell_id, a.point_id, min({DIST}) AS v FROM points a JOIN points b ON {G3} AND a.point_id <> b.point_id GROUP BY ALL)
UNION ALL SELECT 'z', mode, cell_id, abs(z - mem_z_min) FROM points JOIN cells USING (cell_id)) SELECT measure, mode, cell_id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM s GROUP BY ALL""")
def c11_distances(spark, d):
    s = C.distances(points_vec(spark, d), ["pairwise", "nearest", "z"], cells_vec(spark, d))
    return s.groupBy("measure", "mode", "cell_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"""WITH {POINTS_VEC}, {CELLS_VEC}, dd AS (SELECT a.mode, a.cell_id, {DIST} / mem_diameter AS v FROM points a JOIN points b ON {G3} AND a.point_id < b.point_id JOIN cells c ON c.cell_id = a.cell_id),
n AS (SELECT mode, cell_id, count(*) AS n FROM points GROUP BY ALL), k AS (SELECT n.mode, n.cell_id, i, i * (0.5::DOUBLE / 99) AS r, (SELECT count(*) FROM dd WHERE dd.mode = n.mode AND dd.cell_id = n.cell_id AND v <= i * (0.5::DOUBLE / 99)) * {4 / 3 * math.pi}::DOUBLE * 0.125::DOUBLE * 2 / nullif(n * (n - 1), 0) AS k FROM n, range(100) t(i))
SELECT mode, i::INT AS i, round(max(r), 6) + 0.0 AS r, round(avg(coalesce(k, 0)), 6) + 0.0 AS mean, round(quantile_cont(coalesce(k, 0), 0.025), 6) + 0.0 AS lo, round(quantile_cont(coalesce(k, 0), 0.975), 6) + 0.0 AS hi FROM k GROUP BY 1, 2""")
def c13_ripley_k_summary(spark, d):
    s = C.ripley_k_summary(points_vec(spark, d), cells_vec(spark, d))
    return s.select("mode", "i", *[r6(c).alias(c) for c in ("r", "mean", "lo", "hi")])


def _voxels(spark, d):
    p = points_vec(spark, d)
    return p.select(F.col("cell_id").alias("image_id"), F.col("mode").alias("channel"), F.lit(1).alias("value"), *[F.floor(F.col(c) / 4).cast("int").alias(c) for c in "xyz"]).distinct()


VOXELS = "vox AS (SELECT DISTINCT cell_id AS image_id, mode AS channel, floor(x / 4)::INT AS x, floor(y / 4)::INT AS y, floor(z / 4)::INT AS z FROM points)"
COMPONENTS = f"""WITH RECURSIVE {POINTS_VEC}, {VOXELS}, reach(image_id, channel, x, y, z, lx, ly, lz) AS (SELECT *, x, y, z FROM vox UNION SELECT v.image_id, v.channel, v.x, v.y, v.z, r.lx, r.ly, r.lz FROM reach r JOIN vox v ON v.image_id = r.image_id AND v.channel = r.channel AND abs(v.x - r.x) <= 1 AND abs(v.y - r.y) <= 1 AND abs(v.z - r.z) <= 1),
lab AS (SELECT image_id, channel, x, y, z, min((lx, ly, lz)) AS l FROM reach GROUP BY ALL), comp AS (SELECT image_id, channel, l, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS size FROM lab GROUP BY ALL)"""


@query(f"{COMPONENTS} SELECT image_id, channel, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, size, row_number() OVER (PARTITION BY image_id, channel ORDER BY size DESC, l) = 1 AS largest FROM comp")
def c14_component_centroids(spark, d):
    c, _ = C.component_centroids(_voxels(spark, d))
    return c.select("image_id", "channel", *[r6(k).alias(k) for k in ("cx", "cy", "cz")], "size", "largest")


@query(f"{COMPONENTS}, big AS (SELECT image_id, channel, l FROM comp QUALIFY row_number() OVER (PARTITION BY image_id, channel ORDER BY size DESC, l) = 1), bv AS (SELECT v.* FROM lab v JOIN big USING (image_id, channel, l)) SELECT c.image_id, c.channel, c.size, round(min(sqrt(pow(round_even(cx, 0) - x, 2) + pow(round_even(cy, 0) - y, 2) + pow(round_even(cz, 0) - z, 2))), 6) + 0.0 AS distance FROM comp c JOIN bv USING (image_id, channel) GROUP BY c.image_id, c.channel, c.l, c.size")
def c15_distance_to_component(spark, d):
    c, labels = C.component_centroids(_voxels(spark, d))
    big = labels.join(c.filter("largest").select("image_id", "channel", "value", "label"), ["image_id", "channel", "value", "label"], "left_semi")
    out = C.distance_to_component(c, big, ("image_id", "channel"))
    return out.join(c.select("image_id", "channel", "label", "size"), ["image_id", "channel", "label"]).select("image_id", "channel", "size", r6("distance").alias("distance"))


@query(f"WITH {POINTS_VEC} SELECT cell_id, round(avg(x), 6) + 0.0 AS centre_x, round(min(y), 6) + 0.0 AS y_min, round((min(z) + max(z)) / 2 + (max(z) - min(z)) / 2 * 1.2, 6) + 0.0 AS z_max_expanded FROM points GROUP BY 1")
def c16_mesh_bounds(spark, d):
    b = C.mesh_bounds(points_vec(spark, d), ("cell_id",))
    return b.select("cell_id", r6("centre_x").alias("centre_x"), r6("y_min").alias("y_min"), r6("z_max_expanded").alias("z_max_expanded"))


@query(f"WITH {POINTS_VEC}, {CELLS_VEC}, s AS (SELECT n_name AS structure_id, CAST(s_suppkey % 12 AS VARCHAR) AS cell_id, s_acctbal AS radius FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT structure_id, round(avg(radius / mem_diameter), 6) + 0.0 AS mean, round(stddev_pop(radius / mem_diameter), 6) + 0.0 AS std, count(*) AS n FROM s JOIN cells USING (cell_id) GROUP BY 1")
def c17_scaled_radius(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("structure_id"), (F.col("s_suppkey") % 12).cast("string").alias("cell_id"), F.col("s_acctbal").alias("radius"))
    return C.scaled_radius(s, cells_vec(spark, d)).select("structure_id", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query()
def c18_distance_agreement(spark, d):
    """Membrane distance of a coarse and of a finer surface, per point."""
    p, coarse, r = _surfaces(spark, d, 1)
    keep = p.select("cell_id", "point_id", "x", "y", "z")
    fine = sphere(spark, r, 2)
    a, b = (C.surface_distance(keep, t, surface="mem") for t in (coarse, fine))
    return C.distance_agreement(a, b).select("cell_id", "point_id", r6("difference").alias("difference"))


@query()
def c18_agreement_summary(spark, d):
    """Per cell: how far the coarse and the fine membrane differ, points inside the nucleus, points outside the membrane."""
    p, coarse, r = _surfaces(spark, d, 1)
    keep = p.select("cell_id", "point_id", "x", "y", "z")
    mem, nuc, fine = C.surface_distance(keep, coarse, surface="mem"), C.surface_distance(keep, coarse, surface="nuc"), C.surface_distance(keep, sphere(spark, r, 2), surface="mem")
    both = mem.select("cell_id", "point_id", F.col("distance").alias("membrane")).join(nuc.select("cell_id", "point_id", F.col("distance").alias("nucleus")), ["cell_id", "point_id"])
    out = C.agreement_summary(C.distance_agreement(mem, fine), both)
    return out.select("cell_id", "n", *[r6(c).alias(c) for c in ("mean_difference", "rms_difference", "in_nucleus", "outside_membrane")], "flagged")


@query(f"""WITH {POINTS_VEC}, {CELLS_VEC}, k AS (SELECT cell_id, point_id, unnest([abs(x), abs(y), mem_z_max - z, NULL]) AS d, unnest(['nucleus', 'membrane', 'top', 'uniform']) AS kind FROM points JOIN cells USING (cell_id)), s AS (SELECT *, exp(-(d / max(d) OVER (PARTITION BY cell_id, kind)) / 0.4) AS w FROM k)
SELECT cell_id, point_id, kind, round(CASE WHEN kind = 'uniform' THEN 1 ELSE w / max(w) OVER (PARTITION BY cell_id, kind) END, 6) + 0.0 AS weight FROM s""")
def b16_weight_maps(spark, d):
    p = points_vec(spark, d).select("cell_id", "point_id", "z", F.abs("x").alias("nucleus"), F.abs("y").alias("membrane"))
    return C.weight_maps(p, cells_vec(spark, d), 0.4).select("cell_id", "point_id", "kind", r6("weight").alias("weight"))


# --- profiles ------------------------------------------------------------------------------------


def profiles(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("profile_id"), F.col("label").cast("string").alias("channel"), F.posexplode("embedding").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


PROFILES = "prof AS (SELECT vec_id AS profile_id, CAST(label AS VARCHAR) AS channel, i::INT - 1 AS i, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"


@query(f"WITH {PROFILES} SELECT profile_id, i, round(value / max(value) OVER (PARTITION BY profile_id), 6) + 0.0 AS value FROM prof WHERE i >= 32")
def p01_process_profile(spark, d):
    return P.process_profile(profiles(spark, d), ["profile_id"]).select("profile_id", "i", r6("value").alias("value"))


@query(f"WITH {PROFILES} SELECT channel, i, round(avg(value), 6) + 0.0 AS value FROM prof GROUP BY ALL")
def p02_mean_profile(spark, d):
    return P.mean_profile(profiles(spark, d)).select("channel", "i", r6("value").alias("value"))


@query(f"WITH {PROFILES}, m AS (SELECT channel, i, avg(value) AS v FROM prof GROUP BY ALL) SELECT a.channel AS channel_1, b.channel AS channel_2, round(corr(a.v, b.v), 6) + 0.0 AS r FROM m a JOIN m b USING (i) GROUP BY ALL")
def p03_profile_correlation(spark, d):
    return P.profile_correlation(profiles(spark, d)).select("channel_1", "channel_2", r6("r").alias("r"))


BIN = f"{PROFILES}, o AS (SELECT profile_id, list((value > 0)::INT ORDER BY i) AS b FROM prof WHERE i >= 32 GROUP BY 1), c AS (SELECT a.profile_id AS id_1, b.profile_id AS id_2, list_sum(a.b) AS n1, list_sum(b.b) AS n2, list_dot_product(a.b::DOUBLE[], b.b::DOUBLE[]) AS k FROM o a JOIN o b ON a.profile_id <= b.profile_id), rr AS (SELECT id_1, id_2, (32 * k - n1 * n2) / nullif(sqrt(n1 * (32 - n1) * n2 * (32 - n2)), 0) AS r FROM c)"


@query(f"WITH {BIN} SELECT id_1, id_2, round(r, 6) + 0.0 AS r FROM rr")
def p04_binary_correlation(spark, d):
    return P.binary_correlation(profiles(spark, d)).select("id_1", "id_2", r6_unit("r").alias("r"))


@query()
def p05_embed(spark, d):
    """Components are fixed up to sign: their absolute values are reported."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    x = P.embed(e, "embedding", F.col("label") < 5, 2)
    return x.select("vec_id", *[(F.round(F.abs(F.col("components")[k]), 4) + 0.0).alias(f"c{k}") for k in (0, 1)])


@query(f"WITH {BIN} SELECT CAST(b.label AS VARCHAR) AS structure_2, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) + 0.0 AS std, count(r) AS n FROM rr JOIN embeddings a ON a.vec_id = id_1 JOIN embeddings b ON b.vec_id = id_2 WHERE a.label = 0 AND r < 0.99 GROUP BY 1")
def p07_correlation_summary(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("label").cast("string").alias("structure"), F.lit("r").alias("rule"), F.col("vec_id").alias("cell_id"))
    s = P.correlation_summary(P.correlation_pairs(profiles(spark, d), e), "0", ["structure_2"], "structure")
    return s.select("structure_2", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(f"""WITH {PROFILES}, m AS (SELECT channel, i, avg(value) AS v FROM prof GROUP BY ALL), a AS (SELECT *, i // 16 AS r, (i // 4) % 4 AS theta, i % 4 AS phi FROM m)
SELECT channel, CASE WHEN grouping(r) = 1 THEN 'r' WHEN grouping(theta) = 1 THEN 'theta' ELSE 'phi' END AS mean_over, r, theta, phi, round(avg(v), 6) + 0.0 AS value FROM a GROUP BY GROUPING SETS ((channel, theta, phi), (channel, r, phi), (channel, r, theta))""")
def p08_axis_means(spark, d):
    return P.axis_means(P.mean_profile(profiles(spark, d)), (4, 4, 4)).withColumn("value", r6("value"))


# --- sources that need files: written from the tables, read back ---------------------------------


def _folder(spark) -> str:
    return shared_path(spark, "files")


def _positions(spark, d, folder: str):
    """points_vec as positions JSON: a document for every cell, files by mode."""
    p = points_vec(spark, d)
    xyz = F.transform(F.sort_array(F.collect_list(F.struct("point_id", F.array("x", "y", "z").alias("v")))), lambda s: s["v"])  # points of one cell
    cell = p.groupBy("mode", "cell_id").agg(xyz.alias("pts"))
    name, inner = F.concat_ws("_", "cell_id", "mode"), F.create_map(F.lit("dot"), F.col("pts"))
    one = cell.select("mode", F.col("cell_id").alias("cell"), F.to_json(F.create_map(name, inner)).alias("value"))
    one.write.partitionBy("mode", "cell").text(folder)
    return p


@query(f"WITH {POINTS_VEC} SELECT cell_id, mode AS seed, count(*) AS n, round(sum(x), 4) + 0.0 AS sx, round(sum(y), 4) + 0.0 AS sy, round(sum(z), 4) + 0.0 AS sz FROM points GROUP BY ALL")
def a01_read_points(spark, d):
    folder = _folder(spark)
    _positions(spark, d, folder)
    p = A.read_points(spark, f"{folder}/mode=*/cell=*", "dot")
    return p.groupBy("cell_id", "seed").agg(F.count("*").alias("n"), *[(F.round(F.sum(c), 4) + 0.0).alias(f"s{c}") for c in "xyz"])


@query(f"WITH {POINTS_VEC} SELECT mode, cell_id, mode AS seed, count(*) AS n, round(sum(x), 4) + 0.0 AS sx FROM points GROUP BY ALL")
def a03_read_all_modes(spark, d):
    folder = _folder(spark)
    _positions(spark, d, folder)
    p = A.read_all_modes(spark, {m: {"path": f"{folder}/mode={m}/cell=*", "ingredient": "dot"} for m in ("0", "1", "2")})
    return p.groupBy("mode", "cell_id", "seed").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("sx"))


@query("SELECT s_suppkey AS CellId, s_name, s_acctbal FROM supplier")
def a05_ingest_csv(spark, d):
    folder = _folder(spark)
    A.save(table(spark, d, "supplier").select(F.col("s_suppkey").alias("CellId"), "s_name", "s_acctbal"), f"{folder}/csv", "csv")
    return A.ingest_csv(spark, f"{folder}/csv", f"{folder}/parquet", "CellId long, s_name string, s_acctbal double")


@query(f"WITH {SAMPLES_ORDERS} SELECT measure, mode, count(*) AS n, round(sum(value), 3) AS total FROM samples GROUP BY ALL")
def a07_refresh(spark, d):
    """Two rounds: the second adds the missing modes and leaves the first alone."""
    folder, s = _folder(spark), samples_orders(spark, d)
    compute = lambda wanted: s.join(F.broadcast(wanted), ["measure", "mode"], "left_semi").groupBy("measure", "mode").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    modes = sorted(r["mode"] for r in s.select("mode").distinct().collect())  # a handful
    A.refresh(spark, folder, ["price"], modes[:2], compute)
    return A.refresh(spark, folder, ["price"], modes, compute).select("measure", "mode", "n", "total")


@query(f"WITH {POINTS_VEC} SELECT mode, cell_id, count(*) AS vertices, round(sum(x), 3) + 0.0 AS sx, greatest(count(*) - 2, 0) AS triangles FROM points GROUP BY ALL HAVING count(*) >= 3")
def a06_read_meshes(spark, d):
    """One OBJ file per mode and cell: its points as vertices, one polygon over them, read as a fan."""
    folder = _folder(spark)
    p = points_vec(spark, d)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("point_id", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("l")))), lambda s: s["l"])  # points of one cell
    obj = p.groupBy("mode", "cell_id").agg(lines.alias("l"), F.count("*").alias("n")).filter("n >= 3")
    face = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: k.cast("string")), " ")
    obj.select("mode", "cell_id", F.concat(F.lit("# mesh\n"), F.array_join("l", "\n"), F.lit("\nvn 0 0 1\nf "), face).alias("value")).write.partitionBy("mode", "cell_id").text(folder)
    v, t = A.read_meshes(spark, f"{folder}/mode=*/cell_id=*")
    part = lambda c: F.regexp_extract(F.col("_metadata.file_path"), f"{c}=([^/]*)/", 1).alias(c)
    files = spark.read.text(f"{folder}/mode=*/cell_id=*", wholetext=True).select(F.col("_metadata.file_path").alias("file"), part("mode"), part("cell_id"))
    vs = v.groupBy("file").agg(F.count("*").alias("vertices"), (F.round(F.sum("x"), 3) + 0.0).alias("sx"))
    ts = t.groupBy("file").agg(F.count("*").alias("triangles"))
    return files.join(vs, "file").join(ts, "file").select("mode", "cell_id", "vertices", "sx", "triangles")


# --- pipelines -----------------------------------------------------------------------------------


@query()
def q01_distance_analysis(spark, d):
    return Q.distance_analysis(points_vec(spark, d), cells_vec(spark, d), "0", measures=["pairwise", "nearest", "z"], bin_width=2.0)["summary"]


@query()
def q02_occupancy_analysis(spark, d):
    out = Q.occupancy_analysis(*_inputs(spark, d), baseline="1-URGENT", width=W0, pixel=None)
    return out["emd_means"].select("measure", "mode_1", "mode_2", (F.round("mean_emd", 5) + 0.0).alias("mean_emd"))


@query(f"{e03_sql('(floor(value * 7)::BIGINT % 5)::VARCHAR')} {cell_rates_sql(0.4)}")
def q03_randomness_test(spark, d):
    s = samples_items(spark, d)
    sims = s.filter("mode <> 'A'").withColumn("seed", (F.floor(F.col("value") * 7) % 5).cast("string"))
    return _cell_rates(Q.randomness_test(s.filter("mode = 'A'").select("measure", "cell_id", "value"), sims, 40, alpha=0.4))


@query(f"WITH {CV.replace('range(3)', 'range(10)')}, j AS (SELECT repeat, fold, c0, c1 FROM fit WHERE scope = 'joint'), b AS (SELECT * FROM j UNION ALL SELECT NULL, NULL, avg(c0), avg(c1) FROM j) SELECT repeat, fold, m AS mode, CASE WHEN m = 'R' THEN 'radial' ELSE 'uniform' END AS gradient, round(CASE WHEN m = 'R' THEN c1 ELSE c0 END / (c0 + c1), 5) + 0.0 AS weight FROM b, (VALUES ('R'), ('N')) v(m)")
def q04_mixed_rule(spark, d):
    occ, comb = _curves(spark, d)
    out = Q.mixed_rule(occ, comb, MODES2, "A", spark.createDataFrame([("R", "radial"), ("N", "uniform")], "mode string, gradient string"))
    return out["weights"].withColumn("weight", F.round("weight", 5) + 0.0)


@query()
def q04_validation(spark, d):
    """The second priority stands for the mixed rule: mean distances of all pairs of modes and shares of similar samples."""
    out = Q.validate_rule(samples_orders(spark, d), _rounded(spark, d), "1-URGENT", method="asymptotic")["summary"]
    return out.select("kind", "measure", "mode_1", "mode_2", (F.round("value", 5) + 0.0).alias("value"))


_DISTANCE_KS = f"""WITH {SAMPLES_ORDERS}, {base_sql("SELECT '1-URGENT' AS baseline")}, {walk_sql(KSKEYS, 'sides')} SELECT measure, mode, avg(({KSP} >= 0.05)::INT::DOUBLE) AS v FROM walk GROUP BY ALL"""
_OCCUPANCY_KS = ORACLE_SQL["f06_occupancy_ks"].split(" SELECT measure, mode, cell_id, n1, n2")[0] + f" SELECT measure, mode, avg(({KSP} >= 0.05)::INT::DOUBLE) AS v FROM walk GROUP BY ALL"
_OCCUPANCY_EMD = ORACLE_SQL["f05_occupancy_emd"].split(" SELECT p.*, round(emd, 5)")[0] + " SELECT measure, mode_1, mode_2, avg(emd) AS v FROM walk GROUP BY ALL"
ORACLE_SQL["q04_validation"] = f"""SELECT kind, measure, mode_1, mode_2, round(v, 5) + 0.0 AS value FROM (
SELECT 'distance_emd' AS kind, measure, mode_1, mode_2, v FROM ({PAIRS} SELECT measure, mode_1, mode_2, avg(emd) AS v FROM walk GROUP BY ALL)
UNION ALL SELECT 'occupancy_emd', measure, mode_1, mode_2, v FROM ({_OCCUPANCY_EMD})
UNION ALL SELECT 'distance_similar', measure, mode, '1-URGENT', v FROM ({_DISTANCE_KS})
UNION ALL SELECT 'occupancy_similar', measure, mode, '1-URGENT', v FROM ({_OCCUPANCY_KS}))"""


@query()
def q06_variation_distances(spark, d):
    """All pairs inside a level and against the first one, from the whole analysis of a variation."""
    out = Q.variation_analysis(samples_orders(spark, d), "1-URGENT", limits=(0.0, 600.0))["emd_views"]
    return out.select("kind", "mode_1", "cell_id_1", "mode_2", "cell_id_2", r6("emd").alias("emd"))


ORACLE_SQL["q06_variation_distances"] = ORACLE_SQL["f08_emd_views"]


@query()
def q06_variation_rates(spark, d):
    """Rejection rates of all ordered pairs of levels, from the whole analysis of a variation."""
    return _rates(Q.variation_analysis(samples_items(spark, d), "A", n_grid=50)["rates"])


ORACLE_SQL["q06_variation_rates"] = ORACLE_SQL["e07_pairwise_envelope_joint"]


@query()
def q05_colocalisation(spark, d):
    """The urgent orders' cells against two other priorities, one of them as the model with the extra structure."""
    out = Q.colocalisation(T.emd_all_pairs(samples_orders(spark, d)), "1-URGENT", "2-HIGH", "3-MEDIUM")
    exact = ["measure", "n_with", "n_without", "best", "interpretation", "effect"]
    return out.select(*exact, *[r6(c).alias(c) for c in ("mean_with", "mean_without", "mean_difference", "cohens_d", "p_value", "test_statistic", "r_effect")], *[(F.round(c, 4) + 0.0).alias(c) for c in ("aic_with", "aic_without", "weight_with")])


@query(f"""WITH {SAMPLES_ITEMS}, {base_sql("SELECT 'A' AS baseline")}, {walk_sql(KSKEYS, 'sides')}
SELECT measure, mode, count(*) AS n, round(avg(ks), 6) + 0.0 AS mean_ks, round(avg(emd), 6) + 0.0 AS mean_emd, round(avg(({KSP} >= 0.05)::INT::DOUBLE), 6) + 0.0 AS similar_share FROM walk GROUP BY ALL""")
def q06_variation(spark, d):
    """Modes are the levels of a variation; everything is compared with the first level."""
    s = samples_items(spark, d)
    return Q.variation(s, "A", method="asymptotic").select("measure", "mode", "n", r6("mean_ks").alias("mean_ks"), r6("mean_emd").alias("mean_emd"), r6("similar_share").alias("similar_share"))


