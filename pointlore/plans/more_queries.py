"""Operators that other queries only use inside, each on its own."""

import math

from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..model import CELLS_VEC, ORACLE_SQL, POINTS_VEC, SAMPLES_EVENTS, SAMPLES_ITEMS, SAMPLES_ORDERS, cells_vec, points_vec, query, r6, r6_unit, samples_events, samples_orders, table
from ..operators import curves as D
from ..operators import geometry as C
from ..operators import mixture as H
from ..operators import occupancy as G
from ..operators import profiles as P
from ..sources import files as A
from .curve_queries import ecdf_sql, grid_sql, hist_sql, norm_sql
from .space_queries import BIN, COMMON, CURVE, CV, DIST, G3, TARGET, _binned, _curves, _cv, _inputs, _target, fit_sql, profiles, MODES2


@query(f"WITH {SAMPLES_ORDERS} SELECT mode, cell_id, count(*) AS n, round(sum(value), 3) AS total FROM samples GROUP BY ALL")
def a08_save(spark, d):
    path = shared_path(spark, "saved")
    A.save(samples_orders(spark, d), path)
    return spark.read.parquet(path).groupBy("mode", "cell_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {POINTS_VEC}, {CELLS_VEC}, dd AS (SELECT a.mode, a.cell_id, {DIST} / mem_diameter AS v FROM points a JOIN points b ON {G3} AND a.point_id < b.point_id JOIN cells c ON c.cell_id = a.cell_id), n AS (SELECT mode, cell_id, count(*) AS n FROM points GROUP BY ALL)
SELECT n.mode, n.cell_id, i::INT AS i, round(i * (0.5::DOUBLE / 99), 6) + 0.0 AS r, round(coalesce((SELECT count(*) FROM dd WHERE dd.mode = n.mode AND dd.cell_id = n.cell_id AND v <= i * (0.5::DOUBLE / 99)) * {4 / 3 * math.pi}::DOUBLE * 0.125::DOUBLE * 2 / nullif(n * (n - 1), 0), 0), 6) + 0.0 AS k FROM n, range(100) t(i)""")
def c12_ripley_k(spark, d):
    p, c = points_vec(spark, d), cells_vec(spark, d)
    v = p.select(*C.GROUP).distinct().join(c.select("cell_id", F.col("mem_diameter").alias("scale")), "cell_id").withColumn("volume", F.lit(4 / 3 * math.pi) * 0.125)
    return C.ripley_k(p, v).select("mode", "cell_id", "i", r6("r").alias("r"), r6("k").alias("k"))


@query(f"WITH {SAMPLES_EVENTS}, {grid_sql('measure', w=5.0)}, {hist_sql('measure, mode', 'measure', 5.0)}, {norm_sql('measure, mode', 'pdf', 'hist')} SELECT measure, mode, i, round(y, 9) + 0.0 AS y FROM pdf")
def d04_normalize_pdf(spark, d):
    s = samples_events(spark, d)
    h = D.histogram(s, D.r_grid(s, ["measure"], bin_width=5.0), ["measure", "mode"], ["measure"], 5.0)
    return D.normalize_pdf(h, ["measure", "mode"]).select("measure", "mode", "i", (F.round("y", 9) + 0.0).alias("y"))


@query(f"WITH {COMMON} SELECT measure, mode, i, round(coalesce(avg(occupancy), 0), 5) + 0.0 AS mean, round(quantile_cont(coalesce(occupancy, 0), 0.975), 5) + 0.0 AS hi, NULL::DOUBLE AS pooled FROM common GROUP BY ALL")
def g06_combine_occupancy(spark, d):
    """Without the pooled ratio, as the kernel-density variant combines."""
    c = G.combine_occupancy(_binned(spark, d)[0])
    return c.select("measure", "mode", "i", *[(F.round(k, 5) + 0.0).alias(k) for k in ("mean", "hi")], "pooled")


def _kde_sql(keys: str, source: str, name: str) -> str:
    """CTE: Gaussian densities of source(keys, value) on the cells' grid ``kg``."""
    cols = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_s AS (SELECT {keys}, count(*)::DOUBLE AS cnt, pow(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(value) AS h FROM {source} GROUP BY ALL),
{name} AS (SELECT {cols}, g.i, max(g.x) AS x, sum(exp(-((g.x - s.value) / t.h) * ((g.x - s.value) / t.h) / 2)) / (max(t.cnt) * max(t.h) * sqrt(2 * pi())) AS y FROM {source} s JOIN {name}_s t USING ({keys}) JOIN kg g ON g.measure = s.measure AND g.cell_id = s.cell_id GROUP BY {cols}, g.i)"""


@query(f"""WITH {SAMPLES_ORDERS}, av AS (SELECT measure, cell_id, value FROM samples), ke AS (SELECT measure, cell_id, greatest(0.0, min(value)) AS x0, quantile_cont(value, 0.95) AS x1 FROM av GROUP BY ALL), kg AS (SELECT measure, cell_id, i::INT AS i, x0 + i * ((x1 - x0) / 39) AS x FROM ke, range(40) r(i)),
{_kde_sql('measure, cell_id', 'av', 'ka')}, occ AS (SELECT measure, mode, cell_id, value FROM samples), {_kde_sql('measure, mode, cell_id', 'occ', 'ko')}, {norm_sql('measure, cell_id', 'na', 'ka')}, {norm_sql('measure, mode, cell_id', 'no', 'ko')}
SELECT no.measure, no.mode, no.cell_id, no.i, round(no.x, 6) + 0.0 AS x, round(exp(ln(greatest(no.y, 1e-10)) - ln(greatest(na.y, 1e-10))), 5) + 0.0 AS occupancy FROM no JOIN na ON na.measure = no.measure AND na.cell_id = no.cell_id AND na.i = no.i""")
def g08_kde_occupancy_cell(spark, d):
    occ, av, _ = G.occupied_available(*_inputs(spark, d), pixel=None)
    o = G.kde_occupancy_cell(occ, av, 40)
    return o.select("measure", "mode", "cell_id", "i", r6("x").alias("x"), (F.round("occupancy", 5) + 0.0).alias("occupancy"))


@query(f"WITH {CURVE} SELECT measure, i, round(avg(y), 8) + 0.0 AS b FROM oc WHERE mode = 'A' GROUP BY ALL")
def h02_mean_curve(spark, d):
    occ, comb = _curves(spark, d)
    cells, _ = H.baseline_cells(occ, "A")
    return H.mean_curve(occ, cells, H.baseline_grid(comb, "A"), "A", []).select("measure", "i", (F.round("b", 8) + 0.0).alias("b"))


@query(f"WITH {CURVE}, {TARGET}, {fit_sql('tg', '')} SELECT f.scope, o.cell_id, round(avg((o.y - c0 * a0 - c1 * a1) * (o.y - c0 * a0 - c1 * a1)), 8) + 0.0 AS test_mse FROM oc o JOIN mat USING (measure, i) JOIN fit f ON f.scope = o.measure OR f.scope = 'joint' WHERE o.mode = 'A' GROUP BY ALL")
def h06_evaluate(spark, d):
    """The fit's error on every cell by itself."""
    occ, comb = _curves(spark, d)
    grid, target, matrix = _target(occ, comb)
    coefs, _ = H.fit_mixture(target, matrix, MODES2, [])
    cells, _ = H.baseline_cells(occ, "A")
    e = H.evaluate(occ, coefs, matrix, grid, cells, MODES2, "A", [], "cell")
    return e.select("scope", "cell_id", (F.round("test_mse", 8) + 0.0).alias("test_mse"))


@query(f"WITH {CV} SELECT scope, m AS mode, round(avg(CASE WHEN m = 'N' THEN c0 ELSE c1 END), 5) + 0.0 AS coef_mean, round(stddev_pop(CASE WHEN m = 'N' THEN c0 ELSE c1 END), 5) + 0.0 AS coef_std FROM fit, (VALUES ('N'), ('R')) v(m) GROUP BY ALL")
def h08_cv_coefficients(spark, d):
    s = H.cv_summary(_cv(spark, d)[0])[0]
    return s.select("scope", "mode", (F.round("coef_mean", 5) + 0.0).alias("coef_mean"), (F.round("coef_std", 5) + 0.0).alias("coef_std"))


@query(f"""WITH {CURVE}, {TARGET}, {fit_sql('tg', '')}, m AS (SELECT scope, 'single:N' AS model, n, 1 AS k, rss0 AS rss FROM fit UNION ALL SELECT scope, 'single:R', n, 1, rss1 FROM fit UNION ALL SELECT scope, 'mixed', n, 2, rss FROM fit),
a AS (SELECT *, n * ln(rss / n) + 2 * (k + 1) AS aic FROM m) SELECT scope, model, round((aic - min(aic) OVER (PARTITION BY scope)) / 2, 2) + 0.0 AS log_evidence_ratio FROM a""")
def h14_evidence(spark, d):
    """Evidence ratios in logarithms, of all models but the null."""
    _, target, matrix = _target(*_curves(spark, d))
    t = H.comparison_table(H.compare_candidates(target, matrix, MODES2)).filter("model <> 'null'")
    from pyspark.sql import Window

    return t.select("scope", "model", (F.round((F.col("aic") - F.min("aic").over(Window.partitionBy("scope"))) / 2, 2) + 0.0).alias("log_evidence_ratio"))


@query(f"WITH {BIN} SELECT id_1, id_2, CAST(a.label AS VARCHAR) AS structure_1, CAST(b.label AS VARCHAR) AS structure_2, round(r, 6) + 0.0 AS r FROM rr JOIN embeddings a ON a.vec_id = id_1 JOIN embeddings b ON b.vec_id = id_2")
def p06_correlation_pairs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("label").cast("string").alias("structure"), F.lit("r").alias("rule"), F.col("vec_id").alias("cell_id"))
    return P.correlation_pairs(profiles(spark, d), e).select("id_1", "id_2", "structure_1", "structure_2", r6_unit("r").alias("r"))


@query(f"WITH {POINTS_VEC} SELECT cell_id, mode AS seed, count(*) AS n, round(sum(x), 4) + 0.0 AS sx FROM points GROUP BY ALL")
def a02_read_point_files(spark, d):
    """Simulated positions: a file for every cell, its name ending in the cell, its keys the seeds; files of another rule and inverted ones are left out."""
    folder = shared_path(spark, "files")
    p = points_vec(spark, d)
    xyz = F.transform(F.sort_array(F.collect_list(F.struct("point_id", F.array("x", "y", "z").alias("v")))), lambda s: s["v"])  # points of one cell and mode
    cell = p.groupBy("mode", "cell_id").agg(xyz.alias("pts")).groupBy("cell_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("mode", F.create_map(F.lit("dot"), F.col("pts")))))).alias("value"))
    rules = F.explode(F.array(*[F.lit(r) for r in ("near", "near_invert", "far")]))
    cell.withColumn("rule", rules).select("value", F.concat(F.lit("positions_"), "rule", F.lit("_"), "cell_id", F.lit(".json")).alias("file")).write.partitionBy("file").text(folder)
    got = A.read_point_files(spark, folder, "near", "dot")
    return got.groupBy("cell_id", "seed").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("sx"))


@query("SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS type, CASE column_name WHEN 's_name' THEN 'name of the supplier' ELSE '' END AS description FROM (DESCRIBE SELECT * FROM supplier)")
def k08_column_metadata(spark, d):
    from ..operators import catalog as K

    return K.column_metadata(table(spark, d, "supplier"), {"s_name": "name of the supplier"})


THREE = ["2-HIGH", "3-MEDIUM", "5-LOW"]


def _three_sql() -> str:
    """Non-negative least squares of three columns by trying every set of columns, each solved in closed form."""
    g = lambda p, q: f"g{min(p, q)}{max(p, q)}"
    tries = ["SELECT measure, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM su"]
    for p in range(3):
        tries.append(f"SELECT measure, {', '.join((f'r{p} / {g(p, p)}' if j == p else '0') + f' AS c{j}' for j in range(3))} FROM su")
    for p, q in ((0, 1), (0, 2), (1, 2)):
        det = f"({g(p, p)} * {g(q, q)} - {g(p, q)} * {g(p, q)})"
        one = {p: f"(r{p} * {g(q, q)} - r{q} * {g(p, q)}) / {det}", q: f"(r{q} * {g(p, p)} - r{p} * {g(p, q)}) / {det}"}
        tries.append(f"SELECT measure, {', '.join(one.get(j, '0') + f' AS c{j}' for j in range(3))} FROM su")
    rows = [[g(i, j) for j in range(3)] for i in range(3)]
    det3 = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    put = lambda k: [[f"r{i}" if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    tries.append(f"SELECT measure, {', '.join(f'{det3(put(k))} / {det3(rows)} AS c{k}' for k in range(3))} FROM su")
    rss = "bb - 2 * (c0 * r0 + c1 * r1 + c2 * r2) + " + " + ".join(f"c{p} * c{q} * {g(p, q)}" for p in range(3) for q in range(3))
    sums = ", ".join([f"sum(a{p} * a{q}) AS {g(p, q)}" for p in range(3) for q in range(p, 3)] + [f"sum(a{p} * b) AS r{p}" for p in range(3)])
    return f"""WITH {SAMPLES_ORDERS}, {grid_sql('measure', w=20.0)}, {hist_sql('measure, mode, cell_id', 'measure', 20.0)}, oc AS (SELECT measure, mode, cell_id, i, y / sum(y) OVER (PARTITION BY measure, mode, cell_id) AS y FROM hist),
me AS (SELECT measure, mode, i, avg(y) AS y FROM oc GROUP BY ALL), wide AS (SELECT measure, i, {', '.join(f"max(y) FILTER (mode = '{m}') AS a{j}" for j, m in enumerate(THREE))}, max(y) FILTER (mode = '1-URGENT') AS b FROM me GROUP BY ALL),
su AS (SELECT measure, {sums}, sum(b * b) AS bb FROM wide GROUP BY 1), tries AS ({' UNION ALL '.join(tries)}),
best AS (SELECT measure, arg_min(c0, rss) AS c0, arg_min(c1, rss) AS c1, arg_min(c2, rss) AS c2 FROM (SELECT t.*, {rss} AS rss FROM tries t JOIN su USING (measure) WHERE c0 >= 0 AND c1 >= 0 AND c2 >= 0) GROUP BY 1)
SELECT scope, m AS mode, round(CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END, 4) + 0.0 AS coef FROM best, (VALUES {', '.join(f"({k}, '{m}')" for k, m in enumerate(THREE))}) v(k, m), (SELECT unnest([measure, 'joint']) AS scope FROM best)"""


@query(_three_sql())
def h04_fit_three_modes(spark, d):
    """Three columns: the solver for more than two. One measure, so the joint fit is the same."""
    from pyspark.sql import Window

    s = samples_orders(spark, d)
    h = D.histogram(s, D.r_grid(s, ["measure"], bin_width=20.0), ["measure", "mode", "cell_id"], ["measure"], 20.0)
    occ = h.withColumn("occupancy", F.col("y") / F.sum("y").over(Window.partitionBy("measure", "mode", "cell_id")))
    comb = occ.groupBy("measure", "mode", "i").agg(F.max("x").alias("x"), F.avg("occupancy").alias("occupancy"))
    grid = H.baseline_grid(comb, "1-URGENT")
    target = comb.filter("mode = '1-URGENT'").select("measure", "i", F.col("occupancy").alias("b"))
    coefs, _ = H.fit_mixture(target, H.design(comb, grid, THREE), THREE, [])
    return coefs.select("scope", "mode", (F.round("coef", 4) + 0.0).alias("coef"))


# SQL for queries registered elsewhere, with the helpers of this module.
ORACLE_SQL["g10_occupancy_kde"] = f"""WITH {SAMPLES_ORDERS}, av AS (SELECT measure, cell_id, value FROM samples), tp AS (SELECT measure, cell_id, max(value) AS top, quantile_cont(value, 0.95) AS p95 FROM av GROUP BY ALL),
e AS (SELECT measure, quantile_cont(top, 1.0) AS x1 FROM tp GROUP BY 1), kg AS (SELECT measure, cell_id, i::INT AS i, i * (x1 / 49) AS x FROM e JOIN tp USING (measure), range(50) r(i)),
{_kde_sql('measure, cell_id', 'av', 'ka')}, occ AS (SELECT measure, mode, cell_id, value FROM samples), {_kde_sql('measure, mode, cell_id', 'occ', 'ko')}, {norm_sql('measure, cell_id', 'na', 'ka')}, {norm_sql('measure, mode, cell_id', 'no', 'ko')}
SELECT no.measure, no.mode, no.cell_id, no.i, round(no.x, 6) + 0.0 AS x, round(CASE WHEN no.x <= p95 THEN exp(ln(greatest(no.y, 1e-10)) - ln(greatest(na.y, 1e-10))) END, 5) + 0.0 AS occupancy FROM no JOIN na ON na.measure = no.measure AND na.cell_id = no.cell_id AND na.i = no.i JOIN tp ON tp.measure = no.measure AND tp.cell_id = no.cell_id"""

# Each curve once: counts by the first grid point that a value does not exceed, then a running sum.
ORACLE_SQL["d13_joint_curves"] = f"""WITH {SAMPLES_ITEMS}, {grid_sql('measure', n=60)},
first AS (SELECT s.*, g.x0, g.step, greatest(0, ceil((value - g.x0) / g.step))::INT AS about FROM samples s JOIN grid_s g USING (measure)),
hits AS (SELECT measure, mode, cell_id, seed, CASE WHEN about > 0 AND x0 + (about - 1) * step >= value THEN about - 1 WHEN x0 + about * step < value THEN about + 1 ELSE about END AS i, count(*) AS c FROM first GROUP BY ALL),
groups AS (SELECT measure, mode, cell_id, seed, count(*) AS n FROM samples GROUP BY ALL),
curve AS MATERIALIZED (SELECT measure, mode, cell_id, seed, i, x, sum(coalesce(c, 0)) OVER (PARTITION BY measure, mode, cell_id, seed ORDER BY i) / n::DOUBLE AS y
  FROM (SELECT p.measure, mode, cell_id, seed, p.n, g.i, g.x FROM groups p JOIN grid g ON g.measure = p.measure) LEFT JOIN hits USING (measure, mode, cell_id, seed, i)), t AS (SELECT j, j * 59 / 39.0::DOUBLE AS t, least(floor(j * 59 / 39.0::DOUBLE), 58)::INT AS k FROM range(40) r(j)),
no AS (SELECT measure, row_number() OVER (ORDER BY measure) - 1 AS no FROM (SELECT DISTINCT measure FROM samples)),
pairs AS MATERIALIZED (SELECT *, lead(y) OVER (PARTITION BY measure, mode, cell_id, seed ORDER BY i) AS y2 FROM curve)
SELECT a.mode, a.cell_id, a.seed, (no * 40 + j)::INT AS i, round(no + j / 39.0::DOUBLE, 6) + 0.0 AS x, round(a.y + (a.y2 - a.y) * (t - k), 6) + 0.0 AS y
FROM t JOIN pairs a ON a.i = k JOIN no ON no.measure = a.measure"""

ORACLE_SQL["q02_occupancy_analysis"] = ORACLE_SQL["f05_occupancy_emd"].split(" SELECT p.*, round(emd, 5)")[0] + " SELECT measure, mode_1, mode_2, round(avg(emd), 5) + 0.0 AS mean_emd FROM walk GROUP BY ALL"

_DISTANCES = f"""WITH {POINTS_VEC}, {CELLS_VEC}, samples AS (SELECT 'pairwise' AS measure, a.mode, a.cell_id, '0' AS seed, {DIST} AS value FROM points a JOIN points b ON {G3} AND a.point_id < b.point_id
UNION ALL SELECT 'nearest', mode, cell_id, '0', v FROM (SELECT a.mode, a.cell_id, a.point_id, min({DIST}) AS v FROM points a JOIN points b ON {G3} AND a.point_id <> b.point_id GROUP BY ALL)
UNION ALL SELECT 'z', mode, cell_id, '0', abs(z - mem_z_min) FROM points JOIN cells USING (cell_id)),"""
ORACLE_SQL["q01_distance_analysis"] = ORACLE_SQL["f09_emd_summary"].replace(f"WITH {SAMPLES_ORDERS},", _DISTANCES)
