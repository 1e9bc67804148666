"""Queries of filters, expressions, catalogues and summaries (B, K, A, part of F)."""

from pyspark.sql import functions as F

from ..model import CELLS_VEC, POINTS_VEC, SAMPLES_EVENTS, SAMPLES_ITEMS, SAMPLES_ORDERS, cells_vec, modes_of, points_vec, query, r6, samples_events, samples_items, samples_orders, table
from ..operators import catalog as K
from ..operators import expressions as B
from ..operators import twosample as T
from ..sources import files as A

P = 0.108


@query(f"WITH {SAMPLES_ITEMS} SELECT measure, mode, count(*) AS n, round(sum(value), 3) AS total FROM samples WHERE value >= 5 GROUP BY ALL")
def b01_valid_samples(spark, d):
    return B.valid_samples(samples_items(spark, d), 5.0).groupBy("measure", "mode").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {SAMPLES_EVENTS}, g AS (SELECT DISTINCT measure, mode, cell_id, seed FROM samples)
SELECT * FROM g ANTI JOIN (SELECT DISTINCT measure, mode, cell_id, seed FROM samples WHERE value >= 100) USING (measure, mode, cell_id, seed)""")
def b02_emptied_groups(spark, d):
    return B.filter_samples(samples_events(spark, d), 100.0)[1]


@query(f"""WITH {POINTS_VEC}, {CELLS_VEC}, samples AS (SELECT 'z' AS measure, mode, cell_id, seed, abs(z) AS value FROM points)
SELECT measure, mode, s.cell_id, round(sum(value / coalesce(intracellular_radius, 1.0)), 6) + 0.0 AS total, count(*) AS n
FROM samples s LEFT JOIN cells c ON c.cell_id = s.cell_id AND c.cell_id <> '7' GROUP BY ALL""")
def b04_normalize_samples(spark, d):
    """Cell 7 has no shape facts and keeps factor 1."""
    s = points_vec(spark, d).select(F.lit("z").alias("measure"), "mode", "cell_id", "seed", F.abs("z").alias("value"))
    cells = cells_vec(spark, d).filter("cell_id <> '7'").withColumn("structure_id", F.lit("S1"))
    out = B.normalize_samples(s, cells, modes_of(s), "intracellular_radius")
    return out.groupBy("measure", "mode", "cell_id").agg(r6(F.sum("value")).alias("total"), F.count("*").alias("n"))


@query(f"""WITH {SAMPLES_ITEMS}, m AS (SELECT *, max(value) OVER (PARTITION BY measure, mode, cell_id, seed) AS f FROM samples)
SELECT measure, mode, cell_id, round(avg(value / f), 6) + 0.0 AS mean FROM m GROUP BY ALL""")
def b03_norm_factor_max(spark, d):
    s = samples_items(spark, d)
    return B.normalize_samples(s, None, None, "max_distance").groupBy("measure", "mode", "cell_id").agg(r6(F.avg("value")).alias("mean"))


@query(f"WITH {SAMPLES_ORDERS} SELECT measure, cell_id, count(*) AS n, round(avg(value / m), 6) + 0.0 AS mean FROM (SELECT *, max(value) OVER (PARTITION BY measure, cell_id) AS m FROM samples) WHERE value / m >= 0.1 GROUP BY ALL")
def b05_normalize_available(spark, d):
    a = samples_orders(spark, d).select("measure", F.lit("S1").alias("structure_id"), "cell_id", "value")
    cells = a.select("structure_id", "cell_id").distinct()
    return B.normalize_available(a, cells, "max_distance", 0.1).groupBy("measure", "cell_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"SELECT l_suppkey, round(sum(l_quantity * {P}), 4) AS length, round(sum(l_quantity * {P} * {P}), 4) AS area, round(sum(l_quantity * {P} * {P} * {P}), 4) AS volume FROM lineitem GROUP BY 1")
def b06_to_um(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.round(F.sum(B.to_um(q, k)), 4).alias(n) for k, n in ((1, "length"), (2, "area"), (3, "volume"))])


@query("""SELECT c_custkey, coalesce(n_name, CAST(k AS VARCHAR)) AS label FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END AS k FROM customer) c LEFT JOIN nation ON n_nationkey = k""")
def b07_labels(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, 99).otherwise(F.col("c_nationkey")).cast("string").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return B.with_labels(c, n, "k", "n_name").select("c_custkey", "label")


STEMS = "concat('results_', replace(lower(p_brand), '#', ''), '_norm_', p_partkey, CASE WHEN p_size % 2 = 0 THEN '_seed_x' ELSE '' END, '_seed_', p_size)"


@query(f"""SELECT p_partkey, regexp_replace(regexp_replace(s, concat('^results_', replace(lower(p_brand), '#', ''), '_norm_'), ''), '_seed_[^_]*$', '') AS cell_id FROM (SELECT *, {STEMS} AS s FROM part)""")
def b08_cell_id_from_stem(spark, d):
    p = table(spark, d, "part").withColumn("s", F.expr(STEMS)).withColumn("packing", F.expr("replace(lower(p_brand), '#', '')"))
    # The prefix is a column here; each file has its own.
    stripped = F.expr("regexp_replace(s, concat('^results_', packing, '_norm_'), '')")
    return p.select("p_partkey", B.cell_id_from_stem(stripped, "none", "none").alias("cell_id"))


NAMES = "concat('run_analyze_', replace(p_type, ' ', '-'), '_', p_partkey, '_', 'x', '_', p_size, '_pilr.npy')"


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS cell_id, replace(p_type, ' ', '-') AS channel, CAST(p_size AS VARCHAR) AS seed FROM part")
def b09_profile_name(spark, d):
    p = table(spark, d, "part").withColumn("_n", B.parse_profile_name(F.expr(NAMES)))
    return p.select("p_partkey", "_n.*")


@query(f"""WITH {POINTS_VEC}, s AS (SELECT cell_id, point_id, abs(z) / max(abs(z)) OVER (PARTITION BY cell_id) AS s FROM points), w AS (SELECT *, exp(-s / 0.5) AS w FROM s)
SELECT cell_id, point_id, round(w / max(w) OVER (PARTITION BY cell_id), 6) + 0.0 AS weight, round(1 - s, 6) + 0.0 AS linear FROM w""")
def b10_decay_weights(spark, d):
    p = points_vec(spark, d).select("cell_id", "point_id", F.abs("z").alias("distance"))
    w = B.decay_weights(p, 0.5, ["cell_id"])
    return w.join(B.decay_weights(p, None, ["cell_id"]).select("point_id", F.col("weight").alias("l")), "point_id").select("cell_id", "point_id", r6("weight").alias("weight"), r6("l").alias("linear"))


@query("""SELECT p_partkey, round(CASE WHEN p_size > 3 THEN p_retailprice / p_size END, 6) + 0.0 AS unit_volume, round(CASE WHEN p_size > 3 THEN cbrt(3 * (p_retailprice / p_size) / (4 * pi())) END, 6) + 0.0 AS radius,
round(pow(pi(), 1 / 3.0::DOUBLE) * pow(6 * p_retailprice, 2 / 3.0::DOUBLE) / (p_size * 10), 6) + 0.0 AS mem_sphericity FROM part""")
def b11_structure_stats(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).otherwise(0).alias("count"), F.col("p_retailprice").alias("volume"), F.col("p_retailprice").alias("mem_volume"), (F.col("p_size") * 10).alias("mem_area"))
    return B.structure_stats(p).select("p_partkey", *[r6(c).alias(c) for c in ("unit_volume", "radius", "mem_sphericity")])


@query(f"WITH {POINTS_VEC}, {CELLS_VEC} SELECT cell_id, round(cell_height, 6) + 0.0 AS cell_height, round(nuc_height, 6) + 0.0 AS nuc_height, round(mem_diameter, 6) + 0.0 AS mem_diameter, round(nuc_diameter, 6) + 0.0 AS nuc_diameter, round(intracellular_radius, 6) + 0.0 AS intracellular_radius FROM cells")
def b12_cell_metrics(spark, d):
    return cells_vec(spark, d).select("cell_id", *[r6(c).alias(c) for c in ("cell_height", "nuc_height", "mem_diameter", "nuc_diameter", "intracellular_radius")])


@query(f"WITH {POINTS_VEC} SELECT point_id, round(sqrt((x - 1) * (x - 1) + y * y + z * z), 6) + 0.0 AS r, round(atan2(sqrt((x - 1) * (x - 1) + y * y), z), 6) + 0.0 AS theta, round(atan2(y, x - 1), 6) + 0.0 AS phi FROM points")
def b13_spherical(spark, d):
    return B.to_spherical(points_vec(spark, d), (1.0, 0.0, 0.0)).select("point_id", *[r6(c).alias(c) for c in ("r", "theta", "phi")])


@query(f"""WITH {POINTS_VEC}, b AS (SELECT cell_id, min(x) AS lo, max(x) AS hi FROM points GROUP BY 1)
SELECT cell_id, sign(lo) * ceil(abs(lo)) + 0.0 AS lo_out, sign(hi) * ceil(abs(hi)) + 0.0 AS hi_out, round((lo + hi) / 2 - (hi - lo) / 2 * 1.2, 6) + 0.0 AS lo_big, round((lo + hi) / 2 + (hi - lo) / 2 * 1.2, 6) + 0.0 AS hi_big FROM b""")
def b14_boxes(spark, d):
    b = points_vec(spark, d).groupBy("cell_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = B.expand_box(F.col("lo"), F.col("hi"), 1.2)
    return b.select("cell_id", (B.round_out(F.col("lo")) + 0.0).alias("lo_out"), (B.round_out(F.col("hi")) + 0.0).alias("hi_out"), r6(lo).alias("lo_big"), r6(hi).alias("hi_big"))


@query("""SELECT event_id, CASE WHEN abs(e) >= 0.8 THEN 'Large' WHEN abs(e) >= 0.5 THEN 'Medium' WHEN abs(e) >= 0.2 THEN 'Small' ELSE 'Negligible' END AS effect,
CASE WHEN value <= 2 THEN 'Both models have substantial support' WHEN value <= 7 THEN 'Considerably less support for losing model' WHEN value <= 10 THEN 'Little support for losing model' ELSE 'Essentially no support for losing model' END AS support
FROM (SELECT *, value / 100 - 0.5 AS e FROM events)""")
def b15_labels(spark, d):
    return table(spark, d, "events").select("event_id", B.effect_label(F.col("value") / 100 - 0.5).alias("effect"), B.support_label(F.col("value")).alias("support"))


@query(f"WITH {SAMPLES_ITEMS} SELECT mode, count(DISTINCT cell_id) AS cells, count(DISTINCT cell_id || '|' || seed) AS seeds FROM samples GROUP BY 1")
def a10_point_inventory(spark, d):
    return A.point_inventory(samples_items(spark, d))


@query(f"""WITH {SAMPLES_ORDERS}, req AS (SELECT * FROM (VALUES ('price'), ('weight')) m(measure), (SELECT DISTINCT mode FROM samples))
SELECT measure, mode FROM req ANTI JOIN (SELECT DISTINCT measure, mode FROM samples WHERE mode < '3') USING (measure, mode)""")
def a07_missing_pairs(spark, d):
    s = samples_orders(spark, d)
    return A.missing_pairs(spark.createDataFrame([("price",), ("weight",)], "measure string"), s.select("mode"), s.filter("mode < '3'"))


@query(f"""WITH {SAMPLES_ORDERS}, have AS (SELECT DISTINCT measure, mode, cell_id FROM samples), want AS (SELECT measure, mode, 'F' AS cell_id FROM have UNION SELECT measure, mode, 'X' FROM have)
SELECT *, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""")
def a09_check_complete(spark, d):
    s = samples_orders(spark, d)
    want = s.select("measure", "mode").distinct().withColumn("cell_id", F.explode(F.array(F.lit("F"), F.lit("X"))))
    return A.check_complete(s, want, ["value"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def a04_load_table(spark, d):
    return A.load_table(spark, "events", [f"{d}/nowhere", d]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


SUPPLIERS = "SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, n_name AS structure_name, s_acctbal > 0 AS sphere FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _catalog(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("CellId"), F.col("n_name").alias("structure_name"), (F.col("s_acctbal") > 0).alias("8dsphere"), F.col("s_acctbal").alias("radius"), (F.col("s_suppkey") % 7).cast("double").alias("count"), (F.col("s_acctbal") * 2).alias("volume"))


@query(f"SELECT cell_id FROM ({SUPPLIERS}) WHERE sphere AND structure_name = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def k01_cells_for(spark, d):
    c = _catalog(spark, d)
    return K.cells_for(c, c.agg(F.min("structure_name")).first()[0], True)


@query(f"SELECT cell_id FROM ({SUPPLIERS}) ORDER BY md5('0|' || cell_id), cell_id LIMIT 25")
def k02_sample_cells(spark, d):
    return K.sample_cells(_catalog(spark, d).select(F.col("CellId").cast("string").alias("cell_id")), 25)


@query("SELECT c_custkey, n_name AS structure_name FROM customer JOIN nation ON c_nationkey = n_nationkey SEMI JOIN (SELECT s_suppkey, s_nationkey FROM supplier) s ON s.s_suppkey = c_custkey AND s.s_nationkey = c_nationkey")
def k03_restrict(spark, d):
    meta = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("CellId"), F.col("n_name").alias("structure_name"))
    return K.restrict(meta, _catalog(spark, d)).select(F.col("CellId").alias("c_custkey"), "structure_name")


@query("""SELECT n_name AS structure_name, round(avg(s_acctbal), 6) + 0.0 AS radius_mean, round(stddev_samp(s_acctbal), 6) + 0.0 AS radius_std, round(avg(s_suppkey % 7), 6) + 0.0 AS count_mean, round(stddev_samp(s_suppkey % 7), 6) + 0.0 AS count_std,
round(avg(s_acctbal * 2), 6) + 0.0 AS volume_mean, round(stddev_samp(s_acctbal * 2), 6) + 0.0 AS volume_std FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def k04_structure_summary(spark, d):
    s = K.structure_summary(_catalog(spark, d))
    return s.select("structure_name", *[r6(c).alias(c) for c in s.columns[1:]])


@query("""SELECT l_suppkey, metric, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, min(v) AS lo, max(v) AS hi FROM (
SELECT l_suppkey, 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT l_suppkey, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2""")
def k05_metric_summary(spark, d):
    m = K.metric_summary(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], ["l_suppkey"])
    return m.select("l_suppkey", "metric", "n", r6("mean").alias("mean"), r6("std").alias("std"), "lo", "hi")


@query("""WITH e AS (SELECT l_suppkey, min(l_extendedprice) AS lo, greatest(1, ceil((max(l_extendedprice) - min(l_extendedprice)) / 4000.0::DOUBLE))::INT AS bins FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey, unnest(range(bins)) AS bin, lo, bins FROM e)
SELECT b.l_suppkey, bin::INT AS bin, round(lo + bin * 4000.0::DOUBLE, 6) + 0.0 AS "left", count(l_extendedprice) AS "count"
FROM b LEFT JOIN lineitem l ON l.l_suppkey = b.l_suppkey AND (l_extendedprice >= lo + bin * 4000.0::DOUBLE OR bin = 0) AND (l_extendedprice < lo + (bin + 1) * 4000.0::DOUBLE OR bin = bins - 1) GROUP BY ALL""")
def k05_metric_histogram(spark, d):
    h = K.metric_histogram(table(spark, d, "lineitem"), "l_extendedprice", ["l_suppkey"], 4000.0)
    return h.select("l_suppkey", "bin", r6("left").alias("left"), "count")


@query(f"""WITH f AS (SELECT *, {STEMS} AS stem, replace(lower(p_brand), '#', '') AS packing FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(stem, concat('^results_', packing, '_norm_'), ''), '_seed_[^_]*$', '') AS cell_id, split_part(p_type, ' ', 1) AS rule_short, round(s_acctbal, 2) AS radius
FROM f LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = regexp_replace(regexp_replace(stem, concat('^results_', packing, '_norm_'), ''), '_seed_[^_]*$', '')""")
def k06_release_table(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.expr(STEMS).alias("stem"), F.expr("replace(lower(p_brand), '#', '')").alias("packing"), F.lit("norm").alias("condition"), F.lit("all").alias("structure_name"), F.regexp_replace("p_type", " ", "_").alias("rule"))
    stats = table(spark, d, "supplier").select(F.lit("all").alias("structure_name"), F.col("s_suppkey").cast("string").alias("CellId"), F.col("s_acctbal").alias("radius"))
    r = K.release_table(f, stats, f.select("structure_name").distinct())
    return r.select("p_partkey", F.col("CellId").alias("cell_id"), "rule_short", "radius")


@query("SELECT c_custkey, c_name, s_acctbal AS radius FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def k07_refresh_stats(spark, d):
    cat = table(spark, d, "customer").select(F.lit("all").alias("structure_name"), F.col("c_custkey").alias("CellId"), "c_name", F.lit(0.0).alias("radius"))
    stats = table(spark, d, "supplier").select(F.lit("all").alias("structure_name"), F.col("s_suppkey").alias("CellId"), F.col("s_acctbal").alias("radius"))
    return K.refresh_stats(cat, stats, ["radius"]).select(F.col("CellId").alias("c_custkey"), "c_name", "radius")


EXPECTED = "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS item, s AS seed FROM customer, (VALUES ('F'), ('O')) v(s)"
PRESENT = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item, o_orderstatus AS seed FROM orders"


def _work(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("seed"))
    return e, table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item"), F.col("o_orderstatus").alias("seed"))


@query(f"SELECT item, seed FROM ({EXPECTED}) ANTI JOIN ({PRESENT}) USING (item, seed)")
def k09_missing_work(spark, d):
    return K.missing_work(*_work(spark, d))[0]


@query(f"SELECT item, count(*) AS expected, count(p) AS present, count(p) = count(*) AS done FROM ({EXPECTED}) LEFT JOIN (SELECT *, 1 AS p FROM ({PRESENT})) USING (item, seed) GROUP BY 1")
def k09_done(spark, d):
    return K.missing_work(*_work(spark, d))[1]


@query("""WITH e AS (SELECT c_mktsegment AS rule, c_custkey AS item FROM customer WHERE c_acctbal > 0), r AS (SELECT c_mktsegment AS rule, c_custkey AS item, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM customer WHERE c_nationkey < 20)
SELECT coalesce(e.rule, r.rule) AS rule, CASE WHEN status IS NULL THEN 'missing' WHEN e.item IS NULL THEN 'unexpected' ELSE status END AS status, count(*) AS n FROM e FULL JOIN r ON e.rule = r.rule AND e.item = r.item GROUP BY 1, 2""")
def k10_outcomes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("rule"), F.col("c_custkey").alias("item"), "c_acctbal", "c_nationkey")
    return K.outcome_summary(c.filter("c_acctbal > 0"), c.filter("c_nationkey < 20").withColumn("status", F.when(F.col("item") % 3 == 0, "failed").otherwise("succeeded")))


@query("SELECT r_name AS rule, CAST(c_custkey AS VARCHAR) AS cell_id, 0 AS replicate, CAST(c_custkey AS BIGINT) AS seed, s_suppkey % 7 AS count, s_acctbal AS radius FROM customer CROSS JOIN region LEFT JOIN supplier ON s_suppkey = c_custkey")
def k11_run_parameters(spark, d):
    rules = table(spark, d, "region").select(F.col("r_name").alias("rule"))
    cells = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"))
    stats = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("cell_id"), (F.col("s_suppkey") % 7).alias("count"), F.col("s_acctbal").alias("radius"))
    return K.run_parameters(rules, cells, stats).select("rule", "cell_id", "replicate", "seed", "count", "radius")


@query(f"""WITH {SAMPLES_EVENTS} SELECT measure, mode, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, round(quantile_cont(value, 0.5), 6) + 0.0 AS median,
round(quantile_cont(value, 0.025), 6) + 0.0 AS lo, round(quantile_cont(value, 0.975), 6) + 0.0 AS hi FROM samples WHERE value >= 1 GROUP BY ALL""")
def f11_distance_summary(spark, d):
    s = T.distance_summary(samples_events(spark, d), minimum=1.0)
    return s.select("measure", "mode", "n", *[r6(c).alias(c) for c in ("mean", "std", "median", "lo", "hi")])


@query("""WITH s AS (SELECT l_suppkey, count(l_tax) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2,
var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0.0 AS d FROM s""")
def f13_cohens_d(spark, d):
    o = T.cohens_d(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice", ["l_suppkey"])
    return o.select("l_suppkey", r6("d").alias("d"))


def _mann_whitney(df, side, a, b, value, key):
    return T.mann_whitney(df, side, a, b, value, [key]).select(key, *[r6(c).alias(c) for c in ("u", "z", "p_value", "rank_biserial")])


def _wilcoxon(df, key):
    return T.wilcoxon(df, "a", "b", [key]).select(key, *[r6(c).alias(c) for c in ("statistic", "z", "p_value", "effect")])


@query()
def f14_mann_whitney(spark, d):
    """Hundreds of tied values a side: the normal p-value."""
    return _mann_whitney(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity", "l_suppkey")


@query()
def f14_mann_whitney_small(spark, d):
    """A few orders a customer, rarely tied: the counted p-value."""
    return _mann_whitney(table(spark, d, "orders"), "o_orderstatus", "O", "F", "o_totalprice", "o_custkey")


@query()
def f15_wilcoxon(spark, d):
    """Hundreds of tied differences, zeros among them: the normal p-value."""
    return _wilcoxon(table(spark, d, "lineitem").withColumn("a", F.round(F.col("l_quantity") - 25 - F.col("l_tax") * 100, 6)).withColumn("b", F.lit(0.0)), "l_suppkey")


@query()
def f15_wilcoxon_small(spark, d):
    """A few orders a customer: the counted p-value."""
    return _wilcoxon(table(spark, d, "orders").withColumn("a", F.col("o_totalprice")).withColumn("b", F.lit(150000.0)), "o_custkey")


@query("""WITH g AS (SELECT l_returnflag, count(*) * ln(sum(l_tax * l_tax) / count(*)) + 2 * 2 AS a1, count(*) * ln(sum(l_discount * l_discount) / count(*)) + 2 * 3 AS a2 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a1, 4) + 0.0 AS aic_with, round(a2, 4) + 0.0 AS aic_without, CASE WHEN a1 < a2 THEN 'with structure' ELSE 'without structure' END AS best,
CASE WHEN abs(a1 - a2) <= 2 THEN 'Both models have substantial support' WHEN abs(a1 - a2) <= 7 THEN 'Considerably less support for losing model' WHEN abs(a1 - a2) <= 10 THEN 'Little support for losing model' ELSE 'Essentially no support for losing model' END AS interpretation FROM g""")
def f16_compare_models(spark, d):
    o = T.compare_models(table(spark, d, "lineitem"), "l_tax", "l_discount", 1, 2, ["l_returnflag"])
    return o.select("l_returnflag", (F.round("aic_with", 4) + 0.0).alias("aic_with"), (F.round("aic_without", 4) + 0.0).alias("aic_without"), "best", "interpretation")


@query("""WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2,
var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 AS t, round(pow(v1 / n1 + v2 / n2, 2) / (v1 / n1 * v1 / n1 / (n1 - 1) + v2 / n2 * v2 / n2 / (n2 - 1)), 5) + 0.0 AS dof FROM s WHERE n1 > 1 AND n2 > 1""")
def f17_welch(spark, d):
    o = T.welch(table(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice", ["l_suppkey"])
    return o.select("l_suppkey", r6("t").alias("t"), (F.round("dof", 5) + 0.0).alias("dof"))


@query("SELECT l_suppkey, rate, value FROM (SELECT l_suppkey, avg((l_returnflag = 'A')::DOUBLE) AS a, avg((l_returnflag = 'R')::DOUBLE) AS r FROM lineitem GROUP BY 1) UNPIVOT (value FOR rate IN (a, r))")
def f18_long_rates(spark, d):
    share = lambda f: F.avg(F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0))
    return T.long_rates(table(spark, d, "lineitem").groupBy("l_suppkey").agg(share("A").alias("a"), share("R").alias("r")), ["l_suppkey"], ["a", "r"])


@query("SELECT round(quantile_cont(o_totalprice, 0.99) * 1.1, 4) AS bound FROM orders")
def f18_emd_bound(spark, d):
    return T.emd_bound(table(spark, d, "orders").select(F.col("o_totalprice").alias("emd"))).select(F.round("bound", 4).alias("bound"))


@query("""SELECT n_name AS structure_name, CAST(s_suppkey AS VARCHAR) AS cell_id, round(CASE WHEN s_suppkey % 7 > 0 AND s_acctbal > 0 THEN s_acctbal * 2 / (s_suppkey % 7) END, 6) + 0.0 AS unit_volume
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def q07_cell_statistics(spark, d):
    """Ingest, restrict to catalogued cells, derive: the composition behind the stored statistics table."""
    cat = _catalog(spark, d)
    meta = cat.select("structure_name", "CellId", "count", "volume")
    out = B.structure_stats(K.restrict(meta, cat.filter("`8dsphere`")))
    return out.select("structure_name", F.col("CellId").cast("string").alias("cell_id"), r6("unit_volume").alias("unit_volume"))


