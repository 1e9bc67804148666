"""SQL of the exact and normal distributions of rank tests, and of the queries that use them."""

from ..model import ORACLE_SQL, SAMPLES_EVENTS
from .curve_queries import BY_CELL, KSKEYS, PAIRS, base_sql, walk_sql

# erf as a series of positive terms; beyond 6 the rest is below 1e-15.
_ERF = "list_sum(list_transform(range(220), lambda j: exp((2 * j + 1) * ln(greatest({x}, 1e-300)) - ({x}) * ({x}) - lgamma(j + 1.5::DOUBLE))))"


def two_sided_sql(z: str) -> str:
    """Two-sided normal p of a non-negative z."""
    x = f"(({z}) / sqrt(2::DOUBLE))"
    return f"CASE WHEN ({z}) > 8.4 THEN 0 ELSE greatest(0, 1 - {_ERF.format(x=x)}) END"


def quantile_sql(p: str) -> str:
    """The z whose two-sided p is ``p``, bit by bit in units of 1e-9."""
    bits = ", ".join(str(1 << k) for k in range(32, -1, -1))
    return f"list_reduce([{bits}], lambda z, b: CASE WHEN {two_sided_sql('(z + b) / 1e9::DOUBLE')} >= {p} THEN z + b ELSE z END, 0::BIGINT) / 1e9::DOUBLE"


def signed_rank_counts_sql(name: str, most: int = 50) -> str:
    """CTE: in how many ways n ranks give a sum of at most w."""
    sums = most * (most + 1) // 2
    return f"""{name}_c AS (SELECT 0 AS n, list_transform(range({sums + 1}), lambda w: CASE WHEN w = 0 THEN 1::HUGEINT ELSE 0::HUGEINT END) AS c
  UNION ALL SELECT n + 1, list_transform(range({sums + 1}), lambda w: c[w + 1] + CASE WHEN w > n THEN c[w - n] ELSE 0 END) FROM {name}_c WHERE n < {most}),
{name} AS (SELECT n, w - 1 AS w, sum(c[w]) OVER (PARTITION BY n ORDER BY w) AS ways FROM {name}_c, unnest(range(1, {sums + 2})) r(w))"""


def rank_sum_counts_sql(name: str, largest: str, side: int = 8) -> str:
    """CTE: in how many orders of k and m values u pairs are the wrong way round: N(k, m, u) is the sum of N(k - 1, j, u - j) over j up to m."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT m, 0 AS u, 1::HUGEINT AS c FROM unnest(range(({largest}) + 1)) r(m))"]
    for k in range(1, side + 1):
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT a.m, b.u + b.m AS u, sum(b.c) AS c FROM unnest(range(({largest}) + 1)) a(m) JOIN {name}_{k - 1} b ON b.m <= a.m GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {name}_{k}" for k in range(side + 1))
    out.append(f"{name} AS (SELECT k, m, u, sum(c) OVER (PARTITION BY k, m ORDER BY u) AS ways, sum(c) OVER (PARTITION BY k, m) AS of FROM ({every}))")
    return ", ".join(out)


def mann_whitney_sql(rows: str, key: str) -> str:
    """``rows``: key, side (1 or 2), v."""
    z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1.0::DOUBLE)))), 0)"
    return f"""WITH dif AS ({rows}),
r AS (SELECT {key}, side, rank() OVER (PARTITION BY {key} ORDER BY v) + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {key}, v) AS t FROM dif),
g AS (SELECT {key}, sum(r) FILTER (side = 1) AS r1, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2, sum(t * t - 1)::DOUBLE AS t FROM r GROUP BY 1),
u AS (SELECT *, coalesce(r1, 0) - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n2 AS n FROM g),
e AS (SELECT *, CASE WHEN t = 0 AND least(n1, n2) <= 8 AND n1 * n2 > 0 THEN least(n1, n2) END AS k, greatest(n1, n2) AS m, {z} AS z FROM u WHERE n > 1 OR n1 * n2 = 0),
{rank_sum_counts_sql('ways', 'SELECT coalesce(max(m), 0) FROM e WHERE k IS NOT NULL')}
SELECT {key}, round(e.u, 6) + 0.0 AS u, round(z, 6) + 0.0 AS z,
round(CASE WHEN n1 * n2 = 0 THEN NULL WHEN e.k IS NOT NULL THEN least(1, 2 * ways::DOUBLE / of::DOUBLE) ELSE {two_sided_sql('greatest(coalesce(z, 0), 0)')} END, 6) + 0.0 AS p_value,
round(1 - 2 * e.u / nullif(n1 * n2, 0), 6) + 0.0 AS rank_biserial FROM e LEFT JOIN ways w ON w.k = e.k AND w.m = e.m AND w.u = least(e.u, n1 * n2 - e.u)"""


def wilcoxon_ctes(rows: str, key: str) -> str:
    """CTEs up to ``rank_w``: key, statistic, z, p, mean, pairs. ``rows``: key, d."""
    return f"""{signed_rank_counts_sql('ways')}, dif AS ({rows}), rank_a AS (SELECT {key}, count(*)::DOUBLE AS pairs, avg(d) AS mean FROM dif GROUP BY 1),
rank_r AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {key}, abs(d)) AS t FROM dif WHERE d <> 0),
rank_g AS (SELECT {key}, coalesce(sum(r) FILTER (d > 0), 0) AS p, coalesce(sum(r) FILTER (d < 0), 0) AS m, count(*)::DOUBLE AS n, sum(t * t - 1)::DOUBLE AS t FROM rank_r GROUP BY 1),
rank_z AS (SELECT *, coalesce(least(p, m), 0) AS statistic, (least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM rank_a LEFT JOIN rank_g USING ({key})),
rank_w AS (SELECT z.*, ways IS NULL AS normal, CASE WHEN z.n IS NULL THEN NULL WHEN t = 0 AND pairs <= 50 AND pairs = z.n THEN least(1, 2 * ways::DOUBLE / pow(2, z.n)) ELSE {two_sided_sql('abs(z)')} END AS pv
  FROM rank_z z LEFT JOIN ways ON t = 0 AND pairs <= 50 AND pairs = z.n AND ways.n = z.n AND ways.w = z.statistic)"""


EFFECT = f"CASE WHEN mean < 0 THEN -1 ELSE 1 END * CASE WHEN normal THEN abs(z) ELSE {quantile_sql('pv')} END / sqrt(pairs)"


def wilcoxon_sql(rows: str, key: str) -> str:
    return f"""WITH RECURSIVE {wilcoxon_ctes(rows, key)}
SELECT {key}, round(statistic, 6) + 0.0 AS statistic, round(z, 6) + 0.0 AS z, round(pv, 6) + 0.0 AS p_value, round(CASE WHEN pv IS NOT NULL THEN {EFFECT} END, 6) + 0.0 AS effect FROM rank_w"""


ORACLE_SQL["f14_mann_whitney"] = mann_whitney_sql("SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS side, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')", "l_suppkey")
ORACLE_SQL["f14_mann_whitney_small"] = mann_whitney_sql("SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 2 END AS side, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('O', 'F')", "o_custkey")
ORACLE_SQL["f15_wilcoxon"] = wilcoxon_sql("SELECT l_suppkey, round(l_quantity - 25 - l_tax * 100, 6) AS d FROM lineitem", "l_suppkey")
ORACLE_SQL["f15_wilcoxon_small"] = wilcoxon_sql("SELECT o_custkey, o_totalprice - 150000 AS d FROM orders", "o_custkey")
# Colocalisation: means by cell of the baseline; AIC of both sets, effect size, signed ranks of the cells that both have.
_PAIRED = "SELECT measure, w - wo AS d FROM cell_pairs WHERE w - wo IS NOT NULL"
ORACLE_SQL["q05_colocalisation"] = f"""{PAIRS.replace('WITH', 'WITH RECURSIVE', 1)}, {BY_CELL},
cell_pairs AS (SELECT measure, cell_id, max(mean_emd) FILTER (mode = '2-HIGH') AS w, max(mean_emd) FILTER (mode = '3-MEDIUM') AS wo FROM cells WHERE mode IN ('2-HIGH', '3-MEDIUM') GROUP BY ALL),
{wilcoxon_ctes(_PAIRED, 'measure')},
s AS (SELECT measure, count(w) AS n1, count(wo) AS n2, avg(w) AS m1, avg(wo) AS m2, coalesce(var_samp(w), 0) AS v1, coalesce(var_samp(wo), 0) AS v2, sum(w * w) AS q1, sum(wo * wo) AS q2 FROM cell_pairs GROUP BY 1),
k AS (SELECT *, n1 * ln(q1 / n1) + 12 AS a1, n2 * ln(q2 / n2) + 10 AS a2, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)) AS sd FROM s WHERE n1 > 0 AND n2 > 0),
e AS (SELECT *, CASE WHEN sd = 0 THEN 0 ELSE (m1 - m2) / sd END AS cd FROM k)
SELECT measure, n1 AS n_with, n2 AS n_without, CASE WHEN a1 < a2 THEN 'with structure' ELSE 'without structure' END AS best,
CASE WHEN abs(a1 - a2) <= 2 THEN 'Both models have substantial support' WHEN abs(a1 - a2) <= 7 THEN 'Considerably less support for losing model' WHEN abs(a1 - a2) <= 10 THEN 'Little support for losing model' ELSE 'Essentially no support for losing model' END AS interpretation,
CASE WHEN abs(cd) < 0.2 THEN 'Negligible' WHEN abs(cd) < 0.5 THEN 'Small' WHEN abs(cd) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect,
round(m1, 6) + 0.0 AS mean_with, round(m2, 6) + 0.0 AS mean_without, round(m1 - m2, 6) + 0.0 AS mean_difference, round(cd, 6) + 0.0 AS cohens_d, round(pv, 6) + 0.0 AS p_value, round(statistic, 6) + 0.0 AS test_statistic,
round(CASE WHEN pv IS NOT NULL THEN {EFFECT} END, 6) + 0.0 AS r_effect, round(a1, 4) + 0.0 AS aic_with, round(a2, 4) + 0.0 AS aic_without,
round(exp(-(a1 - least(a1, a2)) / 2) / (exp(-(a1 - least(a1, a2)) / 2) + exp(-(a2 - least(a1, a2)) / 2)), 4) + 0.0 AS weight_with FROM e LEFT JOIN rank_w USING (measure)"""

# The exact p-value of a KS distance: of all lattice paths from (0, 0) to (n1, n2), those that stay inside the band, row by row.
_INSIDE = "abs((i + 1) * n2 - {} * n1) < h"
ORACLE_SQL["f01_ks_exact"] = f"""WITH RECURSIVE {SAMPLES_EVENTS}, {base_sql("SELECT 'view' AS baseline")}, {walk_sql(KSKEYS, 'sides')},
w AS MATERIALIZED (SELECT mode, cell_id, ks, n1::BIGINT AS n1, n2::BIGINT AS n2, round(ks * n1 * n2)::BIGINT AS h FROM walk),
lattice AS (SELECT mode, cell_id, ks, n1, n2, h, 0::BIGINT AS i, list_transform(range(n2 + 1), lambda j: CASE WHEN j * n1 < h THEN 1::HUGEINT ELSE 0::HUGEINT END) AS c FROM w
  UNION ALL SELECT mode, cell_id, ks, n1, n2, h, i + 1, list_transform(range(n2 + 1), lambda j: CASE WHEN {_INSIDE.format('j')}
    THEN list_sum(list_transform(range(j + 1), lambda k: CASE WHEN {_INSIDE.format('k')} THEN c[k + 1] ELSE 0::HUGEINT END)) ELSE 0::HUGEINT END) FROM lattice WHERE i < n1),
p AS (SELECT mode, cell_id, ks, greatest(0, 1 - c[n2 + 1]::DOUBLE / exp(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1))) AS p FROM lattice WHERE i = n1)
SELECT mode, cell_id, round(ks, 6) + 0.0 AS ks, round(p, 6) + 0.0 AS p_value, p >= 0.05 AS "similar" FROM p"""
