"""SQL of the queries about surfaces: spheres by the same rule, distances to triangles and rays, from the formulas' components.

The corners of a triangle are a, m and c, as "by" is a keyword.
"""

import math

from ..model import ORACLE_SQL, POINTS_VEC

RADII = "rad AS (SELECT cell_id, quantile_cont(sqrt(x * x + y * y + z * z), 0.8) AS radius FROM points GROUP BY 1)"


def _dot(u: str, v: str) -> str:
    return "(" + " + ".join(f"{u}{c} * {v}{c}" for c in "xyz") + ")"


def _less(u: str, v: str, name: str) -> str:
    return ", ".join(f"{u}{c} - {v}{c} AS {name}{c}" for c in "xyz")


def _cross(u: str, v: str, name: str) -> str:
    return ", ".join(f"{u}{a} * {v}{b} - {u}{b} * {v}{a} AS {name}{c}" for c, a, b in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))


def spheres(name: str, levels: int) -> str:
    """CTE: triangles of concentric spheres: cell_id, surface, corners."""
    flip = "s0 * s1 * s2 < 0"
    turn = lambda a, b: f"CASE WHEN {flip} THEN {a} ELSE {b} END"
    corners = {"ax": "s0", "ay": "0", "az": "0", "mx": "0", "my": turn("0", "s1"), "mz": turn("s2", "0"), "cx": "0", "cy": turn("s1", "0"), "cz": turn("0", "s2")}
    signs = " , ".join(f"(VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) v{k}(s{k})" for k in range(3))
    out = [f"{name}_0 AS (SELECT {', '.join(f'({e})::DOUBLE AS {c}' for c, e in corners.items())} FROM {signs})"]
    at = lambda p, c: f"{p}{c}" if len(p) == 1 else f"({p[0]}{c} + {p[1]}{c}) / 2"
    for k in range(levels):
        parts = [", ".join(f"{at(p, c)} AS {own}{c}" for own, p in zip("amc", face) for c in "xyz") for face in (("a", "am", "ca"), ("am", "m", "mc"), ("ca", "mc", "c"), ("am", "mc", "ca"))]
        out.append(f"{name}_{k + 1} AS ({' UNION ALL '.join(f'SELECT {p} FROM {name}_{k}' for p in parts)})")
    scaled = ", ".join(f"{p}{c} / sqrt({_dot(p, p)}) * radius * factor AS {p}{c}" for p in "amc" for c in "xyz")
    out.append(f"{name} AS (SELECT cell_id, surface, {scaled} FROM {name}_{levels}, rad, (VALUES ('nuc', 0.5::DOUBLE), ('mem', 1.0::DOUBLE)) f(surface, factor))")
    return ", ".join(out)


def distances(name: str, points: str, surfaces: str) -> str:
    """CTE: distance, inside and nearest point of every row of ``points`` (cell_id, x, y, z) to every surface."""
    edge = lambda k, o, d: f"greatest(0, least(1, coalesce({_dot(o + 'p', d)} / nullif({_dot(d, d)}, 0), 0))) AS t{k}"
    on = lambda k, o, d: ", ".join(f"{o}{c} + t{k} * {d}{c} AS e{k}{c}" for c in "xyz")
    away = lambda q: "(" + " + ".join(f"({c} - {q}{c}) * ({c} - {q}{c})" for c in "xyz") + ")"
    solid = f"2 * atan2({_dot('pa', 'n')}, la * lm * lc + {_dot('pa', 'pm')} * lc + {_dot('pm', 'pc')} * la + {_dot('pc', 'pa')} * lm)"
    pick = lambda c: f"CASE WHEN within THEN f{c} WHEN d0 <= d1 AND d0 <= d2 THEN e0{c} WHEN d1 <= d2 THEN e1{c} ELSE e2{c} END AS q{c}"
    turned = "CASE WHEN surface = 'nuc' THEN -1 ELSE 1 END"
    return f"""{name}_1 AS (SELECT p.*, t.surface, {', '.join(f't.{k}{c}' for k in 'amc' for c in 'xyz')} FROM {points} p JOIN {surfaces} t USING (cell_id)),
{name}_2 AS (SELECT *, {_less('m', 'a', 'ab')}, {_less('c', 'a', 'ac')}, {_less('c', 'm', 'bc')}, {', '.join(f'{c} - {k}{c} AS {k}p{c}' for k in 'am' for c in 'xyz')}, {', '.join(f'{k}{c} - {c} AS p{k}{c}' for k in 'amc' for c in 'xyz')} FROM {name}_1),
{name}_3 AS (SELECT *, {_dot('ab', 'ab')} AS d00, {_dot('ab', 'ac')} AS d01, {_dot('ac', 'ac')} AS d11, {_dot('ap', 'ab')} AS d20, {_dot('ap', 'ac')} AS d21, {edge(0, 'a', 'ab')}, {edge(1, 'a', 'ac')}, {edge(2, 'm', 'bc')}, {', '.join(f'sqrt({_dot("p" + k, "p" + k)}) AS l{k}' for k in 'amc')}, {_cross('pm', 'pc', 'n')} FROM {name}_2),
{name}_4 AS (SELECT *, (d11 * d20 - d01 * d21) / (d00 * d11 - d01 * d01) AS v, (d00 * d21 - d01 * d20) / (d00 * d11 - d01 * d01) AS w, {on(0, 'a', 'ab')}, {on(1, 'a', 'ac')}, {on(2, 'm', 'bc')}, {solid} AS sa FROM {name}_3),
{name}_5 AS (SELECT *, v >= 0 AND w >= 0 AND v + w <= 1 AS within, {', '.join(f'a{c} + v * ab{c} + w * ac{c} AS f{c}' for c in 'xyz')}, {', '.join(f'{away(f"e{k}")} AS d{k}' for k in range(3))} FROM {name}_4),
{name}_6 AS (SELECT *, {', '.join(pick(c) for c in 'xyz')} FROM {name}_5),
{name}_7 AS (SELECT cell_id, point_id, x, y, z, surface, min({away('q')}) AS dd, abs(sum(sa) / {4 * math.pi!r}::DOUBLE) > 0.5 AS inside, {', '.join(f'arg_min(q{c}, {away("q")}) AS n{c}' for c in 'xyz')} FROM {name}_6 GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN inside THEN 1 ELSE -1 END * {turned} * sqrt(dd) AS distance FROM {name}_7)"""


SURFACES = f"WITH {POINTS_VEC}, {RADII}, {spheres('tri', 1)}, own AS (SELECT cell_id, point_id, x, y, z FROM points), {distances('far', 'own', 'tri')}"
BOTH = "FROM far n JOIN far m USING (cell_id, point_id) WHERE n.surface = 'nuc' AND m.surface = 'mem'"

ORACLE_SQL["c04_surface_distance"] = f"{SURFACES} SELECT point_id, round(n.distance, 6) + 0.0 AS nuc, round(m.distance, 6) + 0.0 AS mem {BOTH}"
ORACLE_SQL["c08_classify_points"] = f"{SURFACES} SELECT point_id, n.inside AS in_nucleus, m.inside AS in_membrane, m.inside AND NOT n.inside AS in_cytoplasm {BOTH}"
ORACLE_SQL["c18_distance_agreement"] = f"""{SURFACES}, {spheres('fine', 2)}, mem AS (SELECT * FROM fine WHERE surface = 'mem'), {distances('near', 'own', 'mem')}
SELECT cell_id, point_id, round(a.distance - b.distance, 6) + 0.0 AS difference FROM far a JOIN near b USING (cell_id, point_id) WHERE a.surface = 'mem'"""
ORACLE_SQL["c05_scaled_surface_distance"] = f"""{SURFACES}, start AS (SELECT cell_id, point_id, n.inside AS within, m.inside AS around, n.nx AS ox, n.ny AS oy, n.nz AS oz, n.x - n.nx AS rx, n.y - n.ny AS ry, n.z - n.nz AS rz {BOTH}),
r1 AS (SELECT s.*, {_less('m', 'a', 'e')}, {_less('c', 'a', 'g')}, {_less('o', 'a', 's')} FROM start s JOIN tri t USING (cell_id) WHERE t.surface = 'mem'),
r2 AS (SELECT *, {_cross('r', 'g', 'h')}, {_cross('s', 'e', 'k')} FROM r1), r3 AS (SELECT *, nullif({_dot('e', 'h')}, 0) AS det FROM r2),
r4 AS (SELECT *, {_dot('s', 'h')} / det AS u, {_dot('r', 'k')} / det AS v, {_dot('g', 'k')} / det AS t FROM r3),
r5 AS (SELECT point_id, within, around, min(t) FILTER (u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9 AND t > 1e-9) AS t, max({_dot('r', 'r')}) AS l FROM r4 GROUP BY ALL),
r6 AS (SELECT point_id, CASE WHEN NOT within AND around AND sqrt(l) > 1e-8 THEN 1 / t END AS d FROM r5)
SELECT point_id, round(CASE WHEN d >= 0 AND d <= 1 THEN d END, 6) + 0.0 AS scaled_distance FROM r6"""
# The regular grid (step 4) of each cell's box, its points inside the membrane, and what is kept of them.
ORACLE_SQL["c07_available_space"] = f"""WITH {POINTS_VEC}, {RADII}, {spheres('tri', 1)}, box AS (SELECT cell_id, ceil(radius) AS r, radius FROM rad),
g AS (SELECT cell_id, row_number() OVER () AS point_id, -r + i * 4 AS x, -r + j * 4 AS y, -r + k * 4 AS z FROM box, range(60) a(i), range(60) b(j), range(60) c(k) WHERE -r + i * 4 < r + 2 AND -r + j * 4 < r + 2 AND -r + k * 4 < r + 2),
{distances('far', 'g', 'tri')}, pair AS (SELECT m.cell_id, m.z, m.distance AS membrane, n.distance AS nucleus, radius {BOTH.replace('FROM far n JOIN', 'FROM far n JOIN rad USING (cell_id) JOIN')} AND m.distance > 0),
l AS (SELECT cell_id, unnest(['membrane', 'nucleus', 'z', 'scaled_z']) AS measure, unnest([membrane, nucleus, CASE WHEN nucleus >= 0 THEN abs(z + radius) END, CASE WHEN nucleus >= 0 THEN abs(z + radius) / (2 * radius) END]) AS value FROM pair)
SELECT measure, cell_id, count(*) AS n, round(avg(value), 5) + 0.0 AS mean FROM l WHERE value IS NOT NULL GROUP BY ALL"""
ORACLE_SQL["c18_agreement_summary"] = f"""{ORACLE_SQL['c18_distance_agreement'].split(chr(10) + 'SELECT cell_id, point_id')[0]},
diff AS (SELECT a.cell_id, a.distance - b.distance AS d FROM far a JOIN near b USING (cell_id, point_id) WHERE a.surface = 'mem'),
apart AS (SELECT cell_id, count(*) AS n, avg(d) AS m, sqrt(avg(d * d)) AS q FROM diff GROUP BY 1),
share AS (SELECT cell_id, avg((surface = 'nuc' AND distance < 0)::INT::DOUBLE) * 2 AS i, avg((surface = 'mem' AND distance < 0)::INT::DOUBLE) * 2 AS o FROM far GROUP BY 1)
SELECT cell_id, n, round(m, 6) + 0.0 AS mean_difference, round(q, 6) + 0.0 AS rms_difference, round(i, 6) + 0.0 AS in_nucleus, round(o, 6) + 0.0 AS outside_membrane, i + o > 0.1 AS flagged FROM apart JOIN share USING (cell_id)"""
