"""SQL (DuckDB) forms of the adapters and of the longer operators, as common table expressions."""

from __future__ import annotations

from stratavox.sources.adapters import GRID_WIDTH, ORDER, ORDERS_PER_SCAN

RAW = f"""raw AS (SELECT l_orderkey // {ORDERS_PER_SCAN} AS scan_id, CAST(floor(l_extendedprice) AS BIGINT) - 52500 AS x,
  (l_partkey * 53) % 40001 - 20000 AS y, CAST(l_quantity AS BIGINT) * 400 - 10000 AS z, l_suppkey AS intensity, {", ".join(ORDER)} FROM lineitem)"""
PTS = f"{RAW}, pts AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY {', '.join(ORDER)}) - 1 AS idx, x, y, z, intensity FROM raw)"
GRID = f"""{PTS}, lines AS (SELECT *, idx // {GRID_WIDTH} AS ring, idx % {GRID_WIDTH} AS col FROM pts),
grid AS (SELECT *, CAST(floor(sqrt(CAST(x*x + y*y + z*z AS DOUBLE))) AS BIGINT) AS rng FROM lines
  WHERE (scan_id, ring) IN (SELECT (scan_id, ring) FROM lines GROUP BY scan_id, ring HAVING count(*) = {GRID_WIDTH}))"""
IMU = "imu AS (SELECT event_id, user_id AS sensor_id, ts, CAST(floor(value * 100) AS BIGINT) AS w FROM events WHERE event_type <> 'view')"
SCANS = "scans AS (SELECT event_id AS scan_key, user_id AS sensor_id, ts FROM events WHERE event_type = 'view')"
POSES = "poses AS (SELECT o_custkey AS session, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS tx, o_orderkey * 37 % 5003 AS ty, o_custkey * 11 % 701 AS tz FROM orders)"
TIMINGS = "timings AS (SELECT event_type AS task, event_id AS seq, CAST(floor(value * 300) AS BIGINT) AS micros FROM events)"


def fdiv(a: str, b: int) -> str:
    return f"CAST(floor(({a}) / {b}.0) AS BIGINT)"


def norm(x: str, y: str, z: str) -> str:
    return f"CAST(floor(sqrt(CAST(({x})*({x}) + ({y})*({y}) + ({z})*({z}) AS DOUBLE))) AS BIGINT)"


def weight(v: str, tau: int) -> str:
    eps = tau // 10
    return f"CASE WHEN {v} < {-eps} THEN (64 * ({tau} + {v})) // {tau - eps} ELSE 64 END"


def rays(res: int, tau: int, half: int, dz: int, where: str = "true") -> str:
    """PTS and the ray march: cells(scan_id, idx, len, step, ix, iy, iz, value, weight), for a scanner at the origin."""
    m, inside = 32768, lambda x, y, z: f"abs({x}) <= {half} AND abs({y}) <= {half} AND abs({z}) <= {half}"
    return f"""{PTS},
r1 AS (SELECT scan_id, idx, x, y, z, {norm('x', 'y', 'z')} AS dist FROM pts WHERE {inside(f'x // {res}', f'y // {res}', f'z // {res}')} AND {where}),
r2 AS (SELECT *, (x * {m}) // dist AS nx, (y * {m}) // dist AS ny, (z * {m}) // dist AS nz FROM r1 WHERE dist > 0),
r3 AS (SELECT *, nz * nx AS ax, nz * ny AS ay, -nx * nx - ny * ny AS az FROM r2),
r4 AS (SELECT *, {norm('ax', 'ay', 'az')} AS vn FROM r3),
r5 AS (SELECT scan_id, idx, x, y, z, dist, (ax * {m}) // vn AS vx, (ay * {m}) // vn AS vy, (az * {m}) // vn AS vz FROM r4 WHERE vn > 0),
r6 AS (SELECT *, unnest(range(1, dist + {tau} + 1, {max(res // 2, 1)})) AS len FROM r5),
r7 AS (SELECT *, (x * len) // dist AS px, (y * len) // dist AS py, (z * len) // dist AS pz FROM r6),
r8 AS (SELECT *, px // {res} AS cx, py // {res} AS cy, pz // {res} AS cz FROM r7),
r9 AS (SELECT *, lag(cx, 1, 0) OVER w AS lx, lag(cy, 1, 0) OVER w AS ly FROM r8 WINDOW w AS (PARTITION BY scan_id, idx ORDER BY len)),
r10 AS (SELECT *, least({norm(f'x - (cx * {res} + {res // 2})', f'y - (cy * {res} + {res // 2})', f'z - (cz * {res} + {res // 2})')}, {tau}) AS near
  FROM r9 WHERE NOT (cx = lx AND cy = ly) AND {inside('cx', 'cy', 'cz')}),
r11 AS (SELECT *, CASE WHEN len > dist THEN -near ELSE near END AS value FROM r10),
r12 AS (SELECT *, {weight('value', tau)} AS w0, ({dz} * len) // {m} AS dz FROM r11),
r13 AS (SELECT *, unnest(range(0, (dz * 2) // {res} + 1)) AS step FROM r12 WHERE w0 <> 0),
r14 AS (SELECT scan_id, idx, len, step, {', '.join(f'(p{a} - (dz * v{a}) // {m} + (step * {res} * v{a}) // {m}) // {res} AS i{a}' for a in 'xyz')},
  value, CASE WHEN step = dz // {res} THEN w0 ELSE -w0 END AS weight FROM r13),
cells AS (SELECT * FROM r14 WHERE {inside('ix', 'iy', 'iz')})"""


def merged(name: str = "voxels", source: str = "cells") -> str:
    return f"""{name} AS (SELECT ix, iy, iz, value, weight FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz
  ORDER BY (CASE WHEN weight < 0 THEN 1 ELSE 0 END), abs(value), scan_id, idx, len, step) AS rn FROM {source}) WHERE rn = 1)"""


def gradient(name: str = "grads", source: str = "voxels") -> str:
    out, at = "", source
    for k, a in enumerate("xyz"):
        others = ", ".join(f"i{b}" for b in "xyz" if b != a)
        step = f"{name}_{k}"
        pick = lambda f, c, a=a, others=others: f"{f}({c}) OVER (PARTITION BY {others} ORDER BY i{a})"
        out += f"""{step}a AS (SELECT *, {pick('lead', f'i{a}')} AS ni, {pick('lag', f'i{a}')} AS li, {pick('lead', 'value')} AS nv, {pick('lag', 'value')} AS lv,
  {pick('lead', 'weight')} AS nw, {pick('lag', 'weight')} AS lw FROM {at}),
{step} AS (SELECT * EXCLUDE (ni, li, nv, lv, nw, lw), CASE WHEN ni = i{a} + 1 AND li = i{a} - 1 AND nw <> 0 AND lw <> 0
  AND NOT ((nv > 0 AND lv < 0) OR (nv < 0 AND lv > 0)) THEN (nv - lv) // 2 ELSE 0 END AS g{a} FROM {step}a),
"""
        at = step
    return out + f"{name} AS (SELECT * FROM {at})"


def features(v, jump: float, least: float, most: float) -> str:
    """Greedy picking as a recursion over the candidates of each line in order, with the list of taken columns as its state. v is a
    features.Variant; lengths are in metres."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    over = "OVER (PARTITION BY scan_id, ring ORDER BY col)"
    taps = lambda a: " + ".join([f"lag({a}, {k}) {over}" for k in range(5, 0, -1)] + [a] + [f"lead({a}, {k}) {over}" for k in range(1, 6)])
    near = "1" if v.gap is None else f"CASE WHEN power(lead(x) {over} - x, 2) + power(lead(y) {over} - y, 2) + power(lead(z) {over} - z, 2) <= {d(v.gap)} THEN 1 ELSE 0 END"
    chain = lambda f, first: " + ".join(" * ".join(f"coalesce({f}(nr, {k}) {over}, 0)" for k in range(first, first + n)) for n in range(1, v.reach + 1))
    barred = (["marked"] if v.marks else []) + ([f"intensity < {v.least_intensity}"] if v.least_intensity is not None else [])
    edge = f"curvature {'>' if v.strict_edge else '>='} {d(v.edge_least)}"
    strict = "true" if v.cap == "strict" else "false"
    surf = "" if v.surf_is_rest else f" UNION ALL SELECT scan_id, ring, col, s, 1, row_number() OVER (PARTITION BY scan_id, ring, s ORDER BY curvature, col), el, er FROM g5 WHERE curvature <= {d(v.surf_most)}"
    room = f"CASE WHEN kind = 0 THEN {v.edges} ELSE {v.surfs if v.surfs is not None else 1 << 40} END"
    rest = "" if not v.surf_is_rest else """ UNION ALL SELECT scan_id, ring, col, 'surf' FROM (SELECT scan_id, ring, unnest(range(5, 250)) AS col, arg_max(taken, rn) AS taken FROM st GROUP BY scan_id, ring) WHERE NOT taken[col + 1]"""
    return f"""WITH RECURSIVE {GRID}, g1 AS (SELECT scan_id, ring, col, intensity, {', '.join(f'{d(a)} / {d(1000)} AS {a}' for a in 'xyz')}, {d('rng')} / {d(1000)} AS rng FROM grid),
g2 AS (SELECT *, CASE WHEN col BETWEEN 5 AND 249 THEN rng ELSE 0 END AS r, {', '.join(f'{taps(a)} - {a} * 11 AS d{a}' for a in 'xyz')}, {near} AS nr FROM g1),
g3 AS (SELECT *, dx * dx + dy * dy + dz * dz AS curvature, CASE WHEN col BETWEEN 5 AND 249 AND r - lead(r) {over} > {d(jump)} THEN 1 ELSE 0 END AS fall, CASE WHEN col BETWEEN 5 AND 249 AND lead(r) {over} - r > {d(jump)} THEN 1 ELSE 0 END AS rise,
 {chain('lead', 0)} AS er, {chain('lag', 1)} AS el FROM g2),
g4 AS (SELECT *, max(fall) OVER (PARTITION BY scan_id, ring ORDER BY col ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 OR coalesce(max(rise) OVER (PARTITION BY scan_id, ring ORDER BY col ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 1, false)
 OR (col BETWEEN 5 AND 249 AND (r < {d(least)} OR r > {d(most)})) AS marked, (col - 5) // 42 AS s FROM g3),
g5 AS (SELECT * FROM g4 WHERE col BETWEEN 5 AND 249),
q1 AS (SELECT scan_id, ring, col, s, 0 AS kind, row_number() OVER (PARTITION BY scan_id, ring, s ORDER BY curvature DESC, col) AS place, el, er FROM g5 WHERE {edge}{surf}),
q2 AS (SELECT *, row_number() OVER (PARTITION BY scan_id, ring ORDER BY s, kind, place) AS rn FROM q1),
st AS (SELECT scan_id, ring, CAST(0 AS BIGINT) AS rn, list({' OR '.join(barred) or 'false'} ORDER BY col) AS taken, CAST(-1 AS BIGINT) AS s, 0 AS kind, CAST(0 AS BIGINT) AS room, false AS refused, false AS done, false AS pick, CAST(-1 AS BIGINT) AS col FROM g4 GROUP BY scan_id, ring
 UNION ALL SELECT scan_id, ring, rn, CASE WHEN pick THEN list_transform(taken, lambda b, i: b OR (i - 1 BETWEEN col - el AND col + er)) ELSE taken END, s, kind, CASE WHEN pick AND room > 0 THEN room - 1 ELSE room END, refused OR (was_full AND NOT {strict}), done OR (was_full AND {strict}), pick, col
 FROM (SELECT *, act AND NOT was_full AS pick FROM (SELECT *, act AND room = 0 AND ({strict} OR NOT refused) AS was_full FROM (SELECT *, NOT done AND NOT taken[col + 1] AS act FROM (
  SELECT q.scan_id, q.ring, q.rn, st.taken, q.s, q.kind, q.col, q.el, q.er, CASE WHEN q.s = st.s AND q.kind = st.kind THEN st.room ELSE {room.replace('kind', 'q.kind')} END AS room, q.s = st.s AND q.kind = st.kind AND st.refused AS refused, q.s = st.s AND q.kind = st.kind AND st.done AS done
  FROM st JOIN q2 q ON q.scan_id = st.scan_id AND q.ring = st.ring AND q.rn = st.rn + 1))))),
found AS (SELECT scan_id, ring, col, CASE WHEN kind = 0 THEN 'edge' ELSE 'surf' END AS feature FROM st WHERE pick{rest})
SELECT f.scan_id, f.ring, f.col, f.feature AS kind, g.curvature FROM found f JOIN g4 g USING (scan_id, ring, col)"""


def transform(m: list[list[int]], x: str = "x", y: str = "y", z: str = "z") -> list[str]:
    return [f"({r[0]} * {x} + {r[1]} * {y} + {r[2]} * {z} + {r[3]}) // 32768" for r in m[:3]]
