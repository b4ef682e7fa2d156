"""Registered queries of vectors, matrices, rotations, residuals and solvers. Real results are compared in millionths."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions import grid as G
from stratavox.functions import linalg as L
from stratavox.operators import filters as FI
from stratavox.operators import gicp as GI
from stratavox.operators import metrics as ME
from stratavox.operators import neighbours as NB
from stratavox.operators import registration as RG
from stratavox.operators import solvers as SO
from stratavox.operators import timeseries as TS
from stratavox.plans import queries as Q
from stratavox.plans import sql as S
from stratavox.sources import adapters as A
from stratavox.sources import publish as PB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def micro(c: Column) -> Column:
    return F.round(c * 1e6).cast("bigint")


def _micro(e: str) -> str:
    return f"CAST(round(({e}) * 1e6) AS BIGINT)"


def _spread(df: DataFrame, array: Column, names: list[str], *keys: str) -> DataFrame:
    """Entries of an array as columns in millionths; the array is computed once."""
    return df.select(*keys, array.alias("_a")).select(*keys, *[micro(F.col("_a")[i]).alias(n) for i, n in enumerate(names)])


def _sql(columns: dict[str, str], source: str, *keys: str) -> str:
    return f"WITH {source} SELECT {', '.join([*keys, *[f'{_micro(e)} AS {n}' for n, e in columns.items()]])} FROM "


#: Twists and points from the point table: rotations of up to half a radian, translations and centres in metres.
TWIST = {"w0": "x / 1e5", "w1": "y / 1e5", "w2": "z / 1e5", "v0": "y / 1e3", "v1": "z / 1e3", "v2": "x / 1e3"}
_TW = f"{S.PTS}, tw0 AS (SELECT scan_id, idx, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in TWIST.items())} FROM pts), tw AS (SELECT *, sqrt(w0*w0 + w1*w1 + w2*w2) AS th FROM tw0)"
M4 = [f"m{i}{k}" for i in range(3) for k in range(4)]


def _twists(spark, sf) -> DataFrame:
    return A.points(spark, sf).selectExpr("scan_id", "idx", *[f"cast({e} as double) as {n}" for n, e in TWIST.items()])


def _xi() -> list[Column]:
    return [F.col(n) for n in TWIST]


_EPS = {(0, 1): "-w2", (0, 2): "w1", (1, 0): "w2", (1, 2): "-w0", (2, 0): "-w1", (2, 1): "w0"}
_K2 = {(i, k): " + ".join(f"({_EPS.get((i, m), '0')}) * ({_EPS.get((m, k), '0')})" for m in range(3)) for i in range(3) for k in range(3)}


def _rot(a: str, b: str) -> dict[tuple[int, int], str]:
    """I + a K + b K K by products of the entries of K."""
    return {(i, k): f"{int(i == k)} + ({a}) * ({_EPS.get((i, k), '0')}) + ({b}) * ({_K2[i, k]})" for i in range(3) for k in range(3)}


_A, _B, _C = "sin(th) / th", "(1 - cos(th)) / (th * th)", "(th - sin(th)) / (th * th * th)"
_R, _V = _rot(_A, _B), _rot(_B, _C)
_CENTRE = (1.5, -2.25, 0.5)
_TWIST_SQL = {f"m{i}{k}": _R[i, k] if k < 3 else f"{_CENTRE[i]} + v{i} - (" + " + ".join(f"({_R[i, m]}) * ({_CENTRE[m]})" for m in range(3)) + ")" for i in range(3) for k in range(4)}
_EXP_SQL = {f"m{i}{k}": _R[i, k] if k < 3 else " + ".join(f"({_V[i, m]}) * v{m}" for m in range(3)) for i in range(3) for k in range(4)}
#: A fixed pose: a quarter turn about z and a translation.
_POSE = [0.0, -1.0, 0.0, 4.0, 1.0, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
_PLUS_SQL = {f"m{i}{k}": " + ".join([f"({_EXP_SQL[f'm{i}{m}']}) * ({_POSE[4 * m + k]})" for m in range(3)] + ([_EXP_SQL[f"m{i}3"]] if k == 3 else [])) for i in range(3) for k in range(4)}
_MOVING = "WHERE th > 0"


@query(_sql(_TWIST_SQL, _TW, "scan_id", "idx") + f"tw {_MOVING}")
def twist_transform(spark, sf):
    """E19."""
    t = _twists(spark, sf).filter("w0 <> 0 or w1 <> 0 or w2 <> 0")
    t, entries = L.twist_columns(t, list(TWIST), [F.lit(c) for c in _CENTRE])
    return t.select("scan_id", "idx", *[micro(c).alias(n) for n, c in zip(M4, entries, strict=True)])


@query(_sql(_EXP_SQL, _TW, "scan_id", "idx") + f"tw {_MOVING}")
def se3_exponential(spark, sf):
    """E20."""
    t, entries = L.se3_columns(_twists(spark, sf).filter("w0 <> 0 or w1 <> 0 or w2 <> 0"), list(TWIST))
    return t.select("scan_id", "idx", *[micro(c).alias(n) for n, c in zip(M4, entries, strict=True)])


@query(_sql(_PLUS_SQL, _TW, "scan_id", "idx") + f"tw {_MOVING}")
def manifold_plus(spark, sf):
    """E24."""
    pose = F.array(*[F.lit(v) for v in _POSE])
    return _spread(_twists(spark, sf).filter("w0 <> 0 or w1 <> 0 or w2 <> 0"), L.manifold_plus(pose, _xi()), M4, "scan_id", "idx")


@query(f"WITH {S.PTS} SELECT scan_id, idx, CAST(y * 3 - z * (-2) AS DOUBLE) AS cx, CAST(z * 1 - x * 3 AS DOUBLE) AS cy, CAST(x * (-2) - y * 1 AS DOUBLE) AS cz FROM pts")
def skew_product(spark, sf):
    """The skew matrix of a point times a vector is their cross product."""
    p = A.points(spark, sf).select("scan_id", "idx", L.vec(*[F.col(a).cast("double") for a in "xyz"]).alias("p"))
    c = p.select("scan_id", "idx", L.matvec(L.skew(F.col("p")), F.array(F.lit(1.0), F.lit(-2.0), F.lit(3.0)), 3).alias("c"))
    return c.select("scan_id", "idx", *[F.col("c")[i].alias(f"c{a}") for i, a in enumerate("xyz")])


_PA, _PB = (12.0, -3.5, 1.0), (-7.0, 4.0, 2.5)
_LINE = f"""{S.PTS}, q AS (SELECT scan_id, idx, x / 1e3 AS px, y / 1e3 AS py, z / 1e3 AS pz, x / 1e3 - ({_PA[0]}) AS ux, y / 1e3 - ({_PA[1]}) AS uy, z / 1e3 - ({_PA[2]}) AS uz, x / 1e3 - ({_PB[0]}) AS vx, y / 1e3 - ({_PB[1]}) AS vy, z / 1e3 - ({_PB[2]}) AS vz FROM pts),
n AS (SELECT *, uy*vz - uz*vy AS nx, uz*vx - ux*vz AS ny, ux*vy - uy*vx AS nz FROM q), e AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS nn, {_PA[0] - _PB[0]} AS ex, {_PA[1] - _PB[1]} AS ey, {_PA[2] - _PB[2]} AS ez, sqrt({sum((a - b) ** 2 for a, b in zip(_PA, _PB, strict=True))}) AS en FROM n),
g AS (SELECT *, (ey*nz - ez*ny) / (nn * en) AS gx, (ez*nx - ex*nz) / (nn * en) AS gy, (ex*ny - ey*nx) / (nn * en) AS gz FROM e)"""
_J6 = [f"j{i}" for i in range(6)]


@query(f"WITH {_LINE} SELECT scan_id, idx, {_micro('nn / en')} AS r, " + ", ".join(f"{_micro(e)} AS {n}" for n, e in zip(_J6, ["py*gz - pz*gy", "pz*gx - px*gz", "px*gy - py*gx", "gx", "gy", "gz"], strict=True)) + " FROM g WHERE nn > 0")
def line_residuals(spark, sf):
    """Distance to a line and its derivative by a twist."""
    p = [F.col(a) / 1e3 for a in "xyz"]
    a, b = ([F.lit(v) for v in t] for t in (_PA, _PB))
    df = A.points(spark, sf).select("scan_id", "idx", L.point_to_line(p, a, b).alias("r"), L.point_to_line_jacobian(p, a, b).alias("j")).filter("r > 0")
    return df.select("scan_id", "idx", micro(F.col("r")).alias("r"), *[micro(F.col("j")[i]).alias(n) for i, n in enumerate(_J6)])


@query(f"WITH {S.PTS}, q AS (SELECT scan_id, idx, x / 1e3 AS px, y / 1e3 AS py, z / 1e3 AS pz FROM pts) SELECT scan_id, idx, {_micro('0.6*px + 0.8*pz - 2.5')} AS r, {_micro('py*0.8')} AS j0, {_micro('pz*0.6 - px*0.8')} AS j1, {_micro('-py*0.6')} AS j2, CAST(600000 AS BIGINT) AS j3, CAST(0 AS BIGINT) AS j4, CAST(800000 AS BIGINT) AS j5 FROM q")
def plane_residuals(spark, sf):
    """Signed distance to a plane and its derivative by a twist."""
    p, n = [F.col(a) / 1e3 for a in "xyz"], [F.lit(0.6), F.lit(0.0), F.lit(0.8)]
    df = A.points(spark, sf).select("scan_id", "idx", L.point_to_plane(p, n, F.lit(-2.5)).alias("r"), L.point_to_plane_jacobian(p, n).alias("j"))
    return df.select("scan_id", "idx", micro(F.col("r")).alias("r"), *[micro(F.col("j")[i]).alias(c) for i, c in enumerate(_J6)])


def _turns(axis: str) -> list[list[str]]:
    c, s = f"cos(a{axis})", f"sin(a{axis})"
    return {"x": [["1", "0", "0"], ["0", c, f"-{s}"], ["0", s, c]], "y": [[c, "0", s], ["0", "1", "0"], [f"-{s}", "0", c]], "z": [[c, f"-{s}", "0"], [s, c, "0"], ["0", "0", "1"]]}[axis]


def _times(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
    return [[" + ".join(f"({a[i][m]}) * ({b[m][k]})" for m in range(3)) for k in range(3)] for i in range(3)]


_EULER = _times(_times(_turns("x"), _turns("y")), _turns("z"))
M3 = [f"m{i}{k}" for i in range(3) for k in range(3)]


@query(f"WITH {S.PTS}, a AS (SELECT scan_id, idx, x / 2e4 AS ax, y / 2e4 AS ay, z / 2e4 AS az FROM pts) SELECT scan_id, idx, " + ", ".join(f"{_micro(_EULER[i][k])} AS m{i}{k}" for i in range(3) for k in range(3)) + " FROM a")
def euler_rotations(spark, sf):
    """Rx Ry Rz."""
    return _spread(A.points(spark, sf), L.euler_rotation(*[F.col(a) / 2e4 for a in "xyz"]), M3, "scan_id", "idx")


_AT = lambda r: f"(pi() / 4 * ({r}) - ({r}) * (abs({r}) - 1) * (0.2447 + 0.0663 * abs({r})))"


@query(f"""WITH {S.PTS}, q AS (SELECT scan_id, idx, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, z / 10000.0 AS r FROM pts WHERE x <> 0 OR y <> 0) SELECT scan_id, idx, {_micro(_AT('r'))} AS at,
{_micro(f"CASE WHEN abs(y) < x THEN {_AT('y / x')} WHEN abs(y) < -x AND y >= 0 THEN {_AT('y / x')} + pi() WHEN abs(y) < -x THEN {_AT('y / x')} - pi() WHEN y > 0 THEN pi() / 2 - {_AT('x / y')} ELSE -pi() / 2 - {_AT('x / y')} END")} AS at2 FROM q""")
def fast_arc_tangents(spark, sf):
    """E29."""
    p = A.points(spark, sf).filter("x <> 0 or y <> 0")
    return p.select("scan_id", "idx", micro(L.fast_atan(F.col("z") / 10000.0)).alias("at"), micro(L.fast_atan2(F.col("y").cast("double"), F.col("x").cast("double"))).alias("at2"))


@query(f"WITH {S.PTS}, q AS (SELECT *, sqrt(CAST(x*x + y*y + z*z AS DOUBLE)) AS n FROM pts) SELECT scan_id, idx, CAST(x + z AS DOUBLE) AS add_x, CAST(y - x AS DOUBLE) AS sub_y, CAST(z * y AS DOUBLE) AS mult_z, CAST(x AS DOUBLE) * CAST(2.5 AS DOUBLE) AS scaled_x, CAST(-y AS DOUBLE) AS minus_y, CAST(x + y + z AS DOUBLE) AS total, CAST(x AS DOUBLE) * (y % 100) * (z % 100) AS product, {_micro('x / n')} AS unit_x, {_micro('z / n')} AS unit_z FROM q WHERE n > 0")
def vector_algebra(spark, sf):
    """The operations that vector_products leaves out."""
    p = A.points(spark, sf).filter("x <> 0 or y <> 0 or z <> 0")
    p = p.select("*", L.vec(*[F.col(a).cast("double") for a in "xyz"]).alias("a"), L.vec(*[F.col(a).cast("double") for a in "zxy"]).alias("b"))
    unit = L.normalised(F.col("a"))
    part = L.vec(F.col("x").cast("double"), (F.col("y") % 100).cast("double"), (F.col("z") % 100).cast("double"))
    return p.select("scan_id", "idx", L.add(F.col("a"), F.col("b"))[0].alias("add_x"), L.sub(F.col("a"), F.col("b"))[1].alias("sub_y"), L.mult(F.col("a"), F.col("b"))[2].alias("mult_z"), L.scale(F.col("a"), 2.5)[0].alias("scaled_x"), L.negate(F.col("a"))[1].alias("minus_y"), L.total(F.col("a")).alias("total"), L.prod(part).alias("product"), micro(unit[0]).alias("unit_x"), micro(unit[2]).alias("unit_z"))


@query(f"WITH {S.PTS} SELECT scan_id, idx, {', '.join(f'CAST({e} + {i + 1} AS DOUBLE) AS s{i}' for i, e in enumerate(['x', 'y', 'z', 'x + y', 'y + z', 'z + x']))} FROM pts")
def vector6_sums(spark, sf):
    """Sums of vectors of six."""
    six = L.vec(*[e.cast("double") for e in (F.col("x"), F.col("y"), F.col("z"), F.col("x") + F.col("y"), F.col("y") + F.col("z"), F.col("z") + F.col("x"))])
    p = A.points(spark, sf).select("scan_id", "idx", L.add(six, L.vec(*[F.lit(float(i + 1)) for i in range(6)])).alias("s"))
    return p.select("scan_id", "idx", *[F.col("s")[i].alias(f"s{i}") for i in range(6)])


_M = f"{S.PTS}, q AS (SELECT scan_id, idx, CAST(x % 17 AS DOUBLE) AS a, CAST(y % 19 AS DOUBLE) AS b, CAST(z % 23 AS DOUBLE) AS c FROM pts), d AS (SELECT *, a*(a*a - b*c) - b*(c*a - b*b) + c*(c*c - a*b) AS det FROM q)"


def _abc(spark, sf) -> DataFrame:
    return A.points(spark, sf).select("scan_id", "idx", *[(F.col(v) % k).cast("double").alias(n) for v, k, n in zip("xyz", (17, 19, 23), "abc", strict=True)])


@query(f"WITH {_M} SELECT scan_id, idx, {_micro('(a*a - b*c) / det')} AS i00, {_micro('(c*c - b*a) / det')} AS i01, {_micro('(b*b - a*c) / det')} AS i02, {_micro('(b*b - a*c) / det')} AS i10, {_micro('(a*a - c*b) / det')} AS i11, c AS t01, a*b AS o01, c*c AS o22, a + 1 AS plus_one FROM d WHERE det <> 0")
def matrix3_algebra(spark, sf):
    """Inverse, transpose, outer product, sum."""
    m = F.array(*[F.col(x) for x in "abccabbca"])
    p = _abc(spark, sf).select("scan_id", "idx", "a", "b", "c", m.alias("m")).filter(L.det3(F.col("m")) != 0)
    p = p.select("*", L.inverse3(F.col("m")).alias("i"), L.transpose(F.col("m"), 3).alias("t"), L.outer(F.array("a", "b", "c"), 3).alias("o"), L.add(F.col("m"), L.identity(3)).alias("s"))
    return p.select("scan_id", "idx", *[micro(F.col("i")[k]).alias(f"i{k // 3}{k % 3}") for k in range(5)], F.col("t")[1].alias("t01"), F.col("o")[1].alias("o01"), F.col("o")[8].alias("o22"), F.col("s")[0].alias("plus_one"))


@query(
    f"""WITH {_M}, e AS (SELECT *, a*a + 1 AS s FROM d) SELECT scan_id, idx, (s*s + b*b) * 6 AS det, 2*s + 5 AS trace, {_micro('s / (s*s + b*b)')} AS x00, {_micro('b / (s*s + b*b)')} AS x01,
CAST(500000 AS BIGINT) AS x22, {_micro('-c / 6')} AS x23, s*s - b*b AS p00, 5*c AS p23 FROM e"""
)
def matrix4_algebra(spark, sf):
    """Determinant, inverse, trace and product of [[s, -b, 0, 0], [b, s, 0, 0], [0, 0, 2, c], [0, 0, 0, 3]] with s = a a + 1."""
    o, s = F.lit(0.0), F.col("a") * F.col("a") + 1
    cells = [s, -F.col("b"), o, o, F.col("b"), s, o, o, o, o, F.lit(2.0), F.col("c"), o, o, o, F.lit(3.0)]
    names = [f"e{i}{k}" for i in range(4) for k in range(4)]
    p, det, x = L.inverse4_columns(_abc(spark, sf).select("scan_id", "idx", *[c.alias(n) for c, n in zip(cells, names, strict=True)]), names)
    m = F.array(*names)
    square = L.matmul(m, m, 4)
    return p.select("scan_id", "idx", det.alias("det"), L.trace(m, 4).alias("trace"), *[micro(x[i]).alias(n) for i, n in ((0, "x00"), (1, "x01"), (10, "x22"), (11, "x23"))], square[0].alias("p00"), square[11].alias("p23"))


@query(f"WITH {_M} SELECT scan_id, idx, a + 1 AS s00, b AS s01, (c + 1) / 2 AS h22, 6 + 2*(a + b + c) AS trace, a*a + b*b AS q00 FROM q")
def matrix6_algebra(spark, sf):
    """Sum with the identity, division, trace and square of a 6x6 matrix with (a, b, c, a, b, c) on its diagonal and b beside the first."""
    diagonal = ["a", "b", "c", "a", "b", "c"]
    cells = [F.col(diagonal[i]) if i == k else F.col("b") if (i, k) in ((0, 1), (1, 0)) else F.lit(0.0) for i in range(6) for k in range(6)]
    p = _abc(spark, sf).select("scan_id", "idx", F.array(*cells).alias("m"))
    p = p.select("scan_id", "idx", L.add(F.col("m"), L.identity(6)).alias("s"), L.matmul(F.col("m"), F.col("m"), 6).alias("q"))
    return p.select("scan_id", "idx", F.col("s")[0].alias("s00"), F.col("s")[1].alias("s01"), L.scale(F.col("s"), 0.5)[14].alias("h22"), L.trace(F.col("s"), 6).alias("trace"), F.col("q")[0].alias("q00"))


@query(f"WITH {S.POSES}, h AS (SELECT session, seq, tx, ty, tz, ty / 1000.0 AS a, lag(ty / 1000.0) OVER w AS b, lag(tx) OVER w AS lx FROM poses WINDOW w AS (PARTITION BY session ORDER BY seq)) SELECT session, seq, tx - coalesce(lx, tx) AS dx, {_micro('sin((a - coalesce(b, a)) / 2)')} AS dqz, {_micro('cos((a - coalesce(b, a)) / 2)')} AS dqw FROM h")
def pose_rotation_delta(spark, sf):
    """Poses turned about z by ty milliradians."""
    half = F.col("ty") / 2000.0
    p = A.poses(spark, sf).withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(half), "qw": F.cos(half)})
    return TS.rotation_deltas(p).select("session", "seq", "dx", micro(F.col("dqz")).alias("dqz"), micro(F.col("dqw")).alias("dqw"))


@query(f"WITH {S.POSES} SELECT session, seq, {_micro('cos(ty / 1000.0)')} AS after00, {_micro('ty / 1000.0 + 1')} AS after03, {_micro('ty / 1000.0 * cos(ty / 1000.0) - tx / 1000.0 * sin(ty / 1000.0) + 1')} AS before03 FROM poses")
def pose_moved(spark, sf):
    """A pose turned on its right, or on its left, by a rotation about z, and shifted."""
    t = F.array(*[F.lit(float(i == k)) if k < 3 else c for i, c in enumerate((F.col("ty") / 1000.0, F.col("tx") / 1000.0, F.lit(0.0))) for k in range(4)], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    turn, shift = L.euler_rotation(F.lit(0.0), F.lit(0.0), F.col("ty") / 1000.0), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    p = A.poses(spark, sf).select("session", "seq", TS.moved_pose(t, turn, shift).alias("r"), TS.moved_pose(t, turn, shift, before=True).alias("l"))
    return p.select("session", "seq", micro(F.col("r")[0]).alias("after00"), micro(F.col("r")[3]).alias("after03"), micro(F.col("l")[3]).alias("before03"))


_FIXED = lambda e: f"CAST(trunc(({e}) * 32768) AS BIGINT)"


@query(f"SELECT CAST(degrees AS INT) AS degrees, {_FIXED('cos(radians(degrees))')} AS m00, {_FIXED('-sin(radians(degrees))')} AS m01, {_FIXED('sin(radians(degrees))')} AS m10, {_FIXED('degrees / 7.0')} AS m03 FROM range(-179, 180) t(degrees)")
def fixed_matrices(spark, sf):
    """Rotations by whole degrees with a translation, as fixed-point matrices."""
    rows = []
    for d in range(-179, 180):
        c, s = math.cos(math.radians(d)), math.sin(math.radians(d))
        m = G.fixed_matrix([[c, -s, 0, d / 7.0], [s, c, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
        rows.append((d, m[0][0], m[0][1], m[1][0], m[0][3]))
    return spark.createDataFrame(rows, "degrees int, m00 bigint, m01 bigint, m10 bigint, m03 bigint")


@query(f"WITH {S.PTS} SELECT scan_id, CAST(sum(z) AS BIGINT) AS total, {', '.join(f'CAST(sum(CASE WHEN idx % 4 = {k} THEN z ELSE 0 END) AS BIGINT) AS part{k}' for k in range(4))} FROM pts GROUP BY scan_id")
def sums_in_parts(spark, sf):
    """A4."""
    return RG.sums(A.points(spark, sf), "z", ("scan_id",), 4, "idx")


@query(f"WITH {S.TIMINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq DESC) AS back, row_number() OVER (PARTITION BY task ORDER BY seq) AS n FROM timings) SELECT task, CASE WHEN max(n) <= 10 THEN CAST(max(CASE WHEN back = 1 THEN micros END) AS DOUBLE) ELSE CAST(sum(CASE WHEN back <= 10 THEN micros END) AS DOUBLE) / 10 END AS run_avg FROM r GROUP BY task")
def runtime_run_avg(spark, sf):
    """A12."""
    return ME.run_average(A.timings(spark, sf))


@query(f"WITH {S.PTS} SELECT scan_id, idx // 256 AS ring, count(*) AS n FROM pts WHERE idx // 256 BETWEEN 0 AND 11 GROUP BY 1, 2")
def rings_in_range(spark, sf):
    """F18."""
    p = A.points(spark, sf).withColumn("ring", F.floor(F.col("idx") / 256).cast("bigint"))
    return FI.ring_in_range(p, 12).groupBy("scan_id", "ring").agg(F.count("*").alias("n"))


@query(f"WITH {S.PTS} SELECT scan_id, idx, (x-500)*(x-500) + (y+700)*(y+700) + z*z AS d2, CAST(0.25 AS DOUBLE) AS red, CAST(0.5 AS DOUBLE) AS green, CAST(1.0 AS DOUBLE) AS blue FROM pts")
def distances_coloured(spark, sf):
    """O2, O4."""
    p = A.points(spark, sf).select("scan_id", "idx", FI.squared_distance((500, -700, 0)).alias("d2"))
    return PB.coloured(p, 0.25, 0.5, 1.0)


@query("SELECT * FROM (VALUES (0, 'x', CAST(50 AS BIGINT)), (1, 'y', CAST(-20 AS BIGINT)), (2, 'z', CAST(10 AS BIGINT)), (3, 'turn', CAST(0 AS BIGINT))) t(part, name, milli)")
def feature_pose(spark, sf):
    """Every point lies on a plane and on a line through its shifted place, so the solver's pose is that shift (metres, in thousandths)."""
    shift = (0.05, -0.02, 0.01)
    p = A.points(spark, sf).select("idx", *[(F.col(a) / 1000.0).alias(f"p{a}") for a in "xyz"])
    to = [F.col(f"p{a}") + s for a, s in zip("xyz", shift, strict=True)]
    axis = [(F.col("idx") % 3 == k).cast("double") for k in range(3)]
    planes = p.select("px", "py", "pz", *[n.alias(f"n{a}") for n, a in zip(axis, "xyz", strict=True)], (-sum((n * t for n, t in zip(axis[1:], to[1:], strict=True)), axis[0] * to[0])).alias("d"))
    edges = p.filter("idx % 2 = 0").select("px", "py", "pz", *[(t + n).alias(f"a{a}") for t, n, a in zip(to, axis, "xyz", strict=True)], *[(t - n).alias(f"b{a}") for t, n, a in zip(to, axis, "xyz", strict=True)])
    pose = SO.align_features(edges, planes, outer=4)
    turn = float(abs(pose[:3, :3] - [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).max())
    rows = [(i, n, round(float(v) * 1000)) for i, (n, v) in enumerate((("x", pose[0, 3]), ("y", pose[1, 3]), ("z", pose[2, 3]), ("turn", turn)))]
    return spark.createDataFrame(rows, "part int, name string, milli bigint")


@query()
def distribution_match(spark, sf):
    """The cloud, displaced by 200 mm, matched to the Gaussians of its own 4 m cells; then gated by a fitness no match has."""
    p = A.points(spark, sf)
    cells = SO.voxel_gaussians(p, 4000).cache()
    moved = p.select(*[(F.col(a) + (200 if a == "x" else 0)).alias(a) for a in "xyz"])
    pose, fit = SO.match_distributions(moved, cells, 4000, iterations=8)
    gated = SO.refine(moved, cells, 4000, pose, -1.0)
    cells.unpersist()
    rows = [(i, k, float(pose[i, k]), float(gated[i, k]), fit) for i in range(4) for k in range(4)]
    return spark.createDataFrame(rows, "row int, col int, value double, gated double, fitness double")


def _gicp_sql(k: int, res: int, shift: int) -> str:
    """The first equations of voxelised GICP, step by step as operators/gicp.py has them: covariances, cells, pairs, weights, products."""
    six, axes = [(i, j) for i in range(3) for j in range(i, 3)], "xyz"

    def sym(m: str, i: int, j: int) -> str:
        return f"{m}{min(i, j)}{max(i, j)}"

    def inverse(step: str, source: str, m: str, out: str) -> str:
        c = {"00": f"{m}11*{m}22 - {m}12*{m}12", "01": f"{m}02*{m}12 - {m}01*{m}22", "02": f"{m}01*{m}12 - {m}02*{m}11", "11": f"{m}00*{m}22 - {m}02*{m}02", "12": f"{m}01*{m}02 - {m}00*{m}12", "22": f"{m}00*{m}11 - {m}01*{m}01"}
        inner = ", ".join(f"{v} AS c{n}" for n, v in c.items())
        return f"{step} AS (SELECT *, {', '.join(f'c{n} / det AS {out}{n}' for n in c)} FROM (SELECT *, {m}00*c00 + {m}01*c01 + {m}02*c02 AS det FROM (SELECT *, {inner} FROM {source})))"

    jac = [[None, "-p2", "p1", "-1.0", None, None], ["p2", None, "-p0", None, "-1.0", None], ["-p1", "p0", None, None, None, "-1.0"]]
    u = [f"{' + '.join(f'{sym(chr(119), i, r)} * ({jac[r][j]})' for r in range(3) if jac[r][j])} AS u{i}{j}" for i in range(3) for j in range(6)]
    h = {f"h{i}{j}": " + ".join(f"u{r}{j} * ({jac[r][i]})" for r in range(3) if jac[r][i]) for i in range(6) for j in range(i, 6)}
    g = {f"g{i}": " + ".join(f"u{r}{i} * e{r}" for r in range(3)) for i in range(6)}
    around = ", ".join(f"({', '.join(str(s * (a == b)) for b in range(3))})" for a in range(3) for s in ((0, -1, 1) if a == 0 else (-1, 1)))
    steps = [
        f"{Q._PAIR}", Q._KNN,
        f"n5 AS (SELECT q_scan_id, q_idx, {', '.join(f'sum(p_{a}) AS s{i}' for i, a in enumerate(axes))}, {', '.join(f'sum(p_{axes[i]} * p_{axes[j]}) AS q{i}{j}' for i, j in six)} FROM knn GROUP BY 1, 2 HAVING count(*) = {k})",
        f"bs AS (SELECT x, y, z, {', '.join(f'CAST({k} * q{i}{j} - s{i} * s{j} AS DOUBLE) / {k * k}.0 / CAST(1e6 AS DOUBLE) + CAST({1e-6 if i == j else 0} AS DOUBLE) AS b{i}{j}' for i, j in six)} FROM n5 JOIN pts ON pts.scan_id = q_scan_id AND pts.idx = q_idx)",
        inverse("bi", "bs", "b", "i"),
        f"cs AS (SELECT x, y, z, {', '.join(f'b{i}{j} * sqrt({chr(43).join(f'{2 if a != b else 1}*i{a}{b}*i{a}{b}' for a, b in six)}) AS c{i}{j}' for i, j in six)} FROM bi)",
        f"cells AS (SELECT {', '.join(f'{S.fdiv(a, res)} AS i{a}' for a in axes)}, count(*) AS n, {', '.join(f'CAST(sum({a}) AS DOUBLE) / count(*) / 1000.0 AS m{i}' for i, a in enumerate(axes))}, {', '.join(f'avg(c{i}{j}) AS t{i}{j}' for i, j in six)} FROM cs GROUP BY ALL)",
        f"src AS (SELECT x + {shift} AS x, y, z, {', '.join(f'c{i}{j} AS r{i}{j}' for i, j in six)} FROM cs)",
        f"moved AS (SELECT *, {', '.join(f'{a} / CAST(1000 AS DOUBLE) AS p{i}' for i, a in enumerate(axes))}, {', '.join(f'{S.fdiv(a, res)} + o{a} AS i{a}' for a in axes)} FROM src, (VALUES {around}) o(ox, oy, oz))",
        f"paired AS (SELECT n, p0, p1, p2, {', '.join(f'm{i} - p{i} AS e{i}' for i in range(3))}, {', '.join(f't{i}{j} + r{i}{j} AS s{i}{j}' for i, j in six)} FROM moved JOIN cells USING (ix, iy, iz))",
        inverse("vs", "paired", "s", "v"),
        f"ws AS (SELECT p0, p1, p2, e0, e1, e2, {', '.join(f'n * v{i}{j} AS w{i}{j}' for i, j in six)} FROM vs)",
        f"us AS (SELECT *, {', '.join(u)} FROM ws)",
        f"sums AS (SELECT count(*) AS c, {', '.join(f'sum({v}) AS {n}' for n, v in (h | g).items())} FROM us)",
    ]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(round({n} / c * 10) AS BIGINT) AS tenths, c AS pairs FROM sums" for n in h | g)
    return f"WITH {', '.join(steps)} {rows}"


@query(_gicp_sql(5, 4000, 200))
def gicp_equations(spark, sf):
    """Normal equations a pair of the cloud, displaced by 200 mm, against the Gaussians of its own 4 m cells and those by their faces."""
    p = A.points(spark, sf).drop("intensity")
    covs = GI.point_covariances(p, ["scan_id", "idx"], k=5, r=3000)
    row = GI.normal_equations(covs.withColumn("x", F.col("x") + 200), GI.target_cells(covs, 4000), 4000, np.eye(4), 7, GI.few_cells(p, 4000))
    names = [c for c in row.columns if c[0] in "hg"]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n) / F.col("c") * 10).cast("bigint").alias("tenths"), F.col("c").alias("pairs")) for n in names]))
    return row.select(parts.alias("r")).select("r.*")


@query()
def normals_k50(spark, sf):
    """Normals from the 50 nearest points of every point."""
    p = A.points(spark, sf).drop("intensity")
    knn = NB.knn_join(p, p, 50, 4000, ["scan_id", "idx"], keep=(["scan_id", "idx"], ["x", "y", "z"]))
    return NB.principal_axes(NB.scatter(knn, ["q_scan_id", "q_idx"]))


_EIGEN = f"""{Q._PAIR}, {Q._KNN}, {Q._SUMS}, v1 AS (SELECT q_scan_id, q_idx, {', '.join(f'{a}{b} - s{a} * s{b} / 5 AS {a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} FROM m0), v2 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM v1),
v3 AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM v2), v4 AS (SELECT *, CASE WHEN p > 0 THEN ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p) ELSE 0 END AS r FROM v3),
v5 AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM v4), v6 AS (SELECT *, q + 2*p*cos(phi) AS e2, q + 2*p*cos(phi + 2*pi()/3) AS e0 FROM v5)"""


@query(f"WITH {_EIGEN} SELECT q_scan_id, q_idx, e2 > 3 * (3*q - e2 - e0) AS is_line FROM v6")
def line_flags(spark, sf):
    """Whether the greatest eigenvalue of five neighbours' scatter exceeds three times the second."""
    return NB.principal_axes(NB.scatter(Q._knn(spark, sf), ["q_scan_id", "q_idx"]).filter("n = 5")).select("q_scan_id", "q_idx", "is_line")


@query(f"WITH {S.POSES}, w AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM poses) SELECT session, seq, least(k, 20) AS steps FROM w")
def pose_paths(spark, sf):
    """Each pose with the path that led to it."""
    return PB.path_of(A.poses(spark, sf), last=20).select("session", "seq", F.size("path").cast("bigint").alias("steps"))
