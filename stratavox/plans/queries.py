"""The engine's registered queries. Each is (name, function of (spark, sf_dir), SQL or None); SQL runs on the same tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.functions import grid as G
from stratavox.functions import linalg as L
from stratavox.functions import text as T
from stratavox.operators import features as FE
from stratavox.operators import filters as FI
from stratavox.operators import images as IM
from stratavox.operators import mapstore as MS
from stratavox.operators import metrics as ME
from stratavox.operators import neighbours as NB
from stratavox.operators import registration as RG
from stratavox.operators import timeseries as TS
from stratavox.operators import tsdf as TD
from stratavox.operators import voxels as VX
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


def _turn(degrees: float, tx: float, ty: float, tz: float) -> list[list[int]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return G.fixed_matrix([[c, -s, 0, tx], [s, c, 0, ty], [0, 0, 1, tz], [0, 0, 0, 1]])


POSE = _turn(5, 100, -50, 20)
#: A map of 2 m cells whose window of 122 m holds all points of the table.
RES, TAU, HALF = 2000, 6000, 30
WINDOW = ((0, 0, 0), (61, 61, 61))
XYZ = "x, y, z"

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all scans in a 60 m window at 1 m: points to rays to nearest surfaces to weighted voxels."""
    p = A.points(spark, sf_dir)
    half = [TD.merge_nearest(TD.ray_march(p.filter(f"scan_id % 2 = {k}"), 1000, 3000, window=((0, 0, 0), (61, 61, 61)))) for k in (0, 1)]
    return TD.upsert(*half, 640)


# ---------------------------------------------------------------- filters and set operations


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE NOT (x < 300 AND y < 300 AND z < 300)")
def near_origin_filter(spark, sf):
    return FI.drop_near_origin(A.raw_points(spark, sf)).select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE NOT (abs(x) < 9000 AND abs(y) < 9000 AND abs(z) < 9000)")
def near_origin_ball(spark, sf):
    return FI.drop_near_origin(A.raw_points(spark, sf), 9000, "ball").select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE NOT (x = 0 AND y = 0 AND z = 0) AND x BETWEEN -20000 AND 20000 AND y BETWEEN -20000 AND 20000 AND z BETWEEN -5000 AND 5000")
def zero_and_box_reject(spark, sf):
    return FI.box(FI.drop_zero(A.raw_points(spark, sf)), (20000, 20000, 5000)).select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT scan_id, x*x+y*y+z*z >= 2000*2000 AND x*x+y*y+z*z <= CAST(30000 AS BIGINT)*30000 AS in_range, count(*) AS n FROM raw GROUP BY 1, 2")
def range_gate(spark, sf):
    return FI.range_gate(A.raw_points(spark, sf), 2000, 30000).groupBy("scan_id", "in_range").agg(F.count("*").alias("n"))


@query(f"WITH {S.RAW} SELECT scan_id, intensity < 50 AS dim, count(*) AS n FROM raw GROUP BY 1, 2")
def intensity_gate(spark, sf):
    return FI.intensity_gate(A.raw_points(spark, sf)).groupBy("scan_id", "dim").agg(F.count("*").alias("n"))


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE x BETWEEN -9500 AND 10500 AND y BETWEEN -10500 AND 9500 AND z BETWEEN -10000 AND 10000")
def box_crop(spark, sf):
    return FI.box(A.raw_points(spark, sf), (10000, 10000, 10000), (500, -500, 0)).select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE (x-1000)*(x-1000)+(y+2000)*(y+2000)+(z-500)*(z-500) <= 7500*7500")
def radius_filter(spark, sf):
    return FI.radius(A.raw_points(spark, sf), 7500, (1000, -2000, 500)).select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT scan_id, {XYZ} FROM raw WHERE x*x + y*y <= 6000*6000")
def planar_range_filter(spark, sf):
    return FI.radius(A.raw_points(spark, sf), 6000, (0, 0, 0), planar=True).select("scan_id", "x", "y", "z")


@query(f"WITH {S.RAW}, c AS (SELECT DISTINCT {', '.join(f'{S.fdiv(a, 500)} AS i{a}' for a in 'xyz')} FROM raw) SELECT * FROM c WHERE abs(ix - 2) <= 20 AND abs(iy + 3) <= 20 AND abs(iz) <= 10")
def window_cells(spark, sf):
    cells = A.raw_points(spark, sf).select(*[G.cell_floor(a, 500).alias(f"i{a}") for a in "xyz"])
    return FI.in_window(cells, (2, -3, 0), (41, 41, 21)).distinct()


@query(f"WITH {S.RAW} SELECT scan_id, count(*) AS n FROM raw WHERE l_partkey % 7 <> 0 GROUP BY scan_id")
def nan_filter(spark, sf):
    p = A.raw_points(spark, sf).withColumn("x", F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x").cast("double")))
    return FI.drop_nan(p).groupBy("scan_id").agg(F.count("*").alias("n"))


@query(f"WITH {S.RAW} SELECT scan_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx FROM raw GROUP BY scan_id HAVING count(*) BETWEEN 4000 AND 1000000")
def full_scans(spark, sf):
    return FI.full_scans(A.raw_points(spark, sf), 4000, 1_000_000).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


@query(f"WITH {S.RAW} SELECT {XYZ} FROM raw WHERE scan_id % 3 = 0 UNION ALL SELECT {XYZ} FROM raw WHERE scan_id % 3 = 1")
def union_clouds(spark, sf):
    p = A.raw_points(spark, sf)
    return FI.union_clouds(p.filter("scan_id % 3 = 0"), p.filter("scan_id % 3 = 1")).select("x", "y", "z")


@query(f"WITH {S.PTS} SELECT scan_id, idx, {XYZ} FROM pts WHERE (scan_id, idx) NOT IN (SELECT (scan_id, idx) FROM pts WHERE intensity < 30)")
def surf_complement(spark, sf):
    p = A.points(spark, sf)
    return FI.complement(p, p.filter("intensity < 30"), ["scan_id", "idx"]).select("scan_id", "idx", "x", "y", "z")


# ---------------------------------------------------------------- voxels and cells


@query(f"WITH {S.RAW} SELECT DISTINCT {', '.join(f'{S.fdiv(a, 640)} * 640 + 320 AS {a}' for a in 'xyz')} FROM raw")
def voxel_distinct(spark, sf):
    return VX.distinct_voxels(A.raw_points(spark, sf), 640)


@query(f"WITH {S.RAW}, v AS (SELECT DISTINCT {', '.join(f'{S.fdiv(a, 640)} * 640 + 320 AS {a}' for a in 'xyz')} FROM raw) SELECT DISTINCT {', '.join(f'{e} AS {a}' for e, a in zip(S.transform(POSE), 'xyz', strict=True))} FROM v")
def voxel_distinct_moved(spark, sf):
    return VX.distinct_voxels(A.raw_points(spark, sf), 640, POSE)


@query(f"WITH {S.PTS}, c AS (SELECT *, x // 2000 AS ix, y // 2000 AS iy, z // 2000 AS iz FROM pts) SELECT scan_id, ix, iy, iz, idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, ix, iy, iz ORDER BY idx) AS rn FROM c) WHERE rn = 1")
def voxel_first_hit(spark, sf):
    return VX.first_hit(A.points(spark, sf), 2000).select("scan_id", "ix", "iy", "iz", "idx", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT {', '.join(f'{S.fdiv(a, 2000)} AS i{a}' for a in 'xyz')}, count(*) AS n, {', '.join(f'CAST(sum({a}) AS BIGINT) // count(*) AS {a}' for a in 'xyz')} FROM raw GROUP BY 1, 2, 3")
def voxel_mean(spark, sf):
    return VX.voxel_mean(A.raw_points(spark, sf), 2000)


@query(f"WITH {S.RAW} SELECT {', '.join(f'{S.fdiv(a, 4000)} AS i{a}' for a in 'xyz')}, count(*) AS n, {', '.join(f'CAST(sum({a}) AS DOUBLE) / count(*) AS {a}' for a in 'xyz')} FROM raw GROUP BY 1, 2, 3")
def voxel_centroid(spark, sf):
    return VX.voxel_centroid(A.raw_points(spark, sf), 4000)


_SLOTS = f"{S.PTS}, c AS (SELECT scan_id, idx, x, y, z, {', '.join(f'{S.fdiv(a, 2000)} AS i{a}' for a in 'xyz')} FROM pts), s AS (SELECT *, (ix * 7171 + iy * 3079 + iz * 4231) & 511 AS slot FROM c)"


@query(
    f"WITH {_SLOTS}, f AS (SELECT *, CASE WHEN lag((ix, iy, iz)) OVER w = (ix, iy, iz) THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY scan_id, slot ORDER BY idx)), "
    "r AS (SELECT *, sum(fresh) OVER (PARTITION BY scan_id, slot ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM f) "
    f"SELECT scan_id, slot, ix, iy, iz, CAST(run AS BIGINT) AS run, count(*) AS n, {', '.join(f'CAST(sum({a}) AS DOUBLE) / count(*) AS {a}' for a in 'xyz')} FROM r GROUP BY ALL"
)
def approximate_grid(spark, sf):
    """A1e over whole scans: what each slot of 512 gives out, in order."""
    return VX.approximate_grid(A.points(spark, sf), 2000)


@query(f"WITH {S.PTS}, m AS (SELECT scan_id, {', '.join(f'CAST(sum({a}) AS BIGINT) // count(*) AS m{a}' for a in 'xyz')} FROM pts GROUP BY scan_id) SELECT scan_id, idx, {', '.join(f'{a} - m{a} AS {a}' for a in 'xyz')} FROM pts JOIN m USING (scan_id)")
def demeaned(spark, sf):
    return VX.demean(A.points(spark, sf), ("scan_id",)).select("scan_id", "idx", "x", "y", "z")


@query(f"WITH {S.RAW} SELECT x // 640 AS t, {S.fdiv('x', 640)} AS f, count(*) AS n FROM raw GROUP BY 1, 2")
def cell_trunc_vs_floor(spark, sf):
    return A.raw_points(spark, sf).groupBy(G.cell_trunc("x", 640).alias("t"), G.cell_floor("x", 640).alias("f")).agg(F.count("*").alias("n"))


@query(f"""WITH {S.RAW}, c AS (SELECT {', '.join(f'{S.fdiv(a, 100)} AS i{a}' for a in 'xyz')} FROM raw), k AS (SELECT {', '.join(f'{S.fdiv(f"i{a}", 64)} AS c{a}' for a in 'xyz')}, ix, iy, iz FROM c)
SELECT cx, cy, cz, count(*) AS points, count(DISTINCT (ix, iy, iz)) AS cells, min((ix - cx*64) * 4096 + (iy - cy*64) * 64 + iz - cz*64) AS first_slot FROM k GROUP BY cx, cy, cz""")
def chunk_histogram(spark, sf):
    return VX.chunk_histogram(A.raw_points(spark, sf).select(*[G.cell_floor(a, 100).alias(f"i{a}") for a in "xyz"]))


@query(f"WITH {S.RAW}, c AS (SELECT DISTINCT {', '.join(f'{S.fdiv(a, 6400)} AS c{a}' for a in 'xyz')} FROM raw) SELECT cx || '_' || cy || '_' || cz AS tag, cx AS back_x, cz AS back_z FROM c")
def chunk_tag(spark, sf):
    c = A.raw_points(spark, sf).select(*[G.fdiv(a, 6400).alias(f"c{a}") for a in "xyz"]).distinct().select(G.chunk_tag("cx", "cy", "cz").alias("tag"))
    x, _, z = T.split_tag(F.col("tag"))
    return c.select("tag", x.alias("back_x"), z.alias("back_z"))


@query(f"WITH {S.RAW}, c AS (SELECT DISTINCT {S.fdiv('x', 500)} AS ix FROM raw) SELECT ix, ((ix - 24 + 26) % 41 + 41) % 41 AS slot, abs(ix - 24) <= 20 AS inside FROM c")
def ring_index(spark, sf):
    c = A.raw_points(spark, sf).select(G.cell_floor("x", 500).alias("ix")).distinct()
    return c.select("ix", G.ring_index("ix", 24, 26, 41).alias("slot"), G.in_bounds("ix", 24, 41).alias("inside"))


@query(f"WITH {S.PTS} SELECT scan_id, idx, {', '.join(f'{e} AS {a}' for e, a in zip(S.transform(POSE), 'xyz', strict=True))} FROM pts")
def fixed_transform(spark, sf):
    return A.points(spark, sf).select("scan_id", "idx", *[c.alias(a) for c, a in zip(G.fixed_transform("x", "y", "z", POSE), "xyz", strict=True)])


_HALVES = [[0.5, 0.0, -0.25, 10.5], [0.0, 0.5, 0.25, -3.25], [0.25, 0.5, 1.0, 0.75]]


@query("WITH " + S.PTS + " SELECT scan_id, idx, " + ", ".join(f"CAST(trunc(({r[0]} * x + {r[1]} * y + {r[2]} * z + {r[3]}) + CASE WHEN {r[0]} * x + {r[1]} * y + {r[2]} * z + {r[3]} < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS {a}" for r, a in zip(_HALVES, "xyz", strict=True)) + " FROM pts")
def float_transform(spark, sf):
    return A.points(spark, sf).select("scan_id", "idx", *[c.alias(a) for c, a in zip(G.float_transform("x", "y", "z", _HALVES), "xyz", strict=True)])


@query(f"WITH {S.PTS} SELECT scan_id, idx, CAST(trunc(CAST(x AS DOUBLE) * CAST(0.001 AS DOUBLE) * 1000) AS BIGINT) AS mm, {S.norm('x', 'y', 'z')} AS rng FROM pts")
def metres_and_ranges(spark, sf):
    """E1, E12."""
    return A.points(spark, sf).select("scan_id", "idx", G.to_mm(F.col("x") * 0.001).alias("mm"), G.norm_trunc("x", "y", "z").alias("rng"))


@query(f"WITH {S.RAW}, c AS (SELECT DISTINCT {', '.join(f'{S.fdiv(a, 4000)} AS i{a}' for a in 'xyz')} FROM raw) SELECT ix, iy, iz, xor(xor(ix * 4294967296, iy * 65536), iz) AS h FROM c")
def voxel_hash(spark, sf):
    c = A.raw_points(spark, sf).select(*[G.cell_floor(a, 4000).alias(f"i{a}") for a in "xyz"]).distinct()
    return c.select("ix", "iy", "iz", G.voxel_hash("ix", "iy", "iz").alias("h"))


@query("SELECT x AS ix, y AS iy, z AS iz, CAST(floor(x / 64.0) AS BIGINT) AS cx, CAST(floor(y / 64.0) AS BIGINT) AS cy, CAST(floor(z / 64.0) AS BIGINT) AS cz FROM range(-66, 3) a(x), range(60, 70) b(y), range(-2, 2) c(z)")
def dense_box(spark, sf):
    return VX.dense_box(spark, (-66, 60, -2), (2, 69, 1))


# ---------------------------------------------------------------- vectors and matrices


@query(f"WITH {S.PTS}, q AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM pts WINDOW w AS (PARTITION BY scan_id ORDER BY idx)) SELECT scan_id, idx, CAST(x*bx + y*by_ + z*bz AS DOUBLE) AS dot, CAST(y*bz - z*by_ AS DOUBLE) AS cx, CAST(z*bx - x*bz AS DOUBLE) AS cy, CAST(x*by_ - y*bx AS DOUBLE) AS cz, CAST(abs(x)+abs(y)+abs(z) AS DOUBLE) AS l1, sqrt(CAST(x*x+y*y+z*z AS DOUBLE)) AS l2 FROM q WHERE bx IS NOT NULL")
def vector_products(spark, sf):
    w = Window.partitionBy("scan_id").orderBy("idx")
    p = A.points(spark, sf).select("scan_id", "idx", F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("a"))
    p = p.withColumn("b", F.lead("a").over(w)).filter("b is not null")
    c = L.cross(F.col("a"), F.col("b"))
    return p.select("scan_id", "idx", L.dot(F.col("a"), F.col("b")).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), L.l1norm(F.col("a")).alias("l1"), L.l2norm(F.col("a")).alias("l2"))


@query(f"WITH {S.PTS}, q AS (SELECT *, CAST(x % 17 AS DOUBLE) AS a, CAST(y % 19 AS DOUBLE) AS b, CAST(z % 23 AS DOUBLE) AS c FROM pts) SELECT scan_id, idx, a*(a*a - b*c) - b*(c*a - b*b) + c*(c*c - a*b) AS det, 3*a AS trace, a*a + b*c + c*b AS m00, b*a + c*c + a*b AS m22x FROM q")
def matrix_products(spark, sf):
    a, b, c = [(F.col(v) % k).cast("double") for v, k in zip("xyz", (17, 19, 23), strict=True)]
    m = F.array(a, b, c, c, a, b, b, c, a)
    p = A.points(spark, sf).select("scan_id", "idx", m.alias("m"))
    sq = L.matmul(F.col("m"), F.col("m"), 3)
    return p.select("scan_id", "idx", L.det3(F.col("m")).alias("det"), L.trace(F.col("m"), 3).alias("trace"), sq[0].alias("m00"), sq[6].alias("m22x"))


@query("WITH " + S.PTS + " SELECT scan_id, " + ", ".join(f"CAST(sum({a} * {b}) AS DOUBLE) / count(*) AS {a}_{b}" for a in "xyz" for b in "xyz") + " FROM pts GROUP BY scan_id")
def cov3(spark, sf):
    return RG.covariance(A.points(spark, sf), ("x", "y", "z"), keys=("scan_id",))


_SIX = {f"j{i}": f"({a} % {k})" for i, (a, k) in enumerate([("x", 101), ("y", 103), ("z", 107), ("x", 109), ("y", 113), ("z", 127)])}


@query("WITH " + S.PTS + ", j AS (SELECT scan_id, " + ", ".join(f"{e} AS {n}" for n, e in _SIX.items()) + " FROM pts) SELECT scan_id, " + ", ".join(f"CAST(sum({a} * {b}) AS DOUBLE) / count(*) AS {a}_{b}" for a in _SIX for b in _SIX) + " FROM j GROUP BY scan_id")
def cov6(spark, sf):
    return RG.covariance(A.points(spark, sf).selectExpr("scan_id", *[f"{e} as {n}" for n, e in _SIX.items()]), tuple(_SIX), keys=("scan_id",))


@query(f"WITH {S.PTS} SELECT scan_id, CAST(sum(x) AS BIGINT) AS total, CAST(sum(CASE WHEN idx % 2 = 0 THEN x ELSE 0 END) AS BIGINT) AS part0, CAST(sum(CASE WHEN idx % 2 = 1 THEN x ELSE 0 END) AS BIGINT) AS part1, min(x) AS least, count(CASE WHEN z = 0 THEN 1 END) AS zeros FROM pts GROUP BY scan_id")
def split_sums(spark, sf):
    p = A.points(spark, sf)
    part = lambda k: F.sum(F.when(F.col("idx") % 2 == k, F.col("x")).otherwise(0)).alias(f"part{k}")
    return p.groupBy("scan_id").agg(F.sum("x").alias("total"), part(0), part(1), F.min("x").alias("least"), F.count_if(F.col("z") == 0).alias("zeros"))


@query(f"WITH {S.PTS} SELECT scan_id, idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY x*x + y*y + z*z, idx) AS rn FROM pts) WHERE rn = 1")
def nearest_to_origin(spark, sf):
    p = A.points(spark, sf).withColumn("d2", FI.squared_distance((0, 0, 0)))
    return FI.first_by(p, ["scan_id"], ["d2", "idx"]).select("scan_id", "idx", "x", "y", "z")


@query(f"WITH {S.PTS} SELECT scan_id, idx, CAST(z AS DOUBLE) AS x, CAST(x AS DOUBLE) AS y, CAST(y AS DOUBLE) AS z FROM pts")
def quaternion_transform(spark, sf):
    """E11 by the quaternion of equal parts, which turns the axes into one another."""
    q = [F.lit(0.5)] * 4
    r = L.quat_rotate(q, [F.col(a).cast("double") for a in "xyz"])
    return A.points(spark, sf).select("scan_id", "idx", *[c.alias(a) for c, a in zip(r, "xyz", strict=True)])


@query(f"WITH {S.PTS} SELECT scan_id, CAST(trunc((degrees(atan(z / sqrt(CAST(x*x + y*y AS DOUBLE)))) + 22.5) / 2 + 0.5) AS BIGINT) AS ring, count(*) AS n FROM pts WHERE x <> 0 GROUP BY 1, 2")
def elevation_ring(spark, sf):
    p = A.points(spark, sf).filter("x <> 0")
    return p.groupBy("scan_id", G.elevation_ring("x", "y", "z").alias("ring")).agg(F.count("*").alias("n"))


_IMG = "img AS (SELECT scan_id AS image_id, idx // 256 AS row, idx % 256 AS col, (abs(x) % 256 * 299 + abs(y) % 256 * 587 + abs(z) % 256 * 114 + 500) // 1000 AS level FROM pts)"
_TAP = lambda src, axis, other: " + ".join(f"{t} * coalesce({f}({src}, {d}) OVER (PARTITION BY image_id, {other} ORDER BY {axis}), {src})" for t, f, d in ((1, "lag", 2), (4, "lag", 1), (6, "lag", 0), (4, "lead", 1), (1, "lead", 2)))


@query(f"WITH {S.PTS}, {_IMG}, h AS (SELECT *, {_TAP('level', 'col', 'row')} AS hs FROM img), v AS (SELECT *, {_TAP('hs', 'row', 'col')} AS vs FROM h) SELECT image_id, row, col, level, vs // 256 AS smooth FROM v")
def image_smoothing(spark, sf):
    p = A.points(spark, sf).select(F.col("scan_id").alias("image_id"), G.idiv("idx", 256).alias("row"), F.pmod("idx", F.lit(256)).alias("col"), *[(F.abs(a) % 256).alias(c) for a, c in zip("xyz", "rgb", strict=True)])
    return IM.gaussian(IM.grey(p)).select("image_id", "row", "col", "level", "smooth")


# ---------------------------------------------------------------- signed distances


@query(f"SELECT v AS value, {S.weight('v', 600)} AS weight, CAST(v AS BIGINT) & 65535 | (({S.weight('v', 600)}) << 16) AS raw FROM range(-600, 601) t(v)")
def tsdf_weight_ramp(spark, sf):
    v = spark.range(-600, 601).select(F.col("id").alias("value"), G.tsdf_weight("id", 600).alias("weight"))
    return v.select("value", "weight", G.pack("value", "weight").alias("raw"))


@query(f"WITH {S.PTS} SELECT scan_id, idx, x % 30000 AS value, y % 640 AS weight FROM pts")
def tsdf_pack_roundtrip(spark, sf):
    p = A.points(spark, sf).select("scan_id", "idx", G.pack(F.col("x") % 30000, F.col("y") % 640).alias("raw"))
    return p.select("scan_id", "idx", G.unpack_value("raw").alias("value"), G.unpack_weight("raw").alias("weight"))


#: Points of a task that marches or splats them: each makes about 20 cells, and the merge within scans holds the task's cells.
PER_TASK = 150_000


def _rays(spark, sf, where: str = "true", dz: int | None = None) -> DataFrame:
    return TD.ray_march(A.points(spark, sf, PER_TASK).filter(where), RES, TAU, window=WINDOW, dz_per_distance=dz)


_DZ = TD.beam_spread()
#: Vertical spread of the fanned queries, wider than a beam's so that fans hold several cells.
FAN = 2000


@query(f"WITH {S.rays(RES, TAU, HALF, _DZ)} SELECT scan_id, idx, len, step, ix, iy, iz, value, weight FROM cells")
def ray_march_cells(spark, sf):
    return _rays(spark, sf).drop("x", "y", "z")


@query(f"WITH {S.rays(RES, TAU, HALF, FAN)} SELECT scan_id, idx, len, step, ix, iy, iz, value, weight FROM cells")
def ray_march_fan(spark, sf):
    return _rays(spark, sf, dz=FAN).drop("x", "y", "z")


@query(f"WITH {S.rays(RES, TAU, HALF, FAN)}, {S.merged()} SELECT * FROM voxels")
def ray_merge_min(spark, sf):
    return TD.merge_nearest(_rays(spark, sf, dz=FAN))


def _state(spark, sf, parity: int) -> DataFrame:
    return TD.merge_nearest(_rays(spark, sf, f"scan_id % 2 = {parity}", FAN))


_TWO = f"{S.rays(RES, TAU, HALF, FAN)}, even AS (SELECT * FROM cells WHERE scan_id % 2 = 0), odd_ AS (SELECT * FROM cells WHERE scan_id % 2 = 1), {S.merged('a', 'even')}, {S.merged('b', 'odd_')}"
_UPSERT = f"""{_TWO}, j AS (SELECT coalesce(a.ix, b.ix) AS ix, coalesce(a.iy, b.iy) AS iy, coalesce(a.iz, b.iz) AS iz, a.value AS v, a.weight AS w, b.value AS nv, b.weight AS nw
  FROM a FULL JOIN b ON a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz),
up AS (SELECT ix, iy, iz, coalesce(CASE WHEN w > 0 AND nw > 0 THEN (v * w + nv * nw) // (w + nw) WHEN nw IS NOT NULL AND nw <> 0 AND NOT coalesce(w > 0, false) THEN nv ELSE v END, nv) AS value,
  coalesce(CASE WHEN w > 0 AND nw > 0 THEN least(640, w + nw) WHEN nw IS NOT NULL AND nw <> 0 AND NOT coalesce(w > 0, false) THEN nw ELSE w END, nw) AS weight FROM j)"""


@query(f"WITH {_UPSERT} SELECT * FROM up")
def tsdf_upsert(spark, sf):
    return TD.upsert(_state(spark, sf, 0), _state(spark, sf, 1), 640)


_V = f"{S.rays(RES, TAU, HALF, _DZ)}, {S.merged()}"


def _voxels(spark, sf) -> DataFrame:
    return TD.merge_nearest(_rays(spark, sf))


@query(f"WITH {_V} SELECT ix * {RES} + {RES // 2} AS x, iy * {RES} + {RES // 2} AS y, iz * {RES} + {RES // 2} AS z, CASE WHEN value >= 0 THEN CAST(value AS DOUBLE) / {TAU}.0 ELSE 0.0 END AS red, CASE WHEN value < 0 THEN -(CAST(value AS DOUBLE) / {TAU}.0) ELSE 0.0 END AS green FROM voxels WHERE weight > 0 AND abs(value) < {TAU}")
def iso_surface(spark, sf):
    return PB.surface_points(_voxels(spark, sf), TAU, RES)


@query(f"WITH {_V} SELECT cx, cy, cz, count(*) AS cells, CAST(sum((value & 65535) | ((weight & 65535) << 16)) AS BIGINT) AS raw_sum FROM (SELECT {', '.join(f'{S.fdiv(f"i{a}", 64)} AS c{a}' for a in 'xyz')}, value, weight FROM voxels) GROUP BY 1, 2, 3")
def map_chunk_sums(spark, sf):
    v = MS.with_chunk(_voxels(spark, sf))
    return v.groupBy("cx", "cy", "cz").agg(F.count("*").alias("cells"), F.sum(G.pack("value", "weight")).alias("raw_sum"))


@query(f"WITH {_V} SELECT ix, iy, iz, value, weight FROM voxels WHERE weight > 0")
def map_readback(spark, sf):
    return MS.touched_cells(MS.dense_chunks(_voxels(spark, sf), TAU))


_IN = lambda p: f"(abs(ix - {p[0]}) <= 2 AND abs(iy - {p[1]}) <= 2 AND abs(iz - {p[2]}) <= 2)"


@query(f"WITH {_V} SELECT * FROM voxels WHERE {_IN((0, 0, 0))} AND NOT {_IN((2, 1, 0))}")
def map_shift_leaving(spark, sf):
    return MS.leaving(_voxels(spark, sf), (0, 0, 0), (2, 1, 0), (5, 5, 5))


@query(f"WITH {_V} SELECT * FROM voxels WHERE {_IN((2, 1, 0))} AND NOT {_IN((0, 0, 0))}")
def map_shift_entering(spark, sf):
    return MS.entering(_voxels(spark, sf), (0, 0, 0), (2, 1, 0), (5, 5, 5))


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), " + ", ".join(f"CAST({((1, -2, 0)[i] + ((10, 10, 2)[i] if c >> i & 1 else -(10, 10, 2)[i])) * 64} AS BIGINT)" for c in (a, b) for i in range(3)) + ")" for k, (a, b) in enumerate(PB.EDGES)) + ") t(edge, x0, y0, z0, x1, y1, z1)")
def map_window_edges(spark, sf):
    return PB.window_edges(spark, (1, -2, 0), (21, 21, 5), 64)


_SM = G.MATRIX_RESOLUTION
_CROSS = lambda u, v: [f"{u}{p} * {v}{q} - {u}{q} * {v}{p}" for p, q in ("yz", "zx", "xy")]
_SPLAT = f"""{S.PTS}, s0 AS (SELECT scan_id, idx, x, y, z, sqrt(CAST(x*x + y*y + z*z AS DOUBLE)) AS len FROM pts WHERE abs(x // {RES}) <= {HALF} AND abs(y // {RES}) <= {HALF} AND abs(z // {RES}) <= {HALF}),
s1 AS (SELECT scan_id, idx, {', '.join(f'{a} * {_SM} // {RES} AS d{a}' for a in 'xyz')}, {', '.join(f'CAST(trunc(-{a} / len * {_SM}) AS BIGINT) AS n{a}' for a in 'xyz')} FROM s0),
s2 AS (SELECT *, {S.norm('dx', 'dy', 'dz')} AS dist FROM s1), s3 AS (SELECT *, (-({' + '.join(f'n{a} * (d{a} * {_SM} // dist)' for a in 'xyz')})) // {_SM} AS acc FROM s2 WHERE dist > 0),
s4 AS (SELECT scan_id, idx, dx, dy, dz, dist, abs(acc) AS acc, {', '.join(f'CASE WHEN acc < 0 THEN -n{a} ELSE n{a} END AS n{a}' for a in 'xyz')} FROM s3 WHERE acc <> 0),
s5 AS (SELECT *, {', '.join(f'CASE WHEN nx = 0 AND nz = 0 THEN {f} ELSE {g} END AS u{a}' for a, f, g in (('x', '0', '-nz'), ('y', 'nz', '0'), ('z', '-ny', 'nx')))} FROM s4),
s6 AS (SELECT *, {', '.join(f'({c}) // {_SM} AS v{a}' for a, c in zip('xyz', _CROSS('n', 'u'), strict=True))} FROM s5), s7 AS (SELECT *, {', '.join(f'({c}) // {_SM} AS t{a}' for a, c in zip('xyz', _CROSS('n', 'v'), strict=True))}, dist * {2 * int(math.tan(45.0 / 256 / 180 * math.pi) / 2.0 * _SM)} // {_SM} + 1 AS reach FROM s6),
s8 AS (SELECT *, unnest(range(-reach, reach + 1, {_SM // 2})) AS la FROM s7), s9 AS (SELECT *, unnest(range(-reach, reach + 1, {_SM // 2})) AS lb FROM s8), s10 AS (SELECT *, unnest(range(-{TAU * _SM // RES}, {TAU * _SM // RES} + 1, {_SM // 2})) AS ln FROM s9),
s11 AS (SELECT DISTINCT scan_id, idx, acc, dx, dy, dz, nx, ny, nz, {', '.join(f'CAST(floor((d{a} + t{a} * la // {_SM} + v{a} * lb // {_SM} + n{a} * ln // {_SM}) / {_SM}.0) AS BIGINT) AS i{a}' for a in 'xyz')} FROM s10),
s12 AS (SELECT *, {', '.join(f'd{a} * {RES} // {_SM} - (i{a} * {RES} + {RES // 2}) AS e{a}' for a in 'xyz')} FROM s11), s13 AS (SELECT *, {S.norm('ex', 'ey', 'ez')} AS near, nx*ex + ny*ey + nz*ez AS front FROM s12 WHERE abs(ix) <= {HALF} AND abs(iy) <= {HALF} AND abs(iz) <= {HALF}),
s14 AS (SELECT *, CASE WHEN front > 0 THEN -near ELSE near END AS value FROM s13 WHERE near <= {TAU}), s15 AS (SELECT *, ({S.weight('value', TAU)}) * acc // {_SM} AS weight FROM s14),
splats AS (SELECT *, 0 AS len, 0 AS step FROM s15 WHERE weight <> 0)"""


@query(f"WITH {_SPLAT}, {S.merged('voxels', 'splats')} SELECT * FROM voxels")
def normal_splat(spark, sf):
    """Normals are the directions back to the scanner; also checked against a sequential loop in the tests."""
    p = A.points(spark, sf, PER_TASK)
    n = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).cast("double"))
    p = p.select("scan_id", "idx", "x", "y", "z", *[(-F.col(a) / n).alias(f"n{a}") for a in "xyz"])
    return TD.merge_nearest(TD.splat(p, RES, TAU, window=WINDOW), order=("scan_id", "idx"))


# ---------------------------------------------------------------- registration


@query(f"WITH {_V}, {S.gradient()} SELECT * FROM grads")
def neighbour_gradient(spark, sf):
    return RG.gradients(_voxels(spark, sf))


_MATCH = f"""{_V}, {S.gradient()}, mv AS (SELECT scan_id, idx, {', '.join(f'{e} AS {a}' for e, a in zip(S.transform(POSE), 'xyz', strict=True))} FROM pts),
hit AS (SELECT mv.*, g.ix, g.iy, g.iz, g.value, g.weight, g.gx, g.gy, g.gz FROM mv JOIN grads g ON x // {RES} = g.ix AND y // {RES} = g.iy AND z // {RES} = g.iz WHERE g.weight <> 0)"""


def _matched(spark, sf) -> DataFrame:
    return RG.match_points(A.points(spark, sf), RG.gradients(_voxels(spark, sf)), RES, POSE)


@query(f"WITH {_MATCH} SELECT scan_id, idx, x, y, z, ix, iy, iz, value, weight, gx, gy, gz FROM hit")
def point_voxel_join(spark, sf):
    return _matched(spark, sf).select("scan_id", "idx", "x", "y", "z", "ix", "iy", "iz", "value", "weight", "gx", "gy", "gz")


_J = ["(y + 50) * gz - (z - 20) * gy", "(z - 20) * gx - (x - 100) * gz", "(x - 100) * gy - (y + 50) * gx", "gx", "gy", "gz"]


@query(f"WITH {_MATCH}, jac AS (SELECT scan_id, value, {', '.join(f'{e} AS j{i}' for i, e in enumerate(_J))} FROM hit) SELECT scan_id, " + ", ".join(f"CAST(sum(j{i} * j{k}) AS BIGINT) AS h{i}{k}" for i in range(6) for k in range(i, 6)) + ", " + ", ".join(f"CAST(sum(j{i} * value) AS BIGINT) AS g{i}" for i in range(6)) + ", CAST(sum(abs(value)) AS BIGINT) AS e, count(*) AS c FROM jac GROUP BY scan_id")
def normal_equations(spark, sf):
    sums = RG.normal_equations(RG.jacobians(_matched(spark, sf), (100, -50, 20)), ("scan_id",))
    return sums.select("scan_id", *[F.col(c).cast("bigint").alias(c) for c in sums.columns[1:]])


@query(f"""WITH {S.PTS}, mv AS (SELECT scan_id, {', '.join(f'{a} - {e} AS d{a}' for e, a in zip(S.transform(POSE), 'xyz', strict=True))} FROM pts), e AS (SELECT *, dx*dx+dy*dy+dz*dz AS d2 FROM mv),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY d2) - 1 AS rn, count(*) OVER (PARTITION BY scan_id) AS cnt FROM e)
SELECT scan_id, count(*) AS n, min(d2) AS min_d2, max(d2) AS max_d2, CAST(sum(abs(dx)) AS BIGINT) AS sum_x, CAST(sum(abs(dy)) AS BIGINT) AS sum_y, CAST(sum(abs(dz)) AS BIGINT) AS sum_z, max(CASE WHEN rn = least(cnt // 2 + 1, cnt - 1) THEN d2 END) AS median_d2 FROM r GROUP BY scan_id""")
def median_as_coded(spark, sf):
    p = A.points(spark, sf)
    moved = G.fixed_transform("x", "y", "z", POSE)
    return RG.error_stats(p, tuple(F.col(a) - m for a, m in zip("xyz", moved, strict=True)), ("scan_id",))


@query()
def registration_loop(spark, sf):
    """Pose that moves a shifted half of the scans onto the map of all; iterative, so checked by its properties in the tests."""
    from stratavox.plans.pipelines import register_scans

    return register_scans(spark, sf, RES, TAU, WINDOW, max_iterations=12)


# ---------------------------------------------------------------- features


_CURVE = "curve AS (SELECT *, CASE WHEN col BETWEEN 5 AND 249 THEN " + " + ".join(f"pow_{a}" for a in "xyz") + " END AS curvature FROM (SELECT *, " + ", ".join(f"(CAST(sum({a}) OVER w AS BIGINT) - 11 * {a}) * (CAST(sum({a}) OVER w AS BIGINT) - 11 * {a}) AS pow_{a}" for a in "xyz") + " FROM grid WINDOW w AS (PARTITION BY scan_id, ring ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)))"


def _curved(spark, sf) -> DataFrame:
    return FE.curvature(A.grid(spark, sf), A.GRID_WIDTH)


@query(f"WITH {S.GRID}, {_CURVE} SELECT scan_id, ring, col, curvature FROM curve")
def curvature(spark, sf):
    return _curved(spark, sf).select("scan_id", "ring", "col", "curvature")


_MARK = """f AS (SELECT *, CASE WHEN col BETWEEN 5 AND 249 THEN rng ELSE 0 END AS r FROM grid), n AS (SELECT *, lead(r) OVER w AS nx, lag(r) OVER w AS pv FROM f WINDOW w AS (PARTITION BY scan_id, ring ORDER BY col)),
fl AS (SELECT *, CASE WHEN col BETWEEN 5 AND 249 AND r - nx > 8000 THEN 1 ELSE 0 END AS dr, CASE WHEN col BETWEEN 5 AND 249 AND nx - r > 8000 THEN 1 ELSE 0 END AS ri FROM n),
m AS (SELECT *, max(dr) OVER (PARTITION BY scan_id, ring ORDER BY col ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 1 OR coalesce(max(ri) OVER (PARTITION BY scan_id, ring ORDER BY col ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 1, false) AS occ,
 coalesce(col BETWEEN 5 AND 249 AND abs(pv - r) * 100 > r * 2 AND abs(nx - r) * 100 > r * 2, false) AS par, col BETWEEN 5 AND 249 AND (r < 9000 OR r > 55000) AS gate FROM fl)"""


@query(f"WITH {S.GRID}, {_MARK} SELECT scan_id, ring, col, occ OR gate AS marked FROM m")
def occlusion_marks(spark, sf):
    return FE.occlusion_marks(A.grid(spark, sf), A.GRID_WIDTH, jump=8000, least=9000, most=55000, parallel=None).select("scan_id", "ring", "col", "marked")


@query(f"WITH {S.GRID}, {_MARK} SELECT scan_id, ring, col, par AS marked FROM m")
def parallel_beam(spark, sf):
    return FE.parallel_beam(A.grid(spark, sf), A.GRID_WIDTH).select("scan_id", "ring", "col", "marked")


_RANK = "ranked AS (SELECT scan_id, ring, col, (col - 5) // 42 AS sector, curvature, row_number() OVER (PARTITION BY scan_id, ring, (col - 5) // 42 ORDER BY curvature DESC, col) AS rank FROM curve WHERE col BETWEEN 5 AND 249)"


def _ranked(spark, sf) -> DataFrame:
    r = FE.sector_rank(_curved(spark, sf), A.GRID_WIDTH)
    return r.select("scan_id", "ring", "col", "sector", "curvature", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {S.GRID}, {_CURVE}, {_RANK} SELECT * FROM ranked")
def sector_rank(spark, sf):
    return _ranked(spark, sf)


@query(f"WITH {S.GRID}, {_CURVE}, {_RANK} SELECT scan_id, ring, sector, CAST(count(*) AS BIGINT) AS n, max(curvature) AS top, min(col) AS first_col FROM ranked WHERE rank <= 20 GROUP BY 1, 2, 3")
def feature_topk(spark, sf):
    return _ranked(spark, sf).filter("rank <= 20").groupBy("scan_id", "ring", "sector").agg(F.count("*").alias("n"), F.max("curvature").alias("top"), F.min("col").alias("first_col"))


def _features(spark, sf, variant: str) -> DataFrame:
    """Metres, as thresholds are in metres. Suppression is sequential, which SQL says as a recursion; tests also compare with a plain loop."""
    g = A.grid(spark, sf)
    m = g.select("scan_id", "ring", "col", *[(F.col(a) / 1000.0).alias(a) for a in "xyz"], (F.col("range") / 1000.0).alias("range"), F.col("intensity").cast("double").alias("intensity"))
    m = FE.occlusion_marks(FE.curvature(m, A.GRID_WIDTH), A.GRID_WIDTH, jump=25.0, least=2.0, most=60.0, parallel=None)
    return FE.extract_features(m, A.GRID_WIDTH, variant)


def _variant(name: str):
    def run(spark, sf):
        return _features(spark, sf, name)

    return run


for _name in FE.VARIANTS:
    QUERIES[f"features_{_name}"] = _variant(_name)
    ORACLE_SQL[f"features_{_name}"] = S.features(FE.VARIANTS[_name], 25.0, 2.0, 60.0)


# ---------------------------------------------------------------- neighbours


_NEAR = "(q.x - p.x)*(q.x - p.x) + (q.y - p.y)*(q.y - p.y) + (q.z - p.z)*(q.z - p.z)"


def _bucketed(side: int) -> str:
    """All points (q) beside all points (p) of their 27 cells of a grid."""
    cell = lambda a: S.fdiv(a, side)
    return f"""{S.PTS}, p AS (SELECT *, {', '.join(f'{cell(a)} AS cell_{a}' for a in 'xyz')} FROM pts),
q AS (SELECT scan_id, idx, x, y, z, {', '.join(f'cell_{a} + d{a}.d AS cell_{a}' for a in 'xyz')} FROM p, {', '.join(f'(VALUES (-1), (0), (1)) d{a}(d)' for a in 'xyz')})"""


def _pairs(r: int) -> str:
    return f"{_bucketed(r)}, pairs AS (SELECT q.scan_id AS q_scan_id, q.idx AS q_idx, p.scan_id AS p_scan_id, p.idx AS p_idx, p.x AS p_x, p.y AS p_y, p.z AS p_z, {_NEAR} AS d2 FROM q JOIN p USING (cell_x, cell_y, cell_z) WHERE {_NEAR} <= {r} * {r})"


_PAIR = _pairs(3000)
_KNN = "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_scan_id, q_idx ORDER BY d2, p_scan_id, p_idx) AS rank FROM pairs) WHERE rank <= 5)"


def _every(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = A.points(spark, sf).drop("intensity")
    return p, p


def _knn(spark, sf) -> DataFrame:
    return NB.knn_join(*_every(spark, sf), 5, 3000, ["scan_id", "idx"], keep=(["scan_id", "idx"], ["scan_id", "idx", "x", "y", "z"]))


@query(f"WITH {_PAIR}, {_KNN} SELECT q_scan_id, q_idx, p_scan_id, p_idx, d2, CAST(rank AS BIGINT) AS rank FROM knn")
def knn5_points(spark, sf):
    return _knn(spark, sf).select("q_scan_id", "q_idx", "p_scan_id", "p_idx", "d2", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_PAIR}, {_KNN}, ok AS (SELECT q_scan_id, q_idx FROM knn GROUP BY 1, 2 HAVING count(*) = 5 AND max(d2) < 2500*2500) SELECT q_scan_id, q_idx, p_scan_id, p_idx FROM knn JOIN ok USING (q_scan_id, q_idx)")
def knn_accepted(spark, sf):
    return NB.accepted(_knn(spark, sf), ["q_scan_id", "q_idx"], 5, 2500 * 2500).select("q_scan_id", "q_idx", "p_scan_id", "p_idx")


@query(f"WITH {_pairs(1500)} SELECT q_scan_id, q_idx, p_scan_id, p_idx, d2 FROM pairs")
def radius_join(spark, sf):
    return NB.radius_join(*_every(spark, sf), 1500, keep=(["scan_id", "idx"], ["scan_id", "idx"]))


@query(f"WITH {_bucketed(1000)} SELECT q.scan_id AS q_scan_id, q.idx AS q_idx, p.scan_id AS p_scan_id, p.idx AS p_idx FROM q JOIN p USING (cell_x, cell_y, cell_z) WHERE abs(q.x - p.x) <= 1000 AND abs(q.y - p.y) <= 1000 AND abs(q.z - p.z) <= 1000")
def box_join(spark, sf):
    return NB.box_join(*_every(spark, sf), 1000, keep=(["scan_id", "idx"], ["scan_id", "idx"])).drop("d2")


@query(f"WITH {_PAIR}, {_KNN} SELECT q_scan_id, q_idx, count(*) AS n, {', '.join(f'CAST(sum(p_{a}) AS BIGINT) AS s{a}' for a in 'xyz')}, {', '.join(f'CAST(sum(p_{a} * p_{b}) AS BIGINT) AS s{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} FROM knn GROUP BY 1, 2")
def plane_fit_moments(spark, sf):
    return NB.scatter(_knn(spark, sf), ["q_scan_id", "q_idx"])


_SUMS = f"m0 AS (SELECT q_scan_id, q_idx, {', '.join(f'CAST(CAST(sum(p_{a}) AS BIGINT) AS DOUBLE) AS s{a}' for a in 'xyz')}, {', '.join(f'CAST(CAST(sum(p_{a} * p_{b}) AS BIGINT) AS DOUBLE) AS {a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} FROM knn GROUP BY 1, 2 HAVING count(*) = 5)"
_PLANES = f"""{_PAIR}, {_KNN}, {_SUMS}, m1 AS (SELECT *, yy*zz - yz*yz AS cxx, xz*yz - xy*zz AS cxy, xy*yz - xz*yy AS cxz, xx*zz - xz*xz AS cyy, xy*xz - xx*yz AS cyz, xx*yy - xy*xy AS czz, xx + yy + zz AS tr FROM m0),
m2 AS (SELECT *, xx*cxx + xy*cxy + xz*cxz AS det FROM m1), m3 AS (SELECT *, CASE WHEN abs(det) > tr * tr * tr * CAST(1e-9 AS DOUBLE) THEN det END AS dt FROM m2),
m4 AS (SELECT q_scan_id, q_idx, -(cxx*sx + cxy*sy + cxz*sz) / dt AS nx, -(cxy*sx + cyy*sy + cyz*sz) / dt AS ny, -(cxz*sx + cyz*sy + czz*sz) / dt AS nz FROM m3),
m5 AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS l FROM m4), planes AS (SELECT q_scan_id, q_idx, nx / l AS a, ny / l AS b, nz / l AS c, 1 / l AS d FROM m5)"""
_ROUNDED = ", ".join(f"CAST(round({v} * {k}) AS BIGINT) AS {v}" for v, k in (("a", 1e6), ("b", 1e6), ("c", 1e6), ("d", 1e3)))


def _rounded(planes: DataFrame) -> DataFrame:
    """Normals in millionths, offsets in micrometres."""
    return planes.select("q_scan_id", "q_idx", *[F.round(F.col(v) * k).cast("bigint").alias(v) for v, k in (("a", 1e6), ("b", 1e6), ("c", 1e6), ("d", 1e3))])


@query(f"WITH {_PLANES} SELECT q_scan_id, q_idx, {_ROUNDED} FROM planes")
def plane_fit(spark, sf):
    return _rounded(NB.plane_fit(NB.scatter(_knn(spark, sf), ["q_scan_id", "q_idx"]).filter("n = 5")))


@query(f"WITH {_PLANES}, good AS (SELECT q_scan_id, q_idx FROM planes JOIN knn USING (q_scan_id, q_idx) WHERE a IS NOT NULL GROUP BY 1, 2 HAVING max(abs(a * p_x + b * p_y + c * p_z + d)) <= 200) SELECT q_scan_id, q_idx, {_ROUNDED} FROM planes JOIN good USING (q_scan_id, q_idx)")
def plane_accepted(spark, sf):
    """fitted planes that all five neighbours lie within 200 mm of."""
    fits = NB.plane_fit(NB.scatter(_knn(spark, sf), ["q_scan_id", "q_idx"], points="ps").filter("n = 5"))
    # A generator, so that the lambda reads the plane and does not fit it anew for each point.
    fits = fits.select("q_scan_id", "q_idx", "ps", F.explode(F.array(F.struct("a", "b", "c", "d"))).alias("f")).select("q_scan_id", "q_idx", "ps", "f.*").filter("a is not null")
    off = F.transform("ps", lambda p: F.col("a") * p[0] + F.col("b") * p[1] + F.col("c") * p[2] + F.col("d"))
    return _rounded(fits.filter(FI.plane_holds(off, 200.0)))


@query()
def line_and_normal(spark, sf):
    return NB.principal_axes(NB.scatter(_knn(spark, sf), ["q_scan_id", "q_idx"]).filter("n = 5"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i]))) AS BIGINT) AS d2 FROM q, e)
SELECT query_id, vec_id, d2, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM d) WHERE rank <= 5""")
def knn5_embeddings(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return NB.vector_knn(e, e.filter("vec_id % 20 = 0"), 5, 64, 10000)


# ---------------------------------------------------------------- time and poses


@query(f"WITH {S.IMU}, {S.SCANS} SELECT i.event_id, i.sensor_id, i.w, (SELECT arg_min(s.scan_key, s.ts) FROM scans s WHERE s.sensor_id = i.sensor_id AND s.ts >= i.ts) AS scan_key FROM imu i")
def imu_assign(spark, sf):
    return TS.assign_to_next(A.imu(spark, sf), A.scans(spark, sf), by=("sensor_id",)).select("event_id", "sensor_id", "w", "scan_key")


@query(f"WITH {S.IMU}, {S.SCANS}, a AS (SELECT i.sensor_id, i.w, (SELECT arg_min(s.scan_key, s.ts) FROM scans s WHERE s.sensor_id = i.sensor_id AND s.ts >= i.ts) AS scan_key FROM imu i) SELECT sensor_id, scan_key, count(*) AS samples, CAST(sum(w) AS BIGINT) AS w_sum FROM a WHERE scan_key IS NOT NULL GROUP BY 1, 2")
def imu_per_scan(spark, sf):
    a = TS.assign_to_next(A.imu(spark, sf), A.scans(spark, sf), by=("sensor_id",)).filter("scan_key is not null")
    return a.groupBy("sensor_id", "scan_key").agg(F.count("*").alias("samples"), F.sum("w").alias("w_sum"))


@query(f"WITH {S.IMU}, {S.SCANS} SELECT s.scan_key, s.sensor_id, (SELECT arg_min(i.event_id, i.ts) FROM imu i WHERE i.sensor_id = s.sensor_id AND i.ts > s.ts) AS event_id FROM scans s")
def imu_following(spark, sf):
    return TS.following_sample(A.scans(spark, sf), A.imu(spark, sf), by=("sensor_id",), sample_cols=("event_id",)).select("scan_key", "sensor_id", "event_id")


@query(f"WITH {S.IMU}, {S.SCANS}, n AS (SELECT *, lead(event_id) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS after FROM imu) SELECT s.scan_key, s.sensor_id, (SELECT arg_min(struct_pack(a := i.after), i.ts).a FROM n i WHERE i.sensor_id = s.sensor_id AND i.ts > s.ts) AS event_id FROM scans s")
def imu_following_as_coded(spark, sf):
    return TS.following_sample(A.scans(spark, sf), A.imu(spark, sf), by=("sensor_id",), skip=1, sample_cols=("event_id",)).select("scan_key", "sensor_id", "event_id")


@query(f"WITH {S.IMU} SELECT event_id, sensor_id, CASE WHEN row_number() OVER w <= 10 THEN CAST(w AS DOUBLE) ELSE CAST(sum(w) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS DOUBLE) / 10 END AS smooth FROM imu WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, event_id)")
def imu_smooth(spark, sf):
    return TS.sliding_mean(A.imu(spark, sf), "w", 10, ("sensor_id",), ("ts", "event_id")).select("event_id", "sensor_id", "smooth")


@query(f"WITH {S.TIMINGS} SELECT task, seq, CAST(sum(micros) OVER w AS DOUBLE) / count(*) OVER w AS mean FROM timings WINDOW w AS (PARTITION BY task ORDER BY seq)")
def stage_running_mean(spark, sf):
    return TS.running_mean(A.timings(spark, sf), "micros", ("task",), ("seq",)).select("task", "seq", "mean")


@query(f"WITH {S.POSES} SELECT session, seq, {', '.join(f't{a} - coalesce(lag(t{a}) OVER w, t{a}) AS d{a}' for a in 'xyz')} FROM poses WINDOW w AS (PARTITION BY session ORDER BY seq)")
def pose_delta(spark, sf):
    return TS.pose_deltas(A.poses(spark, sf)).select("session", "seq", "dx", "dy", "dz")


@query(f"""WITH RECURSIVE {S.POSES}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM poses),
f AS (SELECT session, rn, seq, tx, ty, tz, true AS kept, tx AS kx, ty AS ky, tz AS kz FROM o WHERE rn = 1
 UNION ALL SELECT o.session, o.rn, o.seq, o.tx, o.ty, o.tz, far, CASE WHEN far THEN o.tx ELSE kx END, CASE WHEN far THEN o.ty ELSE ky END, CASE WHEN far THEN o.tz ELSE kz END
 FROM (SELECT n.*, f.kx, f.ky, f.kz, (n.tx-f.kx)*(n.tx-f.kx)+(n.ty-f.ky)*(n.ty-f.ky)+(n.tz-f.kz)*(n.tz-f.kz) >= CAST(60000 AS BIGINT)*60000 AS far FROM f JOIN o n ON n.session = f.session AND n.rn = f.rn + 1) o)
SELECT session, seq, tx, ty, tz FROM f WHERE kept""")
def distance_gate(spark, sf):
    return FI.distance_gate(A.poses(spark, sf), 60000.0).select("session", "seq", "tx", "ty", "tz")


@query(f"WITH {S.POSES}, o AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn FROM poses) SELECT a.session, a.seq, b.seq AS source FROM o a JOIN o b ON a.session = b.session AND b.rn BETWEEN a.rn - 3 AND a.rn - 1")
def last_n_scans(spark, sf):
    return TS.last_scans(A.poses(spark, sf), 3)


@query(f"WITH {S.POSES} SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS pose_id, {', '.join(f'CAST(trunc(CAST(t{a} AS DOUBLE) / 1000.0 * 1000 + CASE WHEN CAST(t{a} AS DOUBLE) / 1000.0 * 1000 < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) / 1000 AS t{a}' for a in 'xyz')} FROM poses")
def pose_store(spark, sf):
    p = A.poses(spark, sf).withColumns({f"q{a}": F.lit(float(a == "w")) for a in "xyzw"})
    return MS.store_poses(p, 1000.0, "session").select("session", "pose_id", "tx", "ty", "tz")


@query(f"WITH {S.POSES}, c AS (SELECT session, {S.fdiv('tx', 64000)} AS cx, {S.fdiv('ty', 640)} AS cy, max(seq) AS last FROM poses GROUP BY 1, 2, 3) SELECT session, cx, cy, last, row_number() OVER (PARTITION BY session ORDER BY last DESC, cx, cy) - 1 AS age FROM c")
def lru_rank(spark, sf):
    c = A.poses(spark, sf).select("session", G.fdiv("tx", 64000).alias("cx"), G.fdiv("ty", 640).alias("cy"), "seq")
    return FI.lru_rank(c, "session", ["cx", "cy"], "seq").select("session", "cx", "cy", "last", F.col("age").cast("bigint").alias("age"))


@query(f"WITH {S.POSES}, l AS (SELECT session, seq, tx FROM poses WHERE seq % 3 <> 0), r AS (SELECT session, seq, ty FROM poses WHERE seq % 2 = 0) SELECT session, seq, tx, ty FROM l JOIN r USING (session, seq)")
def queue_pairs(spark, sf):
    p = A.poses(spark, sf)
    return TS.pair_queues(p.filter("seq % 3 <> 0").select("session", "seq", "tx"), p.filter("seq % 2 = 0").select("session", "seq", "ty"), ["session", "seq"])


_MICRO = lambda e: f"CAST(round(({e}) * 1e6) AS BIGINT)"
_FOLD = "[" + ", ".join(" + ".join(f"m[{3 * i + j + 1}] * acc[{3 * j + k + 1}]" for j in range(3)) for i in range(3) for k in range(3)) + "]"
_NINE = [f"r{i}{k}" for i in range(3) for k in range(3)]


def _entries(df: DataFrame, array: str, names: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(array)[i] * 1e6).cast("bigint").alias(n) for i, n in enumerate(names)])


@query(f"""WITH {S.IMU}, {S.SCANS}, a AS (SELECT i.sensor_id, i.ts, i.w, (SELECT arg_min(s.scan_key, s.ts) FROM scans s WHERE s.sensor_id = i.sensor_id AND s.ts >= i.ts) AS scan_key FROM imu i),
t AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY sensor_id ORDER BY ts, scan_key) AS before FROM a WHERE scan_key IS NOT NULL),
g AS (SELECT *, w / 1e9 * coalesce(abs(us - before) / 1e6, 0) AS gx, w / 2e9 * coalesce(abs(us - before) / 1e6, 0) AS gz FROM t),
m AS (SELECT sensor_id, scan_key, us, [cos(gz), -sin(gz), 0, cos(gx) * sin(gz), cos(gx) * cos(gz), -sin(gx), sin(gx) * sin(gz), sin(gx) * cos(gz), cos(gx)] AS m FROM g),
f AS (SELECT sensor_id, scan_key, list_reduce(list(m ORDER BY us), lambda acc, m: {_FOLD}) AS r FROM m GROUP BY 1, 2) SELECT sensor_id, scan_key, {', '.join(f'{_MICRO(f"r[{i + 1}]")} AS {n}' for i, n in enumerate(_NINE))} FROM f""")
def imu_rotation(spark, sf):
    """The matrix product of each scan's samples."""
    a = TS.assign_to_next(A.imu(spark, sf), A.scans(spark, sf), by=("sensor_id",))
    a = a.select("sensor_id", "scan_key", F.col("ts").alias("stamp"), (F.col("w") / 1e9).alias("wx"), F.lit(0.0).alias("wy"), (F.col("w") / 2e9).alias("wz"))
    return _entries(TS.integrate_rotation(a), "rotation", _NINE, "sensor_id", "scan_key")


@query(f"""WITH {S.POSES}, d AS (SELECT session, seq, {', '.join(f't{a} - coalesce(lag(t{a}) OVER w, t{a}) AS d{a}' for a in 'xyz')} FROM poses WINDOW w AS (PARTITION BY session ORDER BY seq)),
c AS (SELECT session, seq, {', '.join(f'CAST(sum(d{a}) OVER w AS DOUBLE) AS t{a}' for a in 'xyz')}, sum(dy) OVER w / 2000.0 AS h FROM d WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, tx, ty, tz, {_MICRO("CASE WHEN abs(cos(h)) >= abs(sin(h)) THEN abs(cos(h)) ELSE cos(h) * sign(sin(h)) END")} AS qw, {_MICRO("CASE WHEN abs(cos(h)) >= abs(sin(h)) THEN sin(h) * sign(cos(h)) ELSE abs(sin(h)) END")} AS qz FROM c""")
def pose_accumulate(spark, sf):
    """Every step turns about z by its dy in milliradians."""
    steps = TS.pose_deltas(A.poses(spark, sf)).select("session", "seq", L.euler_rotation(F.lit(0.0), F.lit(0.0), F.col("dy") / 1000.0).alias("rotation"), F.col("dx").alias("tx"), F.col("dy").alias("ty"), F.col("dz").alias("tz"))
    return TS.accumulate_poses(steps).select("session", "seq", "tx", "ty", "tz", *[F.round(F.col(q) * 1e6).cast("bigint").alias(q) for q in ("qw", "qz")])


@query(f"""WITH {S.POSES}, l AS (SELECT *, ty / 1000.0 AS a, coalesce(lag(ty / 1000.0) OVER w, ty / 1000.0) AS b, {', '.join(f't{x} - coalesce(lag(t{x}) OVER w, t{x}) AS d{x}' for x in 'xyz')} FROM poses WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, {_MICRO('cos(2 * a - b)')} AS r00, {_MICRO('sin(2 * a - b)')} AS r10, {', '.join(f"CAST(round(({e}) * 1e3) AS BIGINT) AS n{x}" for x, e in (('x', 'cos(a - b) * dx - sin(a - b) * dy + tx'), ('y', 'sin(a - b) * dx + cos(a - b) * dy + ty'), ('z', 'dz + tz')))} FROM l""")
def pose_predict(spark, sf):
    """E25 over all poses of the table, turned about z by their ty in milliradians; places in thousandths."""
    turn = L.euler_rotation(F.lit(0.0), F.lit(0.0), F.col("ty") / 1000.0)
    p = TS.predict_constant_velocity(A.poses(spark, sf).select("session", "seq", turn.alias("rotation"), "tx", "ty", "tz"))
    return p.select("session", "seq", *[F.round(F.col("next_pose")[i] * s).cast("bigint").alias(n) for i, s, n in ((0, 1e6, "r00"), (4, 1e6, "r10"), (3, 1e3, "nx"), (7, 1e3, "ny"), (11, 1e3, "nz"))])


# ---------------------------------------------------------------- metrics


@query(f"WITH {S.TIMINGS}, f AS (SELECT task, min(seq) AS s1 FROM timings GROUP BY task) SELECT task, count(*) AS n, arg_max(micros, seq) AS last, CAST(sum(micros) AS BIGINT) AS total, min(micros) AS least, coalesce(max(CASE WHEN seq <> s1 THEN micros END), 0) AS most, CAST(sum(micros) AS BIGINT) // count(*) AS average FROM timings JOIN f USING (task) GROUP BY task")
def runtime_stats(spark, sf):
    return ME.runtime_stats(A.timings(spark, sf))


@query(f"WITH {S.TIMINGS} SELECT task, least(micros // 10000, 9) AS bucket, count(*) AS n FROM timings GROUP BY 1, 2")
def runtime_histogram(spark, sf):
    return ME.runtime_histogram(A.timings(spark, sf))


@query(f"WITH {S.TIMINGS} SELECT task AS series, {', '.join(f'max(CASE WHEN run = {k} THEN micros END) AS run{k}' for k in range(4))} FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) - 1 AS run FROM timings) GROUP BY task")
def measurement_sheet(spark, sf):
    t = ME.timed(A.timings(spark, sf).withColumnRenamed("seq", "event"), "task", "event").filter("seq < 4")
    sheet = ME.measurement_sheet(t.select(F.col("task").alias("series"), "seq", "micros"), "series", "seq", "micros", 4)
    return sheet.select("series", *[F.col(str(k)).alias(f"run{k}") for k in range(4)])


@query("SELECT 600 AS tau, 312 AS map_size_x, 312 AS map_size_y, 78 AS map_size_z, 64 AS map_resolution, 640 AS max_weight, 'run-int_ref_res-64_upd_d-0dot50_max_d-0dot60_max_w-640_map-312x312x78' AS id")
def map_metadata(spark, sf):
    from stratavox.params import Map

    m = Map()
    meta = m.metadata()
    return spark.createDataFrame([(meta["tau"], meta["map_size_x"], meta["map_size_y"], meta["map_size_z"], meta["map_resolution"], meta["max_weight"], m.identifier)], "tau int, map_size_x int, map_size_y int, map_size_z int, map_resolution int, max_weight int, id string")
