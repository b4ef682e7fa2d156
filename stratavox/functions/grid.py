"""Fixed-point and voxel arithmetic as column expressions; all integers are computed in BIGINT.

Constants equal to the reference's (fixed values): weights are scaled by 64, fixed-point matrices by 32768, chunks are 64 cells wide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_RESOLUTION = 64
MATRIX_RESOLUTION = 32768
CHUNK = 64


def lng(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)).cast("bigint")


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", lng(a), lng(b))


def fdiv(a, b) -> Column:
    """Integer division that floors."""
    return idiv(lng(a) - F.pmod(lng(a), lng(b)), b)


def to_mm(metres) -> Column:
    """Metres to millimetres, truncating."""
    return (F.col(metres) if isinstance(metres, str) else metres).cast("double").__mul__(1000).cast("bigint")


def cell_trunc(p, res) -> Column:
    """The cell of ray marching and registration; cell 0 is twice as wide."""
    return idiv(p, res)


def cell_floor(p, res) -> Column:
    """The cell of poses and maps."""
    return fdiv(p, res)


def voxel_centre(p, res) -> Column:
    """E2."""
    return fdiv(p, res) * lng(res) + idiv(res, 2)


def chunk_of(i) -> Column:
    """E5."""
    return fdiv(i, CHUNK)


def in_chunk_index(x, y, z) -> Column:
    """X-major place of a cell inside its chunk."""
    return F.pmod(lng(x), F.lit(CHUNK)) * (CHUNK * CHUNK) + F.pmod(lng(y), F.lit(CHUNK)) * CHUNK + F.pmod(lng(z), F.lit(CHUNK))


def chunk_tag(cx, cy, cz) -> Column:
    return F.concat_ws("_", *[lng(v).cast("string") for v in (cx, cy, cz)])


def odd(size) -> Column:
    """Local map sides are odd: even ones grow by one."""
    return lng(size) + F.when(F.pmod(lng(size), F.lit(2)) == 0, 1).otherwise(0)


def ring_index(p, pos, offset, size) -> Column:
    """Slot of a cell on one axis of the ring buffer."""
    return F.pmod(lng(p) - lng(pos) + lng(offset), lng(size))


def in_bounds(p, pos, size, buffer: int = 0) -> Column:
    """|p - pos| <= size div 2 on one axis, tightened by `buffer` cells."""
    return F.abs(lng(p) - lng(pos)) <= idiv(size, 2) - buffer


def voxel_hash(x, y, z) -> Column:
    """The reference's cell hash, for parity; Spark hashes structs itself."""
    return F.shiftleft(lng(x), 32).bitwiseXOR(F.shiftleft(lng(y), 16)).bitwiseXOR(lng(z))


def fixed_matrix(m: list[list[float]]) -> list[list[int]]:
    """A 4x4 matrix with its rotation and translation scaled and truncated."""
    return [[int(v * MATRIX_RESOLUTION) for v in row] for row in m]


def fixed_transform(x, y, z, m: list[list[int]]) -> list[Column]:
    """Rigid transform by a fixed-point matrix, truncating."""
    p = [lng(x), lng(y), lng(z)]
    return [idiv(sum((p[k] * lng(r[k]) for k in range(1, 3)), p[0] * lng(r[0])) + lng(r[3]), MATRIX_RESOLUTION) for r in m[:3]]


def round_half_away(v: Column) -> Column:
    """E10's rounding: half away from zero."""
    return (v + F.when(v < 0, -0.5).otherwise(0.5)).cast("bigint")


def float_transform(x, y, z, m: list[list[float]]) -> list[Column]:
    """Rigid transform in doubles, rounded half away from zero."""
    p = [F.col(v).cast("double") if isinstance(v, str) else v.cast("double") for v in (x, y, z)]
    return [round_half_away(p[0] * float(r[0]) + p[1] * float(r[1]) + p[2] * float(r[2]) + float(r[3])) for r in m[:3]]


def norm_trunc(*parts) -> Column:
    """Integer length of a vector, truncated."""
    total = lng(parts[0]) * lng(parts[0])
    for p in parts[1:]:
        total = total + lng(p) * lng(p)
    return F.floor(F.sqrt(total.cast("double"))).cast("bigint")


def tsdf_weight(value, tau: int) -> Column:
    """Full weight in front of the surface, a ramp to zero behind it."""
    eps = tau // 10
    return F.when(lng(value) < -eps, idiv(WEIGHT_RESOLUTION * (tau + lng(value)), tau - eps)).otherwise(F.lit(WEIGHT_RESOLUTION).cast("bigint"))


def merge_value(v, w, nv, nw) -> Column:
    """The weighted mean of an entry and a new one, truncating."""
    return idiv(lng(v) * lng(w) + lng(nv) * lng(nw), lng(w) + lng(nw))


def pack(value, weight) -> Column:
    """Value in the low and weight in the high 16 bits of an unsigned 32-bit number."""
    return lng(value).bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(lng(weight).bitwiseAND(F.lit(0xFFFF)), 16)


def unpack_value(raw) -> Column:
    low = lng(raw).bitwiseAND(F.lit(0xFFFF))
    return F.when(low >= 32768, low - 65536).otherwise(low)


def unpack_weight(raw) -> Column:
    high = F.shiftright(lng(raw), 16).bitwiseAND(F.lit(0xFFFF))
    return F.when(high >= 32768, high - 65536).otherwise(high)


def surface_colour(value, tau: int) -> tuple[Column, Column]:
    """Red grows in front of the surface, green behind it, in 0..1 over the truncation distance."""
    v = lng(value).cast("double") / float(tau)
    return F.when(v >= 0, v).otherwise(0.0), F.when(v < 0, -v).otherwise(0.0)


def elevation_ring(x, y, z, half: bool = False) -> Column:
    """Scan ring from the vertical angle: (angle + 22.5) / 2 with rounding by +0.5 and truncation, or half away from zero."""
    angle = F.degrees(F.atan(F.col(z) / F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))))
    v = (angle + 22.5) / 2
    return round_half_away(v) if half else (v + 0.5).cast("bigint")
