"""Vectors, matrices, quaternions and twists: array columns for what runs per row, NumPy for what runs once per solver step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- vectors as arrays


def vec(*parts) -> Column:
    return F.array(*[F.col(p) if isinstance(p, str) else p for p in parts])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mult(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def prod(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def dot(a: Column, b: Column) -> Column:
    return total(mult(a, b))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def l1norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: F.abs(x)))


def l2norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = l2norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def skew(v: Column) -> Column:
    """Row-major 3x3 matrix of the cross product with v."""
    o = F.lit(0.0)
    return F.array(o, -v[2], v[1], v[2], o, -v[0], -v[1], v[0], o)


# ---------------------------------------------------------------- row-major square matrices


def identity(n: int) -> Column:
    return F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)])


def transpose(m: Column, n: int) -> Column:
    return F.array(*[m[j * n + i] for i in range(n) for j in range(n)])


def trace(m: Column, n: int) -> Column:
    return sum((m[i * n + i] for i in range(1, n)), m[0])


def matmul(a: Column, b: Column, n: int) -> Column:
    return F.array(*[sum((a[i * n + k] * b[k * n + j] for k in range(1, n)), a[i * n] * b[j]) for i in range(n) for j in range(n)])


def matvec(m: Column, v: Column, n: int) -> Column:
    return F.array(*[sum((m[i * n + k] * v[k] for k in range(1, n)), m[i * n] * v[0]) for i in range(n)])


def det3(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse3(m: Column) -> Column:
    """Null where the determinant is zero."""
    d = det3(m)
    minor = lambda r, c: [m[i * 3 + j] for i in range(3) if i != r for j in range(3) if j != c]
    cells = []
    for i in range(3):
        for j in range(3):
            a, b, c, e = minor(j, i)
            cells.append((a * e - b * c) * float((-1) ** (i + j)) / F.nullif(d, F.lit(0.0)))
    return F.array(*cells)


def inverse_rigid4(m: Column) -> Column:
    """Inverse of a rotation and translation: transposed rotation, rotated negative translation."""
    r = lambda i, j: m[j * 4 + i]
    rows = []
    for i in range(3):
        rows += [r(i, 0), r(i, 1), r(i, 2), -(r(i, 0) * m[3] + r(i, 1) * m[7] + r(i, 2) * m[11])]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def _minor(m: Column, n: int, rows: list[int], cols: list[int]) -> Column:
    if len(rows) == 1:
        return m[rows[0] * n + cols[0]]
    terms = [m[rows[0] * n + c] * _minor(m, n, rows[1:], [x for x in cols if x != c]) * float((-1) ** k) for k, c in enumerate(cols)]
    return sum(terms[1:], terms[0])


def det4(m: Column) -> Column:
    """E33."""
    return _minor(m, 4, [0, 1, 2, 3], [0, 1, 2, 3])


def inverse4(m: Column) -> Column:
    """Any 4x4 matrix by its adjugate; entries are null where the determinant is zero."""
    d = F.nullif(det4(m), F.lit(0.0))
    rest = lambda x: [i for i in range(4) if i != x]
    return F.array(*[_minor(m, 4, rest(j), rest(i)) * float((-1) ** (i + j)) / d for i in range(4) for j in range(4)])


def outer(a: Column, n: int) -> Column:
    """A6."""
    return F.array(*[a[i] * a[j] for i in range(n) for j in range(n)])


# ---------------------------------------------------------------- rotations


def quat_rotate(q: list[Column], p: list[Column]) -> list[Column]:
    """Rotates p by the quaternion (x, y, z, w)."""
    qx, qy, qz, qw = q
    tx, ty, tz = 2 * (qy * p[2] - qz * p[1]), 2 * (qz * p[0] - qx * p[2]), 2 * (qx * p[1] - qy * p[0])
    return [p[0] + qw * tx + qy * tz - qz * ty, p[1] + qw * ty + qz * tx - qx * tz, p[2] + qw * tz + qx * ty - qy * tx]


def quat_mul(a: list[Column], b: list[Column]) -> list[Column]:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def euler_rotation(ax: Column, ay: Column, az: Column) -> Column:
    """Rx * Ry * Rz as a row-major array."""
    cx, sx, cy, sy, cz, sz = F.cos(ax), F.sin(ax), F.cos(ay), F.sin(ay), F.cos(az), F.sin(az)
    return F.array(cy * cz, -cy * sz, sy, cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy, sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy)


#: Coefficients of the published arc tangent approximation (fixed values).
ATAN_LINEAR, ATAN_SQUARE = 0.2447, 0.0663


def fast_atan(x: Column) -> Column:
    """Arc tangent on -1..1, within 0.0015 rad."""
    return x * (np.pi / 4) - x * (F.abs(x) - 1) * (F.abs(x) * ATAN_SQUARE + ATAN_LINEAR)


def fast_atan2(y: Column, x: Column) -> Column:
    """The angle of (x, y) in -pi..pi; 0 at the origin. The smaller part over the larger one goes into fast_atan()."""
    upper = F.when(y >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    flat = fast_atan(y / F.nullif(x, F.lit(0.0))) + F.when(x < 0, upper * np.pi).otherwise(F.lit(0.0))
    steep = upper * (np.pi / 2) - fast_atan(x / F.nullif(y, F.lit(0.0)))
    return F.when(F.abs(y) < F.abs(x), flat).otherwise(F.coalesce(steep, F.lit(0.0)))


def _parts(p: list[Column], q: list[Column]) -> list[Column]:
    return [a - b for a, b in zip(p, q, strict=True)]


def _crossed(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _length(w: list[Column]) -> Column:
    return F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])


def point_to_line(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """|(p - a) x (p - b)| / |a - b|."""
    return _length(_crossed(_parts(p, a), _parts(p, b))) / _length(_parts(a, b))


def _by_twist(p: list[Column], grad: list[Column]) -> Column:
    """Derivative by a twist (rotation, translation) on the left of what has the gradient `grad` by the point p."""
    return F.array(*_crossed(p, grad), *grad)


def point_to_line_jacobian(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Derivative of point_to_line() by a twist that moves p; null on the line."""
    n, e = _crossed(_parts(p, a), _parts(p, b)), _parts(a, b)
    size = F.nullif(_length(n), F.lit(0.0)) * _length(e)
    return _by_twist(p, [-c / size for c in _crossed(n, e)])


def point_to_plane(p: list[Column], normal: list[Column], d: Column) -> Column:
    """Signed distance to a plane with unit normal."""
    return normal[0] * p[0] + normal[1] * p[1] + normal[2] * p[2] + d


def point_to_plane_jacobian(p: list[Column], normal: list[Column]) -> Column:
    """Derivative of point_to_plane() by a twist that moves p."""
    return _by_twist(p, normal)


# ---------------------------------------------------------------- twists as columns


def _affine(rot: list[Column], t: list[Column]) -> Column:
    """Row-major 4x4 array of a rotation (9) and a translation (3)."""
    o, one = F.lit(0.0), F.lit(1.0)
    return F.array(*rot[0:3], t[0], *rot[3:6], t[1], *rot[6:9], t[2], o, o, o, one)


def _skew_series(w: list[Column], a: Column, b: Column) -> list[Column]:
    """I + a K + b K K, where K is the cross product with w, row-major."""
    ww = [[w[i] * w[k] for k in range(3)] for i in range(3)]
    t2 = ww[0][0] + ww[1][1] + ww[2][2]
    k = {(0, 1): -w[2], (0, 2): w[1], (1, 0): w[2], (1, 2): -w[0], (2, 0): -w[1], (2, 1): w[0]}
    return [(1 + b * (ww[i][i] - t2)) if i == j else a * k[i, j] + b * ww[i][j] for i in range(3) for j in range(3)]


def _turned(centre: list[Column], move: list[Column], rot: list[Column]) -> list[Column]:
    return [centre[i] + move[i] - sum((rot[3 * i + k] * centre[k] for k in range(1, 3)), rot[3 * i] * centre[0]) for i in range(3)]


def _turn_terms(theta: Column) -> tuple[Column, Column]:
    safe = F.nullif(theta, F.lit(0.0))
    return F.coalesce(F.sin(theta) / safe, F.lit(1.0)), F.coalesce((1 - F.cos(theta)) / (safe * safe), F.lit(0.5))


def _exp_terms(t2: Column, theta: Column, small: float) -> tuple[Column, Column, Column]:
    near = theta.isNull() | (theta < small)
    a = F.when(near, 1 - t2 / 6).otherwise(F.sin(theta) / theta)
    b = F.when(near, 0.5 - t2 / 24).otherwise((1 - F.cos(theta)) / (theta * theta))
    c = F.when(near, 1 / 6 - t2 / 120).otherwise((theta - F.sin(theta)) / (theta * theta * theta))
    return a, b, c


def _moved_by(left: list[Column], v: list[Column]) -> list[Column]:
    return [left[3 * i] * v[0] + left[3 * i + 1] * v[1] + left[3 * i + 2] * v[2] for i in range(3)]


def twist_to_transform(xi: list[Column], centre: list[Column]) -> Column:
    """E19 as a 4x4 array: rotation by xi[:3] about the centre, then translation by xi[3:]. A zero rotation is the identity."""
    rot = _skew_series(xi[:3], *_turn_terms(F.sqrt(xi[0] * xi[0] + xi[1] * xi[1] + xi[2] * xi[2])))
    return _affine(rot, _turned(centre, xi[3:], rot))


def se3_exp(xi: list[Column], small: float = 1e-6) -> Column:
    """E20 as a 4x4 array: exponential of a twist (rotation first), by series below `small`."""
    t2 = xi[0] * xi[0] + xi[1] * xi[1] + xi[2] * xi[2]
    a, b, c = _exp_terms(t2, F.nullif(F.sqrt(t2), F.lit(0.0)), small)
    return _affine(_skew_series(xi[:3], a, b), _moved_by(_skew_series(xi[:3], b, c), xi[3:]))


# Catalyst takes entries out of an array before it is made, so each would repeat the whole series, in a method too large for Java to
# compile. Columns by steps, each a projection of its own, are computed once.

ROT = [f"_r{i}{k}" for i in range(3) for k in range(3)]


def _steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    for s in steps:
        df = df.select("*", *[c.alias(n) for n, c in s.items()])
    return df


def twist_columns(df: DataFrame, xi: list[str], centre: list[Column]) -> tuple[DataFrame, list[Column]]:
    """twist_to_transform() of columns: df with what is computed once, and the first three rows of the transform."""
    w, move = [F.col(n) for n in xi[:3]], [F.col(n) for n in xi[3:]]
    df = _steps(df, {"_th": F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])}, dict(zip(("_a", "_b"), _turn_terms(F.col("_th")), strict=True)))
    df = _steps(df, dict(zip(ROT, _skew_series(w, F.col("_a"), F.col("_b")), strict=True)))
    rot = [F.col(r) for r in ROT]
    t = _turned(centre, move, rot)
    return df, [*rot[0:3], t[0], *rot[3:6], t[1], *rot[6:9], t[2]]


def se3_columns(df: DataFrame, xi: list[str], small: float = 1e-6) -> tuple[DataFrame, list[Column]]:
    """se3_exp() of columns: df with what is computed once, and the first three rows of the transform."""
    w, v = [F.col(n) for n in xi[:3]], [F.col(n) for n in xi[3:]]
    df = _steps(df, {"_t2": w[0] * w[0] + w[1] * w[1] + w[2] * w[2]}, {"_th": F.nullif(F.sqrt("_t2"), F.lit(0.0))})
    df = _steps(df, dict(zip(("_a", "_b", "_c"), _exp_terms(F.col("_t2"), F.col("_th"), small), strict=True)))
    rot, t = _skew_series(w, F.col("_a"), F.col("_b")), _moved_by(_skew_series(w, F.col("_b"), F.col("_c")), v)
    return df, [*rot[0:3], t[0], *rot[3:6], t[1], *rot[6:9], t[2]]


def manifold_plus(pose: Column, xi: list[Column]) -> Column:
    """E24 as a 4x4 array: a pose moved by a twist on its left."""
    return matmul(se3_exp(xi), pose, 4)


def inverse4_columns(df: DataFrame, m: list[str]) -> tuple[DataFrame, Column, list[Column]]:
    """det4() and inverse4() of 16 columns: df with the 2x2 minors of the upper and lower rows, the determinant and the inverse's entries."""
    at = lambda r, c: F.col(m[4 * r + c])
    two = [(p, q) for p in range(4) for q in range(p + 1, 4)]
    df = _steps(df, {f"_{h}{p}{q}": at(r, p) * at(r + 1, q) - at(r, q) * at(r + 1, p) for h, r in (("u", 0), ("l", 2)) for p, q in two})
    rest = lambda *gone: [i for i in range(4) if i not in gone]
    terms = [F.col(f"_u{p}{q}") * F.col("_l{}{}".format(*rest(p, q))) * float((-1) ** (p + q + 1)) for p, q in two]
    df = _steps(df, {"_det": sum(terms[1:], terms[0])})
    d = F.nullif(F.col("_det"), F.lit(0.0))

    def entry(i: int, j: int) -> Column:
        half, row, (p, q, t) = ("l", 1 - j, rest(i)) if j < 2 else ("u", 5 - j, rest(i))
        return (at(row, p) * F.col(f"_{half}{q}{t}") - at(row, q) * F.col(f"_{half}{p}{t}") + at(row, t) * F.col(f"_{half}{p}{q}")) * float((-1) ** (i + j)) / d

    return df, F.col("_det"), [entry(i, j) for i in range(4) for j in range(4)]


# ---------------------------------------------------------------- NumPy forms for solver steps


def np_skew(v) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0.0]])


def np_twist_to_transform(xi: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Rotation by the first three components about the centre, then translation by the rest. A zero rotation is the identity."""
    theta = float(np.linalg.norm(xi[:3]))
    rot = np.eye(3)
    if theta > 0:
        k = np_skew(xi[:3] / theta)
        rot = rot + np.sin(theta) * k + (1 - np.cos(theta)) * k @ k
    out = np.eye(4)
    out[:3, :3] = rot
    out[:3, 3] = rot @ -centre + centre + xi[3:]
    return out


def np_se3_exp(xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of a twist (rotation first), with series near zero."""
    w, v = xi[:3], xi[3:]
    t2 = float(w @ w)
    theta, k = np.sqrt(t2), np_skew(w)
    if theta < 1e-6:
        a, b, c = 1 - t2 / 6, 0.5 - t2 / 24, 1 / 6 - t2 / 120
    else:
        a, b, c = np.sin(theta) / theta, (1 - np.cos(theta)) / t2, (theta - np.sin(theta)) / (t2 * theta)
    rot = np.eye(3) + a * k + b * k @ k
    return rot, (np.eye(3) + b * k + c * k @ k) @ v


def np_quat_of(rot: np.ndarray) -> np.ndarray:
    """Unit quaternion (x, y, z, w) of a rotation matrix."""
    d = np.array([1 + rot[0, 0] - rot[1, 1] - rot[2, 2], 1 - rot[0, 0] + rot[1, 1] - rot[2, 2], 1 - rot[0, 0] - rot[1, 1] + rot[2, 2], 1 + np.trace(rot)])
    i = int(np.argmax(d))
    s = np.sqrt(max(d[i], 1e-300)) * 2
    if i == 3:
        q = [(rot[2, 1] - rot[1, 2]) / s, (rot[0, 2] - rot[2, 0]) / s, (rot[1, 0] - rot[0, 1]) / s, s / 4]
    elif i == 0:
        q = [s / 4, (rot[0, 1] + rot[1, 0]) / s, (rot[0, 2] + rot[2, 0]) / s, (rot[2, 1] - rot[1, 2]) / s]
    elif i == 1:
        q = [(rot[0, 1] + rot[1, 0]) / s, s / 4, (rot[1, 2] + rot[2, 1]) / s, (rot[0, 2] - rot[2, 0]) / s]
    else:
        q = [(rot[0, 2] + rot[2, 0]) / s, (rot[1, 2] + rot[2, 1]) / s, s / 4, (rot[1, 0] - rot[0, 1]) / s]
    return np.array(q)


def np_rotation_of(q: np.ndarray) -> np.ndarray:
    x, y, z, w = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def np_manifold_plus(rot: np.ndarray, t: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pose moved by a twist on its left."""
    dr, dt = np_se3_exp(delta)
    return dr @ rot, dr @ t + dt
