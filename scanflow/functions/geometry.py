"""Points, rays and camera projection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(x * x + y * y + z * z)
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return x / norm, y / norm, z / norm


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def _minor(m: list[list[Column]], row: int, col: int) -> Column:
    """Determinant of a 4x4 matrix without one row and column."""
    (a, b, c), (d, e, f), (g, h, i) = [[x for k, x in enumerate(r) if k != col] for j, r in enumerate(m) if j != row]
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def camera_point(pose: Column, px: Column, py: Column, pz: Column) -> Column:
    """World point in camera axes by the pose's inverse; null for a pose that has none."""
    m = [[F.get(pose, 4 * r + c) for c in range(4)] for r in range(4)]
    point = [px, py, pz, F.lit(1.0)]
    cofactor = [[_minor(m, r, c) * (-1.0 if (r + c) % 2 else 1.0) for c in range(4)] for r in range(4)]
    det = sum((m[0][c] * cofactor[0][c] for c in range(1, 4)), m[0][0] * cofactor[0][0])
    whole = F.when(det != 0, det)
    x, y, z = (sum((cofactor[r][c] * point[r] for r in range(1, 4)), cofactor[0][c] * point[0]) / whole for c in range(3))
    # axis change of the headset camera: (x, y, z) -> (-y, -z, x)
    return F.when(whole.isNotNull() & px.isNotNull() & py.isNotNull() & pz.isNotNull(), F.array(-y, -z, x))


def ray_point(origin: Column, direction: Column, reach: float) -> Column:
    return origin + direction * F.lit(reach)


def pinhole(x: Column, z: Column, focal: Column, centre: Column) -> Column:
    """Image coordinate of a camera point; null behind the camera."""
    return F.when(z > 0, x / F.when(z > 0, z) * focal + centre)


def hfov(width: Column, focal: Column) -> Column:
    """Horizontal field of view in degrees, 90 without a focal length."""
    known = F.when(focal > 0, focal)
    return F.coalesce(F.degrees(F.lit(2.0) * F.atan(width / (F.lit(2.0) * known))), F.lit(90.0))


def fov_radius(width: Column, angle: Column, visual_degrees: float = 13.0) -> Column:
    return F.floor(F.lit(visual_degrees) * width / angle).cast("long")


def crop_box(x: Column, y: Column, width: Column, height: Column, radius: Column) -> Column:
    """Square around a normalised point, cut to the image."""
    cx, cy = F.floor(x * width).cast("long"), F.floor(y * height).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(
        F.greatest(zero, cx - radius).alias("left"),
        F.greatest(zero, cy - radius).alias("top"),
        F.least(width, cx + radius).alias("right"),
        F.least(height, cy + radius).alias("bottom"),
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays; 1 when either is constant."""

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)

    n = F.size(a).cast("double")
    ab = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
    sa, sb = total(F.transform(a, lambda v: v.cast("double"))), total(F.transform(b, lambda v: v.cast("double")))
    saa = total(F.transform(a, lambda v: v.cast("double") * v.cast("double")))
    sbb = total(F.transform(b, lambda v: v.cast("double") * v.cast("double")))
    upper = total(ab) - sa * sb / n
    lower = F.sqrt((saa - sa * sa / n) * (sbb - sb * sb / n))
    return F.when(lower > 0, upper / F.when(lower > 0, lower)).otherwise(F.lit(1.0))
