"""Plane geometry as Spark column expressions; angles are in degrees, y points down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance: the form to compare with a squared threshold, the same in any engine."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance to the nearest point of a segment; a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(clamp(((px - x0) * dx + (py - y0) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length)))
    return F.sqrt(squared(px, py, x0 + t * dx, y0 + t * dy))


def distance_score(d: Column, reach: float) -> Column:
    """1 at no distance, falling to 0 at `reach`."""
    return F.greatest(F.lit(0.0), 1 - d / reach) if reach > 0 else F.lit(0.0)


def direction(dx: Column, dy: Column) -> Column:
    """Angle of a vector, in (-180, 180]."""
    return F.degrees(F.atan2(dy, dx))


def undirected(dx: Column, dy: Column) -> Column:
    """Angle of a line, in [0, 180)."""
    return F.pmod(direction(dx, dy), F.lit(180.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Between two directions, in [0, 180]."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def line_delta(a: Column, b: Column) -> Column:
    """Between two lines, in [0, 90]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def triad(rotation: Column) -> Column:
    """The three axes, 60 degrees apart, turned by `rotation`; without a turn the first is vertical."""
    return F.array(*[F.pmod(rotation + F.lit(step), F.lit(180.0)) for step in (90.0, 30.0, 150.0)])


def triad_delta(angle: Column, rotation: Column) -> Column:
    """Distance of a line's angle to the nearest axis."""
    return F.array_min(F.transform(triad(rotation), lambda axis: line_delta(angle, axis)))


def shortest_turn(angle: Column, axis: Column) -> Column:
    """The smaller turn that brings a directed angle onto an undirected axis, in degrees, in [-90, 90]."""
    turn = F.pmod(axis - angle, F.lit(180.0))
    return F.when(turn > 90.0, turn - 180.0).otherwise(turn)


def turned_about_midpoint(x0: Column, y0: Column, x1: Column, y1: Column, turn: Column) -> Column:
    """The segment turned by `turn` degrees about its midpoint: struct of x0, y0, x1, y1."""
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    at = lambda x, y: (mx + (x - mx) * c - (y - my) * s, my + (x - mx) * s + (y - my) * c)
    (ax, ay), (bx, by) = at(x0, y0), at(x1, y1)
    return F.struct(ax.alias("x0"), ay.alias("y0"), bx.alias("x1"), by.alias("y1"))


def crossing(a: str, b: str) -> dict[str, Column]:
    """x, y, det and the places on both segments of the crossing of the lines through segments `a` and `b` (columns x0 to y1)."""
    x1, y1, x2, y2 = (F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1"))
    x3, y3, x4, y4 = (F.col(f"{b}.{c}") for c in ("x0", "y0", "x1", "y1"))
    det = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    safe = F.when(F.abs(det) < 1e-9, F.lit(None).cast("double")).otherwise(det)
    p, q = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    x, y = (p * (x3 - x4) - (x1 - x2) * q) / safe, (p * (y3 - y4) - (y1 - y2) * q) / safe

    def place(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
        length = (u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)
        return F.when(length < 1e-9, F.lit(0.0)).otherwise(((x - u0) * (u1 - u0) + (y - v0) * (v1 - v0)) / F.when(length < 1e-9, F.lit(1.0)).otherwise(length))

    return {"x": x, "y": y, "det": det, "ta": place(x1, y1, x2, y2), "tb": place(x3, y3, x4, y4)}


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    """A row-major 3 x 3 homography applied to a point: struct of x and y, null where the point goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    safe = F.when(F.abs(w) < 1e-12, F.lit(None).cast("double")).otherwise(w)
    return F.struct(((m[0] * x + m[1] * y + m[2]) / safe).alias("x"), ((m[3] * x + m[4] * y + m[5]) / safe).alias("y"))


def multiply_matrices(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def invert_matrix(m: Column) -> Column:
    """The inverse, null for a singular matrix."""
    det = determinant(m)
    cofactors = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return F.when(F.abs(det) >= 1e-12, F.array(*[c / F.when(F.abs(det) < 1e-12, F.lit(1.0)).otherwise(det) for c in cofactors]))


def polyline_length(points: Column) -> Column:
    """Length of an array of structs x, y."""
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), after, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def overlap_fraction(x0: Column, y0: Column, x1: Column, y1: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """The part of a segment's bounding box (of an area of 1 at least) that lies in a box; 0 where they don't overlap."""
    low_x, high_x, low_y, high_y = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    area = F.greatest(F.lit(1.0), (high_x - low_x) * (high_y - low_y))
    w, h = F.least(high_x, bx + bw) - F.greatest(low_x, bx), F.least(high_y, by + bh) - F.greatest(low_y, by)
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(F.lit(0.0))
