"""Geometry as Column expressions: everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def fix_coords(box: Box) -> list[Column]:
    """Corners as (least x, least y, greatest x, greatest y)."""
    x0, y0, x1, y1 = box
    return [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]


def fix_coords_line(line: Box) -> list[Column]:
    """Endpoints in the order of (x, y)."""
    x0, y0, x1, y1 = line
    swap = (x1 < x0) | ((x1 == x0) & (y1 < y0))
    return [F.when(swap, b).otherwise(a) for a, b in ((x0, x1), (y0, y1), (x1, x0), (y1, y0))]


def scale_crop_point(x: Column, y: Column, box: Box) -> list[Column]:
    """A page point seen from the crop's origin, half-even to whole pixels."""
    return [F.bround(x - box[0]).cast("long"), F.bround(y - box[1]).cast("long")]


def scale_bbox_by_bbox(outer: Box, inner: Box) -> list[Column]:
    return scale_crop_point(inner[0], inner[1], outer) + scale_crop_point(inner[2], inner[3], outer)


def scale_crop(box: Box, crop: Box) -> list[Column]:
    """A box inside a crop moved back to the page."""
    x0, y0, x1, y1 = fix_coords(box)
    return [x0 + crop[0], y0 + crop[1], x1 + crop[0], y1 + crop[1]]


def euclidean_dist(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def point_cw_rotate(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> list[Column]:
    """Turn a point clockwise by 0, 90, 180 or 270 degrees in a box cut to whole sizes."""
    w, h = width.cast("long"), height.cast("long")
    return [
        F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, w - y).otherwise(x),
        F.when(rotation == 90, h - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y),
    ]


def box_cw_rotate(box: Box, rotation: Column, width: Column, height: Column) -> list[Column]:
    return fix_coords(point_cw_rotate(box[0], box[1], rotation, width, height) + point_cw_rotate(box[2], box[3], rotation, width, height))


def slope_intercept(line: Box) -> list[Column]:
    x0, y0, x1, y1 = line
    m = (y1 - y0) / F.nullif(x1 - x0, F.lit(0))
    return [m, y0 - m * x0]


def projection_area(x: Column, y: Column, ax: Column, ay: Column, width: Column, height: Column) -> list[Column]:
    """The page rectangle when its point (x, y) lies on (ax, ay)."""
    return [ax - x, ay - y, width - x + ax, height - y + ay]


def line_type(line: Box) -> Column:
    x0, y0, x1, y1 = line
    return F.when(y0 == y1, "horizontal").when(x0 == x1, "vertical").otherwise("other")


def _point(hit: Column, x: Column, y: Column) -> Column:
    return F.struct(hit.alias("hit"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def _none() -> Column:
    return _point(F.lit(False), F.lit(None), F.lit(None))


def line_v_h_intersection(a: Box, b: Box, tol: int = 1) -> Column:
    """struct(hit, x, y) of two axis-parallel lines.

    The point of a horizontal and a vertical line is given even where they do not
    reach each other; parallel lines have none unless they are equal.
    """

    def crossing(h: Box, v: Box) -> Column:
        def near(low: Column, value: Column, high: Column) -> Column:
            return ((low <= value - tol) & (value - tol <= high)) | ((low <= value + tol) & (value + tol <= high))

        return _point(near(h[0], v[0], h[2]) & near(v[1], h[1], v[3]), v[0], h[1])

    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    return (
        F.when(same, _point(F.lit(True), a[0], a[1]))
        .when((a[1] == a[3]) & (b[0] == b[2]), crossing(a, b))
        .when((a[0] == a[2]) & (b[1] == b[3]), crossing(b, a))
        .otherwise(_none())
    )


def _bind(value: Column, f):  # noqa: ANN001, ANN202
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _within(x: Column, y: Column, line: Box, tol: int) -> Column:
    x0, y0, x1, y1 = fix_coords(line)
    return x.between(x0 - tol, x1 + tol) & y.between(y0 - tol, y1 + tol)


def line_axis_inclined_intersection(axis: Box, inclined: Box, tol: int = 1, rounding: bool = True) -> Column:
    """struct(hit, x, y) of an axis-parallel and an inclined line; no point outside either."""
    m, b = slope_intercept(inclined)
    upright = axis[0] == axis[2]
    near = (lambda e: F.bround(e)) if rounding else (lambda e: e)
    found = F.when(upright, F.struct(axis[0].cast("double").alias("x"), near(m * axis[0] + b).alias("y"))).otherwise(F.struct(near((axis[1] - b) / F.nullif(m, F.lit(0.0))).alias("x"), axis[1].cast("double").alias("y")))
    return _bind(found, lambda p: F.when(_within(p["x"], p["y"], axis, tol) & _within(p["x"], p["y"], inclined, tol), _point(F.lit(True), p["x"], p["y"])).otherwise(_none()))


def line_inclined_intersection(a: Box, b: Box, tol: int = 1) -> Column:
    """struct(hit, x, y) of two inclined lines; y follows from the unrounded x."""
    (m1, b1), (m2, b2) = slope_intercept(a), slope_intercept(b)
    exact = _bind(F.struct(m1.alias("m"), b1.alias("b"), ((b2 - b1) / F.nullif(m1 - m2, F.lit(0.0))).alias("x")), lambda e: F.struct(F.bround(e["x"]).alias("x"), F.bround(e["m"] * e["x"] + e["b"]).alias("y")))
    return _bind(exact, lambda p: F.when(_within(p["x"], p["y"], a, tol) & _within(p["x"], p["y"], b, tol), _point(F.lit(True), p["x"], p["y"])).otherwise(_none()))


def line_intersection(a: Box, b: Box) -> Column:
    """Choose by the kinds of the lines, without tolerance."""
    axis_a, axis_b = ((s[0] == s[2]) | (s[1] == s[3]) for s in (a, b))
    return (
        F.when(axis_a & axis_b, line_v_h_intersection(a, b, 0))
        .when(axis_a, line_axis_inclined_intersection(a, b, 0))
        .when(axis_b, line_axis_inclined_intersection(b, a, 0))
        .otherwise(line_inclined_intersection(a, b, 0))
    )


def page_rects_overlap(w1: Column, h1: Column, w2: Column, h2: Column, affine: Sequence[Column]) -> list[Column]:
    """(area over the first area, longer side share) of the first page and the second moved by ``affine``; from two opposite corners."""
    a, b, tx, c, d, ty = affine
    width = F.greatest(F.lit(0.0), F.least(w1, a * w2 + b * h2 + tx) - F.greatest(F.lit(0.0), tx))
    height = F.greatest(F.lit(0.0), F.least(h1, c * w2 + d * h2 + ty) - F.greatest(F.lit(0.0), ty))
    return [width * height / (w1 * h1), F.greatest(width / w1, height / h1)]


def apply_affine(affine: Sequence[Column], x: Column, y: Column) -> list[Column]:
    a, b, tx, c, d, ty = affine
    return [a * x + b * y + tx, c * x + d * y + ty]


def compose_affine(outer: Sequence[Column], inner: Sequence[Column]) -> list[Column]:
    """``outer`` after ``inner``, both (a, b, tx, c, d, ty)."""
    a, b, tx, c, d, ty = outer
    e, f, ux, g, h, uy = inner
    return [a * e + b * g, a * f + b * h, a * ux + b * uy + tx, c * e + d * g, c * f + d * h, c * ux + d * uy + ty]


def invert_affine(affine: Sequence[Column]) -> list[Column]:
    """Null where the transform has no inverse."""
    a, b, tx, c, d, ty = affine
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return [d / det, -b / det, (b * ty - d * tx) / det, -c / det, a / det, (c * tx - a * ty) / det]


def fix_cropbox(crop: Box, matrix: Sequence[Column]) -> list[Column]:
    """Crop corners through the inverse of the page matrix."""
    inverse = invert_affine(matrix)
    return apply_affine(inverse, crop[0], crop[1]) + apply_affine(inverse, crop[2], crop[3])
