"""Queries of the geometry expressions, over pairs of lines made from line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Two lines a and b per line item; a third of either kind runs along an axis.
PAIRS = """
SELECT k, o, ax0, ay0, CASE WHEN o % 3 = 0 THEN ax0 ELSE ax1 END AS ax1, CASE WHEN o % 3 = 1 THEN ay0 ELSE ay1 END AS ay1,
  bx0, by0, CASE WHEN o % 5 = 0 THEN bx0 ELSE bx1 END AS bx1, CASE WHEN o % 5 = 1 THEN by0 ELSE by1 END AS by1 FROM (
SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey + l_linenumber AS o,
  l_partkey % 97 AS ax0, l_suppkey % 89 AS ay0, l_partkey % 97 + 1 + l_orderkey % 53 AS ax1, l_suppkey % 89 - 40 + l_partkey % 83 AS ay1,
  l_suppkey % 61 AS bx0, l_partkey % 71 AS by0, l_suppkey % 61 + 1 + l_partkey % 59 AS bx1, l_partkey % 71 - 30 + l_orderkey % 67 AS by1
FROM lineitem) z"""


def _line(side: str) -> list[Column]:
    return [F.col(f"{side}{c}") for c in ("x0", "y0", "x1", "y1")]


def _pairs(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return s.sql(PAIRS)


def _add(name: str, columns: Callable[[list[Column], list[Column]], dict[str, Column]], sql: str) -> None:
    """A query that selects k and ``columns`` of the two lines, and its SQL select list over the same pairs as p."""
    QUERIES[name] = lambda s, d: _pairs(s, d).select("k", *[c.alias(n) for n, c in columns(_line("a"), _line("b")).items()])
    ORACLE_SQL[name] = f"WITH p AS ({PAIRS}) SELECT k, {sql} FROM p"


def _named(values: list[Column], names: str) -> dict[str, Column]:
    return dict(zip(names.split(), values))


def _round(c: Column) -> Column:
    return F.round(c, 6) + 0.0


BOX = "x0 y0 x1 y1"
_add("g1_fix_coords", lambda A, B: _named(g.fix_coords(A), BOX), "LEAST(ax0, ax1) AS x0, LEAST(ay0, ay1) AS y0, GREATEST(ax0, ax1) AS x1, GREATEST(ay0, ay1) AS y1")
_SWAP = "(bx0 < ax0 OR (bx0 = ax0 AND by0 < ay0))"
_add(
    "g2_fix_coords_line",
    lambda A, B: _named(g.fix_coords_line([A[0], A[1], B[0], B[1]]), BOX),
    ", ".join(f"CASE WHEN {_SWAP} THEN {v} ELSE {u} END AS {n}" for n, u, v in (("x0", "ax0", "bx0"), ("y0", "ay0", "by0"), ("x1", "bx0", "ax0"), ("y1", "by0", "ay0"))),
)
_add("g3_scale_crop_point", lambda A, B: _named(g.scale_crop_point(A[0] + F.lit(0.5), A[1] + F.lit(0.5), B), "x y"), "CAST(round_even(ax0 + 0.5e0 - bx0, 0) AS BIGINT) AS x, CAST(round_even(ay0 + 0.5e0 - by0, 0) AS BIGINT) AS y")
_add("g4_scale_bbox_by_bbox", lambda A, B: _named(g.scale_bbox_by_bbox(B, A), BOX), "ax0 - bx0 AS x0, ay0 - by0 AS y0, ax1 - bx0 AS x1, ay1 - by0 AS y1")
_add("g5_scale_crop", lambda A, B: _named(g.scale_crop(A, B), BOX), "LEAST(ax0, ax1) + bx0 AS x0, LEAST(ay0, ay1) + by0 AS y0, GREATEST(ax0, ax1) + bx0 AS x1, GREATEST(ay0, ay1) + by0 AS y1")
_add("g6_euclidean_dist", lambda A, B: {"dist": _round(g.euclidean_dist(A[0], A[1], B[0], B[1]))}, "ROUND(SQRT((ax0 - bx0) ** 2 + (ay0 - by0) ** 2), 6) AS dist")
_add(
    "g7_point_cw_rotate",
    lambda A, B: _named(g.point_cw_rotate(A[0], A[1], (F.col("o") % 4 * 90).cast("int"), F.lit(100.7), F.lit(90.2)), "x y"),
    "CASE o % 4 WHEN 1 THEN ay0 WHEN 2 THEN 100 - ax0 WHEN 3 THEN 100 - ay0 ELSE ax0 END AS x, CASE o % 4 WHEN 1 THEN 90 - ax0 WHEN 2 THEN 90 - ay0 WHEN 3 THEN ax0 ELSE ay0 END AS y",
)
_M = "(({s}y1 - {s}y0) * 1e0 / NULLIF({s}x1 - {s}x0, 0))"
MA, MB = _M.format(s="a"), _M.format(s="b")
_add("g8_slope_intercept", lambda A, B: _named([_round(c) for c in g.slope_intercept(A)], "m b"), f"ROUND({MA}, 6) + 0 AS m, ROUND(ay0 - {MA} * ax0, 6) + 0 AS b")
_add("g9_projection_area", lambda A, B: _named(g.projection_area(A[0], A[1], B[0], B[1], F.lit(300), F.lit(200)), BOX), "bx0 - ax0 AS x0, by0 - ay0 AS y0, 300 - ax0 + bx0 AS x1, 200 - ay0 + by0 AS y1")


def _hit(c: Column) -> dict[str, Column]:
    return {"hit": c["hit"], "x": _round(c["x"]), "y": _round(c["y"])}


def _near(low: str, value: str, high: str, tol: int) -> str:
    return f"({value} - {tol} BETWEEN {low} AND {high} OR {value} + {tol} BETWEEN {low} AND {high})"


def _vh(tol: int) -> tuple[str, str, str]:
    same = "(ax0 = bx0 AND ay0 = by0 AND ax1 = bx1 AND ay1 = by1)"
    ab, ba = "(ay0 = ay1 AND bx0 = bx1)", "(ax0 = ax1 AND by0 = by1)"
    hit = f"CASE WHEN {same} THEN true WHEN {ab} THEN {_near('ax0', 'bx0', 'ax1', tol)} AND {_near('by0', 'ay0', 'by1', tol)} WHEN {ba} THEN {_near('bx0', 'ax0', 'bx1', tol)} AND {_near('ay0', 'by0', 'ay1', tol)} ELSE false END"
    return hit, f"CASE WHEN {same} THEN ax0 WHEN {ab} THEN bx0 WHEN {ba} THEN ax0 END", f"CASE WHEN {same} THEN ay0 WHEN {ab} THEN ay0 WHEN {ba} THEN by0 END"


def _in(x: str, y: str, s: str, tol: int) -> str:
    return f"{x} BETWEEN LEAST({s}x0, {s}x1) - {tol} AND GREATEST({s}x0, {s}x1) + {tol} AND {y} BETWEEN LEAST({s}y0, {s}y1) - {tol} AND GREATEST({s}y0, {s}y1) + {tol}"


def _axis_inclined(a: str, b: str, tol: int) -> tuple[str, str, str]:
    m = _M.format(s=b)
    q = f"({b}y0 - {m} * {b}x0)"
    x = f"round_even(CASE WHEN {a}x0 = {a}x1 THEN {a}x0 * 1e0 ELSE ({a}y0 - {q}) / NULLIF({m}, 0) END, 0)"
    y = f"round_even(CASE WHEN {a}x0 = {a}x1 THEN {m} * {a}x0 + {q} ELSE {a}y0 * 1e0 END, 0)"
    ok = f"COALESCE({_in(x, y, a, tol)} AND {_in(x, y, b, tol)}, false)"
    return ok, f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"


def _two_inclined(tol: int) -> tuple[str, str, str]:
    qa, qb = f"(ay0 - {MA} * ax0)", f"(by0 - {MB} * bx0)"
    e = f"(({qb} - {qa}) / NULLIF({MA} - {MB}, 0))"
    x, y = f"round_even({e}, 0)", f"round_even({MA} * {e} + {qa}, 0)"
    ok = f"COALESCE({_in(x, y, 'a', tol)} AND {_in(x, y, 'b', tol)}, false)"
    return ok, f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"


def _shown(parts: tuple[str, str, str]) -> str:
    return f"{parts[0]} AS hit, CAST({parts[1]} AS DOUBLE) + 0 AS x, CAST({parts[2]} AS DOUBLE) + 0 AS y"


_add("g10_line_v_h_intersection", lambda A, B: _hit(g.line_v_h_intersection(A, B)), _shown(_vh(1)))
_add("g11_line_axis_inclined_intersection", lambda A, B: _hit(g.line_axis_inclined_intersection([F.lit(40), A[1], F.lit(40), A[1] + 50], B)), _shown(_axis_inclined("a", "b", 1)))
ORACLE_SQL["g11_line_axis_inclined_intersection"] = f"WITH p AS (SELECT * REPLACE (40 AS ax0, 40 AS ax1, ay0 + 50 AS ay1) FROM ({PAIRS})) SELECT k, {_shown(_axis_inclined('a', 'b', 1))} FROM p"
_add("g12_line_inclined_intersection", lambda A, B: _hit(g.line_inclined_intersection(A, B)), _shown(_two_inclined(1)))
_AXIS = {s: f"({s}x0 = {s}x1 OR {s}y0 = {s}y1)" for s in "ab"}
_KINDS = (_vh(0), _axis_inclined("a", "b", 0), _axis_inclined("b", "a", 0), _two_inclined(0))
_add(
    "g13_line_intersection",
    lambda A, B: _hit(g.line_intersection(A, B)),
    _shown(tuple(f"CASE WHEN {_AXIS['a']} AND {_AXIS['b']} THEN {k[0]} WHEN {_AXIS['a']} THEN {k[1]} WHEN {_AXIS['b']} THEN {k[2]} ELSE {k[3]} END" for k in zip(*_KINDS))),
)
_H = lambda A: [F.lit(1.0), F.lit(0.0), A[0] - F.lit(50.0), F.lit(0.0), F.lit(1.0), A[1] - F.lit(40.0)]
_W, _HT = "GREATEST(0, LEAST(100, 80 + ax0 - 50) - GREATEST(0, ax0 - 50))", "GREATEST(0, LEAST(90, 70 + ay0 - 40) - GREATEST(0, ay0 - 40))"
_add("g14_page_rects_overlap", lambda A, B: _named([_round(c) for c in g.page_rects_overlap(F.lit(100), F.lit(90), F.lit(80), F.lit(70), _H(A))], "area side"), f"ROUND({_W} * {_HT} / 9000e0, 6) AS area, ROUND(GREATEST({_W} / 100e0, {_HT} / 90e0), 6) AS side")
_T = lambda A: [F.lit(2.0), F.lit(1.0), A[0] * 1.0, F.lit(-1.0), F.lit(1.5), A[1] * 1.0]
_INV = lambda x, y: (f"(1.5e0 * ({x} - ax0) - ({y} - ay0)) / 4", f"(({x} - ax0) + 2 * ({y} - ay0)) / 4")
_add(
    "g15_fix_cropbox",
    lambda A, B: _named([_round(c) for c in g.fix_cropbox(B, _T(A))], BOX),
    ", ".join(f"ROUND({e}, 6) + 0 AS {n}" for n, e in zip(BOX.split(), [*_INV("bx0", "by0"), *_INV("bx1", "by1")])),
)
_U = lambda B: [F.lit(0.0), F.lit(-1.0), B[0] * 1.0, F.lit(1.0), F.lit(0.0), B[1] * 1.0]
_add(
    "g16_affine",
    lambda A, B: _named([_round(c) for c in [*g.compose_affine(_T(A), _U(B)), *g.invert_affine(_U(B)), *g.apply_affine(_T(A), B[0], B[1])]], "a b tx c d ty ia ib itx ic id ity px py"),
    "1e0 AS a, -2e0 AS b, 2e0 * bx0 + by0 + ax0 AS tx, 1.5e0 AS c, 1e0 AS d, -1e0 * bx0 + 1.5e0 * by0 + ay0 AS ty, 0e0 AS ia, 1e0 AS ib, -1e0 * by0 + 0 AS itx, -1e0 AS ic, 0e0 AS id, 1e0 * bx0 AS ity, 2e0 * bx0 + by0 + ax0 AS px, -1e0 * bx0 + 1.5e0 * by0 + ay0 AS py",
)
