"""Transforms between pages, fitted by aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import page_rects_overlap

PAIR = ["set_id", "i", "j"]
AFFINE = ["a", "b", "tx", "c", "d", "ty"]


def _similarity(x: Column, y: Column, u: Column, v: Column) -> list[Column]:
    """Sums for the least-squares similarity from (x, y) to (u, v)."""
    return [F.sum(e) for e in (x, y, u, v, x * u + y * v, x * v - y * u, x * x + y * y)]


def _solved(n: Column, sums: list[Column]) -> list[Column]:
    x, y, u, v, dot, cross, square = sums
    size = F.nullif(n * square - x * x - y * y, F.lit(0.0))
    a = F.bround((n * dot - x * u - y * v) / size)
    b = F.bround((n * cross - x * v + y * u) / size)
    return [a, -b, (u - a * x + b * y) / n, b, a, (v - b * x - a * y) / n]


def fit_similarity(matched: DataFrame, keys: list[str] | None = None, least: int = 2) -> DataFrame:
    """Affine columns a..ty of the similarity from (x, y) to (to_x, to_y) of each key with at least ``least`` points.

    Turn and scale are rounded half-even to whole numbers, the shift is not. Keys whose
    points all coincide have no fit. ``n`` is the number of points. One aggregation.
    """
    keys = keys or PAIR
    sums = _similarity(*[F.col(c).cast("double") for c in ("x", "y", "to_x", "to_y")])
    rows = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).where(F.col("n") >= least)
    fit = _solved(F.col("n"), [F.col(f"s{k}") for k in range(7)])
    return rows.select(*keys, "n", *[f.alias(c) for c, f in zip(AFFINE, fit)]).where("a is not null")


def vote_inliers(matched: DataFrame, threshold: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Matches within ``threshold`` of the most frequent whole shift of their key; the least shift wins a tie."""
    keys = keys or PAIR
    rows = matched.withColumns({"dx": F.bround(F.col("to_x") - F.col("x")).cast("long"), "dy": F.bround(F.col("to_y") - F.col("y")).cast("long")})
    # the rows are sorted once for both windows, and where they are dealt by a part of the keys already, not moved
    rows = rows.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*keys, "dx", "dy")))
    best = F.max(F.struct("votes", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("m", best)
    near = (F.abs(F.col("to_x") - F.col("x") + F.col("m.dx")) <= threshold) & (F.abs(F.col("to_y") - F.col("y") + F.col("m.dy")) <= threshold)
    return rows.where(near).drop("m", "votes", "dx", "dy")


def fit_robust(matched: DataFrame, threshold: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """fit_similarity over the inliers of the vote."""
    return fit_similarity(vote_inliers(matched, threshold, keys), keys)


#: Cells of turn in a full circle, and of the logarithm of scale in a unit.
TURN_CELLS, SCALE_CELLS = 314, 50


def _densest(rows: DataFrame, keys: list[str], cells: tuple[Column, Column], means: tuple[str, str], around: int | None = None) -> DataFrame:
    """Per key the means of two columns over the cell with most rows, of a grid and its copies moved by half a cell; the least cell wins a tie."""
    moved = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0.0, 0.5) for q in (0.0, 0.5)]))
    rows = rows.select(*keys, *means, cells[0].alias("_u"), cells[1].alias("_v"), moved.alias("_o"))
    first = F.floor(F.col("_u") + F.col("_o.p"))
    rows = rows.withColumns({"_r": F.pmod(first, F.lit(around)) if around else first, "_s": F.floor(F.col("_v") + F.col("_o.q"))})
    votes = rows.groupBy(*keys, "_o", "_r", "_s").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(m).alias(m) for m in means])
    place = F.struct("_n", -F.col("_o.p"), -F.col("_o.q"), -F.col("_r"), -F.col("_s"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct(*means), place).alias("_m")).select(*keys, "_m.*")


def _linear(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares similarity of each key, not rounded: u = a x - c y + tx, v = c x + a y + ty."""
    x, y, u, v = (F.col(k) for k in ("x", "y", "to_x", "to_y"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"s{k}") for k, e in enumerate(_similarity(x, y, u, v))])
    n, sx, sy, su, sv, dot, cross, square = (F.col(k) for k in ("n", *(f"s{k}" for k in range(7))))
    size = F.nullif(n * square - sx * sx - sy * sy, F.lit(0.0))
    sums = sums.withColumns({"a": (n * dot - sx * su - sy * sv) / size, "c": (n * cross - sx * sv + sy * su) / size})
    shift = {"tx": (su - F.col("a") * sx + F.col("c") * sy) / n, "ty": (sv - F.col("c") * sx - F.col("a") * sy) / n}
    return sums.where("a is not null").select(*keys, "n", "a", "c", *[e.alias(k) for k, e in shift.items()])


def _residual() -> Column:
    across = F.col("to_x") - (F.col("a") * F.col("x") - F.col("c") * F.col("y") + F.col("tx"))
    down = F.col("to_y") - (F.col("c") * F.col("x") + F.col("a") * F.col("y") + F.col("ty"))
    return F.sqrt(across * across + down * down)


def turned_inliers(matched: DataFrame, threshold: float = 3.0, keys: list[str] | None = None, partners: int = 8) -> DataFrame:
    """Matches within ``threshold`` of the similarity, turned and scaled in any way, that most pairs of their key's matches agree on; ``rot`` is its turn in degrees.

    Every match is paired with the ``partners`` next to it in the order of a hash, so pairs grow
    with matches and not with their square. A pair of points at least ten thresholds apart votes for a cell of turn and
    logarithm of scale; under the mean of the best cell every match votes for a cell of shifts.
    What lies in the best one is fitted by least squares, and matches are held against that fit, twice.
    Keys without such a pair, one point or points that coincide, have no inliers.
    """
    keys = keys or PAIR
    place = ["x", "y", "to_x", "to_y"]
    rows = matched.withColumns({c: F.col(c).cast("double") for c in place})
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*place), *place)
    near = F.array(*[F.lead(F.struct(*place), k).over(order) for k in range(1, partners + 1)])
    pairs = rows.select(*keys, *place, near.alias("near")).select(*keys, *place, F.explode("near").alias("o")).where("o is not null")
    dx, dy, ex, ey = (F.col(f"o.{c}") - F.col(c) for c in place)
    pairs = pairs.select(*keys, dx.alias("dx"), dy.alias("dy"), ex.alias("ex"), ey.alias("ey"), (dx * dx + dy * dy).alias("size")).where(F.col("size") >= (10 * threshold) ** 2)
    pairs = pairs.select(*keys, ((F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) / F.col("size")).alias("a"), ((F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")) / F.col("size")).alias("c")).where("a <> 0 or c <> 0")
    turn, scale = F.atan2("c", "a") * (TURN_CELLS / (2 * math.pi)), F.log(F.col("a") * F.col("a") + F.col("c") * F.col("c")) * (SCALE_CELLS / 2)
    motion = _densest(pairs, keys, (turn, scale), ("a", "c"), TURN_CELLS)
    # shifts are taken at the middle of the points, where an error of the turn moves them least
    middle = rows.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    moved = rows.join(motion, keys).join(middle, keys).withColumns({"sx": F.col("to_x") - F.col("a") * x + F.col("c") * y, "sy": F.col("to_y") - F.col("c") * x - F.col("a") * y})
    width = 4 * threshold
    shift = _densest(moved, keys, (F.col("sx") / width, F.col("sy") / width), ("sx", "sy"))
    close = moved.join(shift.select(*keys, F.col("sx").alias("bx"), F.col("sy").alias("by")), keys).where((F.abs(F.col("sx") - F.col("bx")) <= width) & (F.abs(F.col("sy") - F.col("by")) <= width))
    for _ in range(2):
        motion = _linear(close, keys).drop("n")
        close = rows.join(motion, keys).where(_residual() <= threshold)
    return close.withColumn("rot", F.degrees(F.atan2("c", "a"))).drop("a", "c", "tx", "ty")


def fit_turned(matched: DataFrame, threshold: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Affine columns a..ty, n and rot (degrees) of the similarity over the turned inliers of each key, not rounded."""
    keys = keys or PAIR
    a, c = F.col("a"), F.col("c")
    found = _linear(turned_inliers(matched, threshold, keys), keys)
    return found.select(*keys, "n", "a", (-c).alias("b"), "tx", "c", a.alias("d"), "ty", F.degrees(F.atan2("c", "a")).alias("rot"))


def gate_and_score_grid(
    fits: DataFrame,
    crops: DataFrame,
    scale_threshold: float = 0.001,
    rotation_threshold: float = 0.001,
    intersection_area_threshold: float = 0.7,
    min_intersection_len_threshold: float = 0.3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Keep fits that are shifts and score them by their points, each counted in both orders of its labels.

    Large overlaps and short shared sides lower the score tenfold. The overlap is taken
    with the transform from i to j. Columns named in ``keep`` come along.
    """
    size = lambda p: crops.select("set_id", F.col("page_idx").alias(p), F.abs(F.col("cx1") - F.col("cx0")).alias(f"w{p}"), F.abs(F.col("cy1") - F.col("cy0")).alias(f"h{p}"))
    rows = fits.join(size("i"), ["set_id", "i"]).join(size("j"), ["set_id", "j"])
    scale = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    turn = F.abs(F.degrees(F.atan2("c", "a")))
    rows = rows.where((F.abs(1 - scale) <= scale_threshold) & ((turn <= rotation_threshold) | (F.abs(turn - F.lit(1.5707963267948966)) <= rotation_threshold)))
    area, side = page_rects_overlap(F.col("wi"), F.col("hi"), F.col("wj"), F.col("hj"), [F.col(c) for c in AFFINE])
    score = 2.0 * F.col("n") * F.when(area > intersection_area_threshold, 0.1).otherwise(1.0) * F.when(side < min_intersection_len_threshold, 0.1).otherwise(1.0)
    return rows.select(*PAIR, *AFFINE, *keep, score.alias("score"))


def fit_both_ways(matched: DataFrame, least: int = 2) -> DataFrame:
    """fit_similarity from i to j (a..ty) and from j to i (back_a..back_ty), from one aggregation."""
    x, y, u, v = (F.col(c).cast("double") for c in ("x", "y", "to_x", "to_y"))
    sums = [*_similarity(x, y, u, v), F.sum(u * u + v * v)]
    rows = matched.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]).where(F.col("n") >= least)
    sx, sy, su, sv, dot, cross, square, back = (F.col(f"s{k}") for k in range(8))
    there = _solved(F.col("n"), [sx, sy, su, sv, dot, cross, square])
    return_ = _solved(F.col("n"), [su, sv, sx, sy, dot, -cross, back])
    return rows.select(*PAIR, "n", *[f.alias(c) for c, f in zip(AFFINE, there)], *[f.alias(f"back_{c}") for c, f in zip(AFFINE, return_)]).where("a is not null")


def pair_grid_transforms(matched: DataFrame, crops: DataFrame, **gates: float) -> DataFrame:
    """Transforms in both directions of every pair that passes the gates, with one score."""
    fits = fit_both_ways(matched)
    scored = gate_and_score_grid(fits, crops, **gates, keep=tuple(f"back_{c}" for c in AFFINE))
    there = F.struct("i", "j", *AFFINE)
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *[F.col(f"back_{c}").alias(c) for c in AFFINE])
    return scored.select("set_id", "score", F.inline(F.array(there, back))).where("a is not null").select(*PAIR, *AFFINE, "score")
