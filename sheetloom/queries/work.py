"""Queries of raster steps, keypoint matching, page ordering and anchoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchor, bounds, clean, fit, match, ordering, points, raster
from ..plans import anchored, keypoints
from .fixture import FIXTURE, view
from .lines import NAMED_PARTS, WIDTHS, crops, named_lines, oriented, shared_points
from .sql import CROPS, FITS, ORIENTED, POINTS, UNIQUE, ask, ask_recursive

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_GRAY = "gray AS (SELECT set_id, page_idx, x, y, CAST(round_even(r * 0.114e0 + g * 0.587e0 + b * 0.299e0, 0) AS INT) AS gray FROM pixels)"


@query(ask("SELECT * FROM gray WHERE gray > 100", _GRAY))
def r1_to_gray_threshold(s: SparkSession, d: str) -> DataFrame:
    return raster.to_gray_threshold(view(s, d, "pixels"))


@query(ask("SELECT set_id, page_idx, x, y, r, g, b FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM text_boxes t WHERE t.set_id = p.set_id AND t.page_idx = p.page_idx AND x BETWEEN TRUNC(x0) AND TRUNC(x1) AND y BETWEEN TRUNC(y0) AND TRUNC(y1))"))
def r2_mask_text(s: SparkSession, d: str) -> DataFrame:
    return raster.mask_text(view(s, d, "pixels"), view(s, d, "text_boxes"))


_CROPPED = "cropped AS (SELECT p.set_id, p.page_idx, x - cx0 AS x, y - cy0 AS y, r, g, b FROM pixels p JOIN crops USING (set_id, page_idx) WHERE x >= cx0 AND x < cx1 AND y >= cy0 AND y < cy1)"


@query(ask("SELECT * FROM cropped", ORIENTED, CROPS, _CROPPED))
def r3_crop_pixels(s: SparkSession, d: str) -> DataFrame:
    return raster.crop_pixels(view(s, d, "pixels"), crops(s, d))


@query(
    ask(
        "SELECT c.set_id, c.page_idx, k.k AS stripe, COUNT(*) AS n, CAST(SUM(x) AS BIGINT) AS sx, CAST(SUM(y) AS BIGINT) AS sy FROM cropped c JOIN wd USING (set_id, page_idx) JOIN (VALUES (0), (1), (2), (3), (4)) k(k) ON CASE k.k WHEN 0 THEN true WHEN 1 THEN x < w1 WHEN 2 THEN x >= w - w2 WHEN 3 THEN y < w3 ELSE y >= h - w4 END GROUP BY ALL",
        ORIENTED,
        CROPS,
        _CROPPED,
        WIDTHS,
        "wd AS (SELECT set_id, page_idx, MAX(w) AS w, MAX(h) AS h, MAX(CASE WHEN stripe = 1 THEN width END) AS w1, MAX(CASE WHEN stripe = 2 THEN width END) AS w2, MAX(CASE WHEN stripe = 3 THEN width END) AS w3, MAX(CASE WHEN stripe = 4 THEN width END) AS w4 FROM widths JOIN sz USING (set_id, page_idx) GROUP BY ALL)",
    )
)
def r4_stripe_pixels(s: SparkSession, d: str) -> DataFrame:
    c = crops(s, d)
    rows = raster.stripe_pixels(raster.crop_pixels(view(s, d, "pixels"), c), bounds.stripe_widths(view(s, d, "match_lines"), c), c)
    return rows.groupBy("set_id", "page_idx", "stripe").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


_BOTH = "SELECT set_id, page_idx FROM named GROUP BY ALL HAVING COUNT(DISTINCT axis) = 2"
_ORDER = (
    *NAMED_PARTS,
    f"""bx AS ({_BOTH}),
na AS (SELECT n.*, ROW(l, n, d) AS name FROM named n JOIN bx USING (set_id, page_idx)),
ex AS (SELECT set_id, page_idx, axis, MIN(name) AS lo, MAX(name) AS hi, ARG_MIN(coord, name_rank) AS c0, MAX(CASE WHEN name_rank = 1 THEN coord END) AS c1, ARG_MAX(coord, name_rank) AS cn FROM na GROUP BY ALL),
rl AS (SELECT m.set_id, LEAST(m.page_idx, o.page_idx) AS i, GREATEST(m.page_idx, o.page_idx) AS j, m.page_idx AS of, m.axis, m.name_rank,
  CAST(CASE WHEN m.name < o.lo THEN -3 WHEN m.name > o.hi THEN -1 ELSE COALESCE(t.name_rank, -2) END AS INT) AS rel
  FROM na m JOIN ex o ON o.set_id = m.set_id AND o.axis = m.axis AND o.page_idx <> m.page_idx LEFT JOIN na t ON t.set_id = m.set_id AND t.axis = m.axis AND t.page_idx = o.page_idx AND t.name = m.name)""",
)


@query(ask("SELECT * FROM rl", *_ORDER))
def o1_name_relations(s: SparkSession, d: str) -> DataFrame:
    return ordering.name_relations(named_lines(s, d))


_COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE axis = '{a}' AND {c}) AS {p}_{k}" for p, a in (("h", "H"), ("v", "V")) for k, c in (("less", "rel = -3"), ("greater", "rel = -1"), ("mess", "rel = -2"), ("intersect", "rel >= 0")))
_STATS = f"""sc AS (SELECT set_id, i, j, {_COUNTS} FROM rl WHERE of = j GROUP BY ALL),
rv AS (SELECT set_id, page_idx AS j, BOOL_OR(axis = 'H' AND COALESCE(c0 > c1, false)) AS h_reversed, BOOL_OR(axis = 'V' AND COALESCE(c0 > c1, false)) AS v_reversed FROM ex GROUP BY ALL),
st AS (SELECT sc.*, h_reversed, v_reversed FROM sc JOIN rv USING (set_id, j))"""


@query(ask("SELECT * FROM st", *_ORDER, _STATS))
def o2_pair_order_stats(s: SparkSession, d: str) -> DataFrame:
    return ordering.pair_order_stats(named_lines(s, d))


_INDEX = "ni AS (SELECT set_id, axis, l, n, d, CAST(ROW_NUMBER() OVER (PARTITION BY set_id, axis ORDER BY l, n, d) - 1 AS INT) AS idx FROM (SELECT DISTINCT set_id, axis, l, n, d FROM named))"


@query(ask("SELECT * FROM ni", *NAMED_PARTS, _INDEX))
def o3_axis_name_index(s: SparkSession, d: str) -> DataFrame:
    return ordering.axis_name_index(named_lines(s, d)).select("set_id", "axis", "name.*", "idx")


_STEP = "sg AS (SELECT set_id, axis, ABS(coord - LAG(coord) OVER (PARTITION BY set_id, page_idx, axis ORDER BY name_rank)) AS gap FROM named), ms AS (SELECT set_id, axis, COALESCE(MEDIAN(gap), -1e0) AS step FROM sg GROUP BY ALL)"


@query(ask("SELECT * FROM ms", *NAMED_PARTS, _STEP))
def o4_median_grid_step(s: SparkSession, d: str) -> DataFrame:
    return ordering.median_grid_step(named_lines(s, d))


_AXES = """cf AS (SELECT *, ABS(h_less - h_greater) - h_intersect AS tb, ABS(v_less - v_greater) - v_intersect AS lr FROM st),
pa AS (SELECT *, CASE WHEN h_intersect > 0 AND v_intersect > 0 AND h_intersect >= GREATEST(h_less, h_greater) AND v_intersect >= GREATEST(v_less, v_greater) THEN 2 WHEN lr > 0 AND lr > tb THEN 0 WHEN tb > 0 AND tb > lr THEN 1 END AS axis_code FROM cf),
pu AS (SELECT *, CASE axis_code WHEN 0 THEN tb > 0 AND tb > 0.75 * lr WHEN 1 THEN lr > 0 AND lr > 0.75 * tb ELSE false END AS use_secondary FROM pa WHERE axis_code IS NOT NULL)"""


@query(ask("SELECT set_id, i, j, axis_code, use_secondary FROM pu", *_ORDER, _STATS, _AXES))
def o5_placement_axis(s: SparkSession, d: str) -> DataFrame:
    return ordering.placement_axis(ordering.pair_order_stats(named_lines(s, d))).select("set_id", "i", "j", "axis_code", "use_secondary")


def _side(code: str) -> str:
    lr = "CASE WHEN v_less * 0.7 > v_greater THEN CASE WHEN v_reversed THEN 2 ELSE 1 END WHEN v_greater * 0.7 > v_less THEN CASE WHEN v_reversed THEN 1 ELSE 2 END END"
    tb = "CASE WHEN h_less * 0.7 > h_greater THEN CASE WHEN h_reversed THEN 4 ELSE 3 END WHEN h_greater * 0.7 > h_less THEN CASE WHEN h_reversed THEN 3 ELSE 4 END END"
    return f"CASE {code} WHEN 0 THEN {lr} WHEN 1 THEN {tb} WHEN 2 THEN 0 END"


@query(ask(f"SELECT set_id, i, j, {_side('axis_code')} AS placement FROM pu", *_ORDER, _STATS, _AXES))
def o6_relative_placement(s: SparkSession, d: str) -> DataFrame:
    rows = ordering.placement_axis(ordering.pair_order_stats(named_lines(s, d)))
    return rows.select("set_id", "i", "j", ordering.relative_placement(F.col("axis_code")).alias("placement"))


def _acceptable(n: int) -> str:
    """The placement p{n} of w where the pages are near enough or share a line of its axis."""
    return f"""q{n} AS (SELECT set_id, i, j, p{n} AS p, CASE WHEN p{n} IN (3, 4) THEN 'H' WHEN p{n} IN (1, 2) THEN 'V' END AS ax, (p{n} IN (1, 3)) <> CASE WHEN p{n} IN (3, 4) THEN h_reversed ELSE v_reversed END AS lo1,
  CASE WHEN p{n} IN (3, 4) THEN h_intersect ELSE v_intersect END AS shared, CASE WHEN p{n} IN (3, 4) THEN ph ELSE pw END AS dim FROM w WHERE p{n} IS NOT NULL),
e{n} AS (SELECT q.*, st.step, CASE WHEN lo1 THEN a.lo ELSE a.hi END AS n1, CASE WHEN lo1 THEN a.c0 ELSE a.cn END AS c1, CASE WHEN lo1 THEN b.hi ELSE b.lo END AS n2, CASE WHEN lo1 THEN b.cn ELSE b.c0 END AS c2
  FROM q{n} q LEFT JOIN ex a ON a.set_id = q.set_id AND a.page_idx = q.i AND a.axis = q.ax LEFT JOIN ex b ON b.set_id = q.set_id AND b.page_idx = q.j AND b.axis = q.ax LEFT JOIN ms st ON st.set_id = q.set_id AND st.axis = q.ax),
r{n} AS (SELECT e.set_id, e.i, e.j, CAST(p AS INT) AS p FROM e{n} e LEFT JOIN nr x ON x.set_id = e.set_id AND x.axis = e.ax AND x.name = e.n1 LEFT JOIN nr y ON y.set_id = e.set_id AND y.axis = e.ax AND y.name = e.n2
  WHERE p = 0 OR shared > 0 OR (step >= 0 AND c1 + dim - c2 >= TRUNC(ABS(x.idx - y.idx) * step)))"""


_PLACED = (
    *_ORDER,
    _STATS,
    _AXES,
    _INDEX,
    _STEP,
    f"""w AS (SELECT pu.*, {_side('axis_code')} AS p1, CASE WHEN use_secondary THEN {_side('1 - axis_code')} END AS p2, cx1 - cx0 AS pw, cy1 - cy0 AS ph FROM pu JOIN crops c ON c.set_id = pu.set_id AND c.page_idx = pu.j),
nr AS (SELECT set_id, axis, ROW(l, n, d) AS name, idx FROM ni)""",
    _acceptable(1),
    _acceptable(2),
    """rp AS (SELECT set_id, i, j, r1.p AS "primary", r2.p AS secondary FROM r1 FULL JOIN r2 USING (set_id, i, j))""",
)


def _placed(s: SparkSession, d: str) -> DataFrame:
    return ordering.pages_relative_placement(named_lines(s, d), crops(s, d))


@query(ask("SELECT * FROM rp", *_PLACED))
def o8_pages_relative_placement(s: SparkSession, d: str) -> DataFrame:
    return _placed(s, d)


@query(ask("SELECT w.set_id, w.i, w.j, r1.p AS placement FROM w LEFT JOIN r1 USING (set_id, i, j)", *_PLACED))
def o7_acceptable_placement(s: SparkSession, d: str) -> DataFrame:
    """Sides of page j next to page i, null where the pages lie too far apart."""
    named = named_lines(s, d)
    rows = ordering.placement_axis(ordering.pair_order_stats(named)).withColumn("placement", ordering.relative_placement(F.col("axis_code")))
    return ordering.acceptable_placement(rows, named, crops(s, d), "placement").select("set_id", "i", "j", F.col("placement").cast("int").alias("placement"))


_FACING = "CASE {0} WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 0 END"
_ALLOWED = f"""sd AS (SELECT set_id, i, j, "primary" AS a FROM rp WHERE "primary" IS NOT NULL UNION ALL SELECT set_id, i, j, secondary FROM rp WHERE secondary IS NOT NULL),
al AS (SELECT set_id, i, j, a AS stripe_i, {_FACING.format('a')} AS stripe_j FROM sd UNION SELECT set_id, j, i, {_FACING.format('a')}, a FROM sd)"""


@query(ask("SELECT * FROM al", *_PLACED, _ALLOWED))
def o9_stripes_for_placement(s: SparkSession, d: str) -> DataFrame:
    return ordering.stripes_for_placement(_placed(s, d))[1]


@query(ask("SELECT DISTINCT set_id, i AS page_idx, stripe_i AS stripe FROM al", *_PLACED, _ALLOWED))
def r5_needed_subimages(s: SparkSession, d: str) -> DataFrame:
    return raster.needed_subimages(view(s, d, "pages"), ordering.stripes_for_placement(_placed(s, d))[0])


_CANDIDATES = """pc AS (SELECT a.set_id, a.page_idx AS i, b.page_idx AS j, rp.i IS NOT NULL AS placed FROM pages a JOIN pages b ON a.set_id = b.set_id AND a.page_idx < b.page_idx LEFT JOIN rp ON rp.set_id = a.set_id AND rp.i = a.page_idx AND rp.j = b.page_idx
  WHERE rp.i IS NOT NULL OR NOT EXISTS (SELECT 1 FROM gl WHERE gl.set_id = a.set_id AND gl.page_idx = a.page_idx) OR NOT EXISTS (SELECT 1 FROM gl WHERE gl.set_id = a.set_id AND gl.page_idx = b.page_idx))"""
_SOME = "gl AS (SELECT DISTINCT set_id, page_idx FROM grid_lines)"


def _pair_candidates(s: SparkSession, d: str) -> DataFrame:
    return match.page_pair_candidates(view(s, d, "pages"), _placed(s, d), view(s, d, "grid_lines"))


@query(ask("SELECT * FROM pc", *_PLACED, _SOME, _CANDIDATES))
def j4_page_pair_candidates(s: SparkSession, d: str) -> DataFrame:
    return _pair_candidates(s, d)


@query(ask("SELECT pc.set_id, pc.i, pc.j, a.k AS stripe_i, b.k AS stripe_j FROM pc CROSS JOIN (VALUES (1), (2), (3), (4)) a(k) CROSS JOIN (VALUES (1), (2), (3), (4)) b(k) LEFT JOIN al ON al.set_id = pc.set_id AND al.i = pc.i AND al.j = pc.j AND al.stripe_i = a.k AND al.stripe_j = b.k WHERE NOT placed OR al.i IS NOT NULL", *_PLACED, _SOME, _CANDIDATES, _ALLOWED))
def j5_stripe_pair_candidates(s: SparkSession, d: str) -> DataFrame:
    placed = _placed(s, d)
    pairs = match.page_pair_candidates(view(s, d, "pages"), placed, view(s, d, "grid_lines"))
    return match.stripe_pair_candidates(pairs, ordering.stripes_for_placement(placed)[1])


_KNN = """kn AS (SELECT a.set_id, 0 AS i, 1 AS j, 2 AS stripe_i, 1 AS stripe_j, a.kp_id AS kp_i, b.kp_id AS kp_j, list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS dist FROM descriptors a JOIN descriptors b ON a.set_id = b.set_id AND a.page_idx = 0 AND b.page_idx = 1),
k2 AS (SELECT *, ROW_NUMBER() OVER w AS r, LEAD(dist) OVER w AS dist2 FROM kn WINDOW w AS (PARTITION BY set_id, kp_i ORDER BY dist, kp_j)),
mt AS (SELECT * EXCLUDE (r, dist2) FROM k2 WHERE r = 1 AND dist2 IS NOT NULL AND dist < 0.7e0 * dist2)"""


def _matches(s: SparkSession, d: str) -> DataFrame:
    descriptors = view(s, d, "descriptors")
    wanted = descriptors.select("set_id").distinct().select("set_id", *[F.lit(v).alias(n) for n, v in (("i", 0), ("j", 1), ("stripe_i", 2), ("stripe_j", 1))])
    return match.knn_ratio_match(descriptors, wanted)


@query(ask("SELECT set_id, i, j, stripe_i, stripe_j, kp_i, kp_j, ROUND(dist, 5) AS dist FROM mt", _KNN))
def j6_knn_ratio_match(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).select("set_id", "i", "j", "stripe_i", "stripe_j", "kp_i", "kp_j", F.round("dist", 5).alias("dist"))


@query(ask("SELECT set_id, i, j, stripe_i, stripe_j, COUNT(*) AS matches, ROUND(CASE WHEN COUNT(*) > 1 THEN MEDIAN(dist) ELSE 0 END, 4) AS median_dist, ROUND(CASE WHEN COUNT(*) > 1 THEN AVG(dist) ELSE 0 END, 4) AS avg_dist, ROUND(CASE WHEN COUNT(*) > 1 THEN SUM(dist) ELSE 0 END, 4) AS total_dist FROM mt GROUP BY ALL", _KNN))
def j7_match_distance_stats(s: SparkSession, d: str) -> DataFrame:
    return match.match_distance_stats(_matches(s, d)).withColumns({c: F.round(c, 4) for c in ("median_dist", "avg_dist", "total_dist")})


@query(ask("SELECT set_id, page_idx, line_ord, text FROM grid_lines g WHERE EXISTS (SELECT 1 FROM overall_lines o WHERE o.set_id = g.set_id AND o.text = g.text)"))
def j8_shared_labels(s: SparkSession, d: str) -> DataFrame:
    return points.shared_labels(view(s, d, "grid_lines"), view(s, d, "overall_lines")).select("set_id", "page_idx", "line_ord", "text")


@query(ask("SELECT set_id, i, j, round_even(AVG(x - to_x), 0) + 0 AS tx, round_even(AVG(y - to_y), 0) + 0 AS ty FROM matched GROUP BY ALL", ORIENTED, UNIQUE, CROPS, POINTS))
def t4_mean_translation(s: SparkSession, d: str) -> DataFrame:
    rows = shared_points(s, d).withColumns({"stripe_i": F.lit(0), "stripe_j": F.lit(0)})
    return match.mean_translation(rows).select("set_id", "i", "j", (F.col("tx") + 0.0).alias("tx"), (F.col("ty") + 0.0).alias("ty"))


#: Candidates of page pairs, made from page numbers in both engines.
CAND = """cand AS (SELECT p.set_id, p.page_idx AS i, q.page_idx AS j, CAST(1 + a.k AS INT) AS stripe_i, CAST(1 + b.k AS INT) AS stripe_j,
  8 + (p.set_id * 7 + p.page_idx * 3 + q.page_idx * 5 + a.k * 11 + b.k * 13) % 90 AS matches, 1 + (p.set_id + p.page_idx * 17 + q.page_idx * 29 + a.k * 7 + b.k * 3) % 60 AS inliers0,
  ((p.set_id + a.k * 5 + b.k) % 9) * 1e0 AS rot, ((p.set_id * 3 + a.k * 700 + b.k * 90) % 2900) * 1e0 AS tx, ((p.set_id + q.page_idx * 311 + b.k * 77) % 400) * 1e0 AS ty, p.width AS wi, p.height AS hi, q.width AS wj, q.height AS hj
  FROM pages p JOIN pages q ON p.set_id = q.set_id AND p.page_idx < q.page_idx JOIN k a ON a.k < 4 JOIN k b ON b.k < 4),
c0 AS (SELECT * EXCEPT (inliers0), LEAST(inliers0, matches) AS inliers FROM cand)"""
_CAND_SQL = CAND.replace("* EXCEPT (inliers0)", "* EXCLUDE (inliers0)")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    view(s, d, "pages")  # registers the base tables
    return s.sql(f"{FIXTURE}, {CAND} SELECT * FROM c0")


_SCORE = (
    _CAND_SQL,
    """c1 AS (SELECT *, ABS(rot) > 5 AND ABS(ABS(rot) - PI() / 2) > 5 AS rotated FROM c0),
c2 AS (SELECT *, (LOG2(inliers) + 5e0 * inliers / matches) / CASE WHEN rotated THEN 1.5e0 ELSE 1e0 END AS score FROM c1),
c3 AS (SELECT *, MAX(inliers) OVER (PARTITION BY set_id, i, j) AS best, GREATEST(0, LEAST(wi, wj + tx) - GREATEST(0, tx)) AS iw, GREATEST(0, LEAST(hi, hj + ty) - GREATEST(0, ty)) AS ih FROM c2 WHERE matches >= 10),
c4 AS (SELECT * FROM c3 WHERE inliers >= 6 AND inliers >= 0.2e0 * matches AND inliers >= 0.7e0 * best AND iw * ih / (wi * hi) <= 0.45 AND GREATEST(iw / wi, ih / hi) >= 0.35),
c5 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id, i, j ORDER BY inliers DESC, stripe_i, stripe_j) - 1 AS place FROM c4) WHERE place < 3),
c6 AS (SELECT * FROM (SELECT *, BOOL_OR(NOT rotated) OVER (PARTITION BY set_id, i, j) AS s FROM c5) WHERE NOT (s AND rotated)),
c7 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id, i, j ORDER BY place) AS r FROM c6) WHERE r = 1)""",
)
_KEYS = "set_id, i, j, stripe_i, stripe_j"


def _keys(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("set_id", "i", "j", "stripe_i", "stripe_j", *more)


@query(ask(f"SELECT {_KEYS}, ROUND(score, 6) AS score, rotated FROM c2", *_SCORE))
def t5_score_keypoint_candidates(s: SparkSession, d: str) -> DataFrame:
    return _keys(match.score_keypoint_candidates(_candidates(s, d)).withColumn("score", F.round("score", 6)), "score", "rotated")


def _gated(s: SparkSession, d: str) -> DataFrame:
    return match.gate_keypoint_candidates(match.score_keypoint_candidates(_candidates(s, d)))


@query(ask("SELECT set_id, i, j, CAST(2400 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty, stripe_i, stripe_j, ROUND(LOG2(COUNT(*)) + 5, 6) AS score FROM mt GROUP BY ALL HAVING COUNT(*) >= 10", _KNN))
def t5_keypoint_transforms(s: SparkSession, d: str) -> DataFrame:
    """From descriptors to scored transforms; keypoints that match lie 2400 apart, so all agree and none is turned."""
    points = view(s, d, "descriptors")
    whole = points.select("set_id", "page_idx").distinct().select("*", *[F.lit(v).cast("long").alias(c) for c, v in (("cx0", 0), ("cy0", 0), ("cx1", 3000), ("cy1", 2000))])
    wanted = points.select("set_id").distinct().select("set_id", *[F.lit(v).alias(n) for n, v in (("i", 0), ("j", 1), ("stripe_i", 2), ("stripe_j", 1))])
    found = keypoints.keypoint_transforms(points, wanted, whole)
    return _keys(found, *[(F.col(c) + 0.0).alias(c) for c in ("tx", "ty")], F.round("score", 6).alias("score"))


@query(ask(f"SELECT {_KEYS}, inliers FROM c4", *_SCORE))
def t6_gate_keypoint_candidates(s: SparkSession, d: str) -> DataFrame:
    return _keys(_gated(s, d), "inliers")


@query(ask(f"SELECT {_KEYS}, CAST(place AS INT) AS place FROM c5", *_SCORE))
def t7_top_candidates(s: SparkSession, d: str) -> DataFrame:
    return _keys(match.top_candidates(_gated(s, d)), "place")


@query(ask(f"SELECT {_KEYS}, CAST(place AS INT) AS place, rotated FROM c6", *_SCORE))
def t8_drop_rotated_if_straight_exists(s: SparkSession, d: str) -> DataFrame:
    return _keys(match.drop_rotated_if_straight_exists(match.top_candidates(_gated(s, d))), "place", "rotated")


def _chosen(s: SparkSession, d: str, striped: bool) -> DataFrame:
    gated = match.drop_rotated_if_straight_exists(match.top_candidates(_gated(s, d)))
    return match.best_pair_transform(gated, _candidates(s, d), striped=striped, matches_against_median_threshold=0.8)


@query(ask(f"SELECT {_KEYS}, c7.matches FROM c7 JOIN md USING (set_id) WHERE c7.matches >= 0.8e0 * m AND inliers >= 0.2e0 * c7.matches", *_SCORE, "md AS (SELECT set_id, MEDIAN(COALESCE(c7.matches, 0)) AS m FROM (SELECT DISTINCT set_id, i, j FROM c0) q LEFT JOIN c7 USING (set_id, i, j) GROUP BY set_id)"))
def t9_best_pair_transform(s: SparkSession, d: str) -> DataFrame:
    return _keys(_chosen(s, d, striped=False), "matches")


@query(
    ask(
        """SELECT set_id, i, j, ROUND(tx, 6) + 0 AS tx, stripe_i, stripe_j, ROUND(score, 6) AS score FROM (SELECT set_id, j AS i, i AS j, tx, -1 AS stripe_i, -1 AS stripe_j, score + 100 AS score FROM pairs WHERE set_id IN (SELECT set_id FROM c7)
  UNION ALL SELECT set_id, i, j, tx, stripe_i, stripe_j, score FROM c7 WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.set_id = c7.set_id AND p.i = c7.i AND p.j = c7.j))""",
        ORIENTED,
        UNIQUE,
        CROPS,
        POINTS,
        FITS,
        *_SCORE,
    )
)
def j11_combine_grid_and_keypoint(s: SparkSession, d: str) -> DataFrame:
    grid = fit.pair_grid_transforms(shared_points(s, d), crops(s, d))
    keypoint = _chosen(s, d, striped=True).withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(1.0)})
    rows = match.combine_grid_and_keypoint(grid, keypoint)
    return rows.select("set_id", "i", "j", (F.round("tx", 6) + 0.0).alias("tx"), "stripe_i", "stripe_j", F.round("score", 6).alias("score"))


@query(ask("SELECT set_id, page_idx, 'no_matches' AS reason FROM pages g WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.set_id = g.set_id AND p.i = g.page_idx)", ORIENTED, UNIQUE, CROPS, POINTS, FITS))
def j12_missing_pages(s: SparkSession, d: str) -> DataFrame:
    return match.missing_pages(view(s, d, "pages"), fit.pair_grid_transforms(shared_points(s, d), crops(s, d)))


_CENTER = "(bx0 + bx1) // 2 AS x_center, (by0 + by1) // 2 AS y_center, ABS(bx0 - bx1) // 2 AS x_radius, ABS(by0 - by1) // 2 AS y_radius"
_ROT = "rot AS (SELECT set_id, CAST(COALESCE(MIN(CASE WHEN rotation <> 0 THEN rotation END), 0) AS INT) AS set_rotation FROM pages GROUP BY set_id)"


def _turn(x: str, y: str) -> tuple[str, str]:
    return f"CASE set_rotation WHEN 90 THEN {y} WHEN 180 THEN w - {x} WHEN 270 THEN w - {y} ELSE {x} END", f"CASE set_rotation WHEN 90 THEN h - {x} WHEN 180 THEN h - {y} WHEN 270 THEN {x} ELSE {y} END"


@query(
    ask(
        "SELECT set_id, page_idx, line_ord, "
        + ", ".join(f"{e} AS {n}" for xy in (("x_center", "y_center"), ("gx0", "gy0"), ("gx1", "gy1")) for n, e in zip(xy, _turn(*xy)))
        + ", CASE WHEN set_rotation IN (90, 270) THEN y_radius ELSE x_radius END AS x_radius, CASE WHEN set_rotation IN (90, 270) THEN x_radius ELSE y_radius END AS y_radius FROM r0",
        _ROT,
        f"r0 AS (SELECT l.set_id, l.page_idx, line_ord, gx0, gy0, gx1, gy1, {_CENTER}, set_rotation, CASE WHEN rotation <> set_rotation AND set_rotation IN (90, 270) THEN height ELSE width END AS w, CASE WHEN rotation <> set_rotation AND set_rotation IN (90, 270) THEN width ELSE height END AS h FROM grid_lines l JOIN pages USING (set_id, page_idx) JOIN rot ON rot.set_id = l.set_id)",
    )
)
def a1_rotate_grids(s: SparkSession, d: str) -> DataFrame:
    pages = view(s, d, "pages")
    rows = anchor.rotate_grids(clean.add_label_center(view(s, d, "grid_lines")), pages, clean.pick_set_rotation(pages))
    return rows.select("set_id", "page_idx", "line_ord", "x_center", "y_center", "gx0", "gy0", "gx1", "gy1", "x_radius", "y_radius")


def _page_lines(s: SparkSession, d: str) -> DataFrame:
    """Cleaned straight lines with centres; sets are taken as unrotated."""
    return clean.add_label_center(clean.keep_straight_lines(clean.clean_grid_lines(view(s, d, "grid_lines"))))


def _overall(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "overall_lines").withColumn("line_ord", F.lit(0))
    return clean.add_label_center(clean.keep_straight_lines(rows))


def _widest(s: SparkSession, d: str) -> DataFrame:
    return anchor.widest_adjacent_pair(points.shared_labels(_page_lines(s, d), _overall(s, d)))


_WIDEST = f"""pl AS (SELECT *, {_CENTER}, CASE WHEN gy0 = gy1 THEN 'horizontal' ELSE 'vertical' END AS line_type FROM cleaned WHERE gy0 = gy1 OR gx0 = gx1),
sh AS (SELECT *, COUNT(*) FILTER (WHERE line_type = 'vertical') OVER (PARTITION BY set_id, page_idx) AS nv FROM pl WHERE EXISTS (SELECT 1 FROM overall_lines o WHERE o.set_id = pl.set_id AND o.text = pl.text)),
sw AS (SELECT set_id, page_idx, line_type, text, CASE WHEN line_type = 'vertical' THEN x_center ELSE y_center END AS c, line_ord, CASE WHEN line_type = 'vertical' THEN gx0 ELSE gy0 END AS att FROM sh WHERE (nv >= 2) = (line_type = 'vertical')),
sx AS (SELECT *, LEAD(text) OVER w AS text_b, ABS(LEAD(att) OVER w - att) AS gap, ROW_NUMBER() OVER w AS pos FROM sw WINDOW w AS (PARTITION BY set_id, page_idx ORDER BY c, line_ord)),
wide AS (SELECT set_id, page_idx, text AS text_a, text_b, gap, line_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id, page_idx ORDER BY gap DESC, pos) AS r FROM sx WHERE text_b IS NOT NULL) WHERE r = 1),
psc AS (SELECT set_id, page_idx, scale FROM (SELECT w.set_id, w.page_idx, gap / NULLIF(CASE WHEN line_type = 'vertical' THEN ABS(a.gx0 - b.gx0) ELSE ABS(a.gy0 - b.gy0) END, 0) AS scale FROM wide w JOIN overall_lines a ON a.set_id = w.set_id AND a.text = w.text_a JOIN overall_lines b ON b.set_id = w.set_id AND b.text = w.text_b) WHERE scale IS NOT NULL),
cs AS (SELECT set_id, scale, COUNT(*) AS n, MIN(page_idx) AS att FROM psc WHERE scale > 1 GROUP BY ALL),
ct AS (SELECT *, FIRST_VALUE(scale) OVER (PARTITION BY set_id ORDER BY n DESC, att) AS mode FROM cs),
scl AS (SELECT c.set_id, CASE WHEN COUNT(*) FILTER (WHERE n = mode) > 1 THEN ANY_VALUE(m) ELSE ANY_VALUE(mode) END AS scale FROM ct c JOIN (SELECT set_id, MEDIAN(scale) AS m FROM psc WHERE scale > 1 GROUP BY 1) q ON q.set_id = c.set_id GROUP BY c.set_id)"""


@query(ask("SELECT * FROM wide", ORIENTED, UNIQUE, _WIDEST))
def a2_widest_adjacent_pair(s: SparkSession, d: str) -> DataFrame:
    return _widest(s, d)


@query(ask("SELECT set_id, page_idx, ROUND(scale, 9) AS scale FROM psc", ORIENTED, UNIQUE, _WIDEST))
def a3_page_scale(s: SparkSession, d: str) -> DataFrame:
    return anchor.page_scale(_widest(s, d), _overall(s, d)).withColumn("scale", F.round("scale", 9))


def _scales(s: SparkSession, d: str) -> DataFrame:
    return anchor.select_scale(anchor.page_scale(_widest(s, d), _overall(s, d)))


@query(ask("SELECT set_id, ROUND(scale, 9) AS scale FROM scl", ORIENTED, UNIQUE, _WIDEST))
def a4_select_scale(s: SparkSession, d: str) -> DataFrame:
    return _scales(s, d).withColumn("scale", F.round("scale", 9))


def _plan_pages(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "pages").select("set_id", F.lit(4000).cast("long").alias("width"), F.lit(4000).cast("long").alias("height"), F.lit(0).alias("rotation")).distinct()


def _plan_crops(s: SparkSession, d: str) -> DataFrame:
    return bounds.grid_crop_area(_overall(s, d), _plan_pages(s, d), ["set_id"])


def _scaled_overall(s: SparkSession, d: str) -> DataFrame:
    return anchor.scale_lines(anchor.crop_lines(_overall(s, d), _plan_crops(s, d), ["set_id"]), _scales(s, d))


_PLAN = f"""oc AS (SELECT *, {_CENTER} FROM overall_lines),
ob AS (SELECT set_id, GREATEST(0, MIN(LEAST(x_center - x_radius, gx0, gx1))) AS cx0, GREATEST(0, MIN(LEAST(y_center - y_radius, gy0, gy1))) AS cy0, LEAST(4000, MAX(GREATEST(x_center + x_radius, gx0, gx1))) AS cx1, LEAST(4000, MAX(GREATEST(y_center + y_radius, gy0, gy1))) AS cy1 FROM oc GROUP BY 1),
sl AS (SELECT o.set_id, o.text, {', '.join(f"CAST(round_even(({c} - {'cx0' if 'x' in c else 'cy0'}) * scale, 0) AS BIGINT) AS {c}" for c in ('x_center', 'y_center', 'gx0', 'gy0', 'gx1', 'gy1'))} FROM oc o JOIN ob USING (set_id) JOIN scl USING (set_id))"""


@query(ask("SELECT * FROM sl", ORIENTED, UNIQUE, _WIDEST, _PLAN))
def a5_scale_lines(s: SparkSession, d: str) -> DataFrame:
    return _scaled_overall(s, d).select("set_id", "text", "x_center", "y_center", "gx0", "gy0", "gx1", "gy1")


@query(ask("SELECT set_id, CAST(round_even(scale * (cx1 - cx0), 0) AS BIGINT) AS canvas_w, CAST(round_even(scale * (cy1 - cy0), 0) AS BIGINT) AS canvas_h FROM ob JOIN scl USING (set_id)", ORIENTED, UNIQUE, _WIDEST, _PLAN))
def a6_canvas_size(s: SparkSession, d: str) -> DataFrame:
    return anchor.canvas_size(_plan_crops(s, d), _scales(s, d))


def _hv_points(s: SparkSession, d: str) -> DataFrame:
    return points.page_hv_points(points.shared_labels(_page_lines(s, d), _overall(s, d)))


def _anchors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages with the lines that their plan has too, and the plans' crops and scales."""
    pages = anchor.anchor_pages(_page_lines(s, d), _overall(s, d))
    return pages, _plan_crops(s, d).join(anchor.select_scale(anchor.array_scales(pages)), "set_id").select("set_id", "cx0", "cy0", "scale")


_MEET = "CASE WHEN ({h}.gx0 <= {v}.gx0 - 1 AND {v}.gx0 - 1 <= {h}.gx1 OR {h}.gx0 <= {v}.gx0 + 1 AND {v}.gx0 + 1 <= {h}.gx1) AND ({v}.gy0 <= {h}.gy0 - 1 AND {h}.gy0 - 1 <= {v}.gy1 OR {v}.gy0 <= {h}.gy0 + 1 AND {h}.gy0 + 1 <= {v}.gy1) THEN true ELSE false END"
_HV = f"""hp AS (SELECT h.set_id, h.page_idx, h.text AS text_h, v.text AS text_v, v.gx0 AS x, h.gy0 AS y FROM sh h JOIN sh v ON h.set_id = v.set_id AND h.page_idx = v.page_idx AND h.line_type = 'horizontal' AND v.line_type = 'vertical' WHERE {_MEET.format(h='h', v='v')}),
op AS (SELECT p.set_id, p.page_idx, p.text_h, p.text_v, v.gx0 AS ax, h.gy0 AS ay FROM hp p JOIN sl h ON h.set_id = p.set_id AND h.text = p.text_h JOIN sl v ON v.set_id = p.set_id AND v.text = p.text_v WHERE {_MEET.format(h='h', v='v')}),
nc AS (SELECT set_id, text_h, text_v, COUNT(*) AS n FROM hp GROUP BY ALL),
cm AS (SELECT set_id, text_h, text_v FROM (SELECT *, MAX(n) OVER (PARTITION BY set_id) AS most FROM nc) WHERE n = most),
us AS (SELECT u.* EXCLUDE (c, hc) FROM (SELECT *, BOOL_OR(c) OVER (PARTITION BY set_id, page_idx) AS hc FROM (SELECT p.*, ax, ay, cm.set_id IS NOT NULL AS c FROM hp p JOIN op USING (set_id, page_idx, text_h, text_v) LEFT JOIN cm ON cm.set_id = p.set_id AND cm.text_h = p.text_h AND cm.text_v = p.text_v)) u WHERE c OR NOT hc)"""
_ANCHORED = (ORIENTED, UNIQUE, _WIDEST, _PLAN, _HV)


@query(ask("SELECT * FROM hp", *_ANCHORED))
def j9_page_hv_points(s: SparkSession, d: str) -> DataFrame:
    return _hv_points(s, d)


@query(ask("SELECT * FROM op", *_ANCHORED))
def j10_overall_points(s: SparkSession, d: str) -> DataFrame:
    return anchor.plan_points(*_anchors(s, d)).select("set_id", "page_idx", "text_h", "text_v", "ax", "ay")


@query(ask("SELECT * FROM cm", *_ANCHORED))
def a7_common_label_pairs(s: SparkSession, d: str) -> DataFrame:
    return anchor.common_label_pairs(_hv_points(s, d), view(s, d, "pages"))


def _usable(s: SparkSession, d: str) -> DataFrame:
    return anchor.usable_points(*_anchors(s, d), view(s, d, "pages"))


@query(ask("SELECT * FROM us", *_ANCHORED))
def a8_usable_anchor_pairs(s: SparkSession, d: str) -> DataFrame:
    return _usable(s, d)


#: The pairs of each page one after the other, with the labels that were taken before.
_GREEDY = """ur AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id, page_idx ORDER BY text_h, text_v) AS rk FROM us),
gr AS (SELECT set_id, page_idx, rk, true AS taken, [text_h, text_v] AS seen FROM ur WHERE rk = 1
  UNION ALL SELECT u.set_id, u.page_idx, u.rk, NOT (list_contains(seen, u.text_h) OR list_contains(seen, u.text_v)), CASE WHEN list_contains(seen, u.text_h) OR list_contains(seen, u.text_v) THEN seen ELSE list_concat(seen, [u.text_h, u.text_v]) END
  FROM gr JOIN ur u ON u.set_id = gr.set_id AND u.page_idx = gr.page_idx AND u.rk = gr.rk + 1),
dj AS (SELECT set_id, page_idx, text_h, text_v, x, y, ax, ay FROM ur JOIN gr USING (set_id, page_idx, rk) WHERE taken)"""


@query(ask_recursive("SELECT * FROM dj", *_ANCHORED, _GREEDY))
def a8_disjoint_anchor_pairs(s: SparkSession, d: str) -> DataFrame:
    return anchor.disjoint_anchor_pairs(_usable(s, d))


#: The plans stand upright, so nothing turns; sheets are cropped to their lines.
_SHEETS = """gc AS (SELECT p.set_id, p.page_idx, LEAST(GREATEST(MIN(LEAST(x_center - x_radius, gx0, gx1)), 0), ANY_VALUE(width)) AS gcx0, LEAST(GREATEST(MIN(LEAST(y_center - y_radius, gy0, gy1)), 0), ANY_VALUE(height)) AS gcy0,
  LEAST(MAX(GREATEST(x_center + x_radius, gx0, gx1)), ANY_VALUE(width)) AS gcx1, LEAST(MAX(GREATEST(y_center + y_radius, gy0, gy1)), ANY_VALUE(height)) AS gcy1 FROM pl JOIN pages p USING (set_id, page_idx) GROUP BY ALL),
rc AS (SELECT set_id, page_idx, CAST(ax - (x - gcx0) AS DOUBLE) AS x0, CAST(ay - (y - gcy0) AS DOUBLE) AS y0, gcx1 - gcx0 AS w, gcy1 - gcy0 AS h FROM dj JOIN gc USING (set_id, page_idx)),
rn AS (SELECT set_id, page_idx, x0, y0, w, h, COUNT(*) AS n FROM rc GROUP BY ALL),
rm AS (SELECT *, MAX(n) OVER p AS most, SUM(x0 * n) OVER p / SUM(n) OVER p AS mx0, SUM(y0 * n) OVER p / SUM(n) OVER p AS my0 FROM rn WINDOW p AS (PARTITION BY set_id, page_idx)),
rv AS (SELECT set_id, page_idx, w, h, CASE WHEN COUNT(*) > 1 THEN ANY_VALUE(mx0) ELSE ANY_VALUE(x0) END AS x0, CASE WHEN COUNT(*) > 1 THEN ANY_VALUE(my0) ELSE ANY_VALUE(y0) END AS y0 FROM rm WHERE n = most GROUP BY set_id, page_idx, w, h)"""


@query(ask_recursive("SELECT set_id, page_idx, ROUND(x0, 6) AS x0, ROUND(y0, 6) AS y0, ROUND(x0 + w, 6) AS x1, ROUND(y0 + h, 6) AS y1 FROM rv", ORIENTED, UNIQUE, _WIDEST.replace("FROM cleaned", "FROM oriented"), _PLAN, _HV, _GREEDY, _SHEETS))
def w3_anchor_to_overall(s: SparkSession, d: str) -> DataFrame:
    """Every sheet's rectangle on its set's scaled overall plan."""
    overall = view(s, d, "overall_lines").withColumn("line_ord", F.lit(0))
    rects = anchored.anchor_sheets(view(s, d, "pages"), view(s, d, "grid_lines"), overall, _plan_pages(s, d))[0]
    return rects.select("set_id", "page_idx", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(None)
def w2_place_with_keypoints(s: SparkSession, d: str) -> DataFrame:
    """Every sheet on its canvas, where the second page of every set with keypoints has no grid lines."""
    descriptors = view(s, d, "descriptors")
    known = descriptors.select("set_id").distinct().withColumn("page_idx", F.lit(1))
    lines = view(s, d, "grid_lines").join(known, ["set_id", "page_idx"], "left_anti")
    relations = _placed(s, d)
    pairs = match.page_pair_candidates(view(s, d, "pages"), relations, lines)
    compared = match.stripe_pair_candidates(pairs, ordering.stripes_for_placement(relations)[1])
    placed, canvases = keypoints.place_sheets(view(s, d, "pages"), lines, view(s, d, "segments"), descriptors, compared)
    return placed.join(canvases, "set_id").select("set_id", "page_idx", "rx0", "ry0", "rx1", "ry1", "canvas_w", "canvas_h")


@query(
    ask(
        "SELECT set_id, page_idx, CASE WHEN ties > 1 THEN mx0 ELSE x0 END AS x0, CASE WHEN ties > 1 THEN my0 ELSE y0 END AS y0 FROM (SELECT *, COUNT(*) FILTER (WHERE n = most) OVER (PARTITION BY set_id, page_idx) AS ties, ROW_NUMBER() OVER (PARTITION BY set_id, page_idx ORDER BY n DESC) AS r FROM (SELECT *, MAX(n) OVER (PARTITION BY set_id, page_idx) AS most, SUM(x0 * n) OVER (PARTITION BY set_id, page_idx) / SUM(n) OVER (PARTITION BY set_id, page_idx) AS mx0, SUM(y0 * n) OVER (PARTITION BY set_id, page_idx) / SUM(n) OVER (PARTITION BY set_id, page_idx) AS my0 FROM (SELECT set_id, page_idx, CAST(ax - x AS DOUBLE) AS x0, CAST(ay - y AS DOUBLE) AS y0, COUNT(*) AS n FROM us GROUP BY ALL))) WHERE r = 1",
        *_ANCHORED,
    )
)
def a9_page_rect_vote(s: SparkSession, d: str) -> DataFrame:
    """Over all usable pairs, so that SQL can check the vote."""
    sizes = view(s, d, "pages").select("set_id", "page_idx", F.col("width").alias("w"), F.col("height").alias("h"))
    return anchor.page_rect_vote(_usable(s, d), sizes).select("set_id", "page_idx", "x0", "y0")
