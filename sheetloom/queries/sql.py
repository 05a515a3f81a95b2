"""Common table expressions of the oracle, each written from the operator's definition."""

from __future__ import annotations

from .fixture import FIXTURE, RECURSIVE

ORIENTED = """
o1 AS (SELECT *, ABS(gx0 - gx1) AS dx, ABS(gy0 - gy1) AS dy FROM grid_lines),
o2 AS (SELECT *, CASE WHEN dx < dy THEN gy0 > gy1 ELSE gx0 > gx1 END AS sw FROM o1),
o3 AS (SELECT set_id, page_idx, line_ord AS old, text, bx0, by0, bx1, by1, dx, dy,
  CASE WHEN sw THEN gx1 ELSE gx0 END AS gx0, CASE WHEN sw THEN gy1 ELSE gy0 END AS gy0,
  CASE WHEN sw THEN gx0 ELSE gx1 END AS gx1, CASE WHEN sw THEN gy0 ELSE gy1 END AS gy1 FROM o2),
oriented AS (SELECT set_id, page_idx, CAST(ROW_NUMBER() OVER (PARTITION BY set_id, page_idx ORDER BY CASE WHEN dx > dy THEN gx0 ELSE gy0 END, old) - 1 AS INT) AS line_ord,
  text, bx0, by0, bx1, by1, gx0, gy0, gx1, gy1 FROM o3)"""
UNIQUE = """
u1 AS (SELECT *, COUNT(*) OVER (PARTITION BY set_id, page_idx, LOWER(TRIM(text))) AS n FROM oriented),
uniq AS (SELECT * EXCLUDE (n) FROM u1 WHERE n = 1),
cleaned AS (SELECT * FROM uniq WHERE GREATEST(ABS(gx0 - gx1), ABS(gy0 - gy1)) >= 100)"""
CROPS = """
b1 AS (SELECT set_id, page_idx, MIN(LEAST(bx0, bx1, gx0, gx1)) AS px0, MIN(LEAST(by0, by1, gy0, gy1)) AS py0, MAX(GREATEST(bx0, bx1)) AS px1, MAX(GREATEST(by0, by1, gy0, gy1)) AS py1 FROM oriented GROUP BY ALL),
pb AS (SELECT p.set_id, p.page_idx, px0, py0, px1, py1, COALESCE((px1 - px0) * (py1 - py0) >= 0.5 * width * height, false) AS ok FROM pages p LEFT JOIN b1 USING (set_id, page_idx)),
pbounds AS (SELECT set_id, page_idx, CASE WHEN ok THEN px0 END AS px0, CASE WHEN ok THEN py0 END AS py0, CASE WHEN ok THEN px1 END AS px1, CASE WHEN ok THEN py1 END AS py1 FROM pb),
s1 AS (SELECT set_id, page_idx, COUNT(*) AS n, ANY_VALUE(x0) AS sx0, ANY_VALUE(y0) AS sy0, ANY_VALUE(x1) AS sx1, ANY_VALUE(y1) AS sy1 FROM segments GROUP BY ALL),
seg AS (SELECT s1.* EXCLUDE (n) FROM s1 JOIN pages USING (set_id, page_idx) WHERE n = 1 AND ABS((sx1 - sx0) * (sy1 - sy0)) >= 0.25 * width * height),
crops AS (SELECT p.set_id, p.page_idx,
  CAST(CASE WHEN sx0 IS NOT NULL THEN sx0 WHEN px0 IS NOT NULL THEN px0 ELSE 0 END AS BIGINT) AS cx0,
  CAST(CASE WHEN sx0 IS NOT NULL THEN sy0 WHEN px0 IS NOT NULL THEN py0 ELSE 0 END AS BIGINT) AS cy0,
  CAST(CASE WHEN sx0 IS NOT NULL THEN sx1 WHEN px0 IS NOT NULL THEN px1 ELSE width END AS BIGINT) AS cx1,
  CAST(CASE WHEN sx0 IS NOT NULL THEN sy1 WHEN px0 IS NOT NULL THEN py1 ELSE height END AS BIGINT) AS cy1
  FROM pages p LEFT JOIN seg USING (set_id, page_idx) LEFT JOIN pbounds USING (set_id, page_idx))"""
POINTS = """
ln AS (SELECT c.set_id, c.page_idx, text, gx0 - cx0 AS x, gy0 - cy0 AS y, gx0 = gx1 AS v FROM cleaned c JOIN crops USING (set_id, page_idx)),
pts AS (SELECT a.set_id, a.page_idx, a.text AS text_a, b.text AS text_b, CAST(CASE WHEN a.v THEN a.x ELSE b.x END AS DOUBLE) AS x, CAST(CASE WHEN a.v THEN b.y ELSE a.y END AS DOUBLE) AS y
  FROM ln a JOIN ln b ON a.set_id = b.set_id AND a.page_idx = b.page_idx AND a.text < b.text AND a.v <> b.v),
matched AS (SELECT a.set_id, a.page_idx AS i, b.page_idx AS j, a.text_a, a.text_b, a.x, a.y, b.x AS to_x, b.y AS to_y
  FROM pts a JOIN pts b ON a.set_id = b.set_id AND a.text_a = b.text_a AND a.text_b = b.text_b AND a.page_idx < b.page_idx)"""
FITS = """
fsum AS (SELECT set_id, i, j, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(to_x) AS su, SUM(to_y) AS sv,
  SUM(x * to_x + y * to_y) AS sd, SUM(x * to_y - y * to_x) AS sc, SUM(x * x + y * y) AS sq FROM matched GROUP BY ALL HAVING COUNT(*) >= 2),
fab AS (SELECT *, round_even((n * sd - sx * su - sy * sv) / NULLIF(n * sq - sx * sx - sy * sy, 0), 0) AS a, round_even((n * sc - sx * sv + sy * su) / NULLIF(n * sq - sx * sx - sy * sy, 0), 0) AS s FROM fsum),
fits AS (SELECT set_id, i, j, n, a, -s AS b, (su - a * sx + s * sy) / n AS tx, s AS c, a AS d, (sv - s * sx - a * sy) / n AS ty FROM fab WHERE a IS NOT NULL),
g1 AS (SELECT f.*, ci.cx1 - ci.cx0 AS wi, ci.cy1 - ci.cy0 AS hi, cj.cx1 - cj.cx0 AS wj, cj.cy1 - cj.cy0 AS hj FROM fits f
  JOIN crops ci ON ci.set_id = f.set_id AND ci.page_idx = f.i JOIN crops cj ON cj.set_id = f.set_id AND cj.page_idx = f.j),
g2 AS (SELECT *, GREATEST(0, LEAST(wi, a * wj + b * hj + tx) - GREATEST(0, tx)) AS iw, GREATEST(0, LEAST(hi, c * wj + d * hj + ty) - GREATEST(0, ty)) AS ih FROM g1
  WHERE ABS(1 - SQRT(a * a + b * b)) <= 0.001 AND (ABS(DEGREES(ATAN2(c, a))) <= 0.001 OR ABS(ABS(DEGREES(ATAN2(c, a))) - PI() / 2) <= 0.001)),
scored AS (SELECT set_id, i, j, a, b, tx, c, d, ty, 2.0e0 * n * CASE WHEN iw * ih / (wi * hi) > 0.7 THEN 0.1e0 ELSE 1e0 END * CASE WHEN GREATEST(iw / wi, ih / hi) < 0.3 THEN 0.1e0 ELSE 1e0 END AS score FROM g2),
pairs AS (SELECT * FROM scored UNION ALL SELECT set_id, j, i, a, -b, -tx, -c, d, -ty, score FROM scored)"""
TREE = """
edges AS (SELECT set_id, i, j, CASE WHEN score > 1e-4 THEN 1e0 / score ELSE 1e4 END AS weight FROM scored),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY set_id ORDER BY weight, i, j) AS rk FROM edges),
reach AS (SELECT set_id, rk, i AS node FROM ranked
  UNION SELECT r.set_id, r.rk, CASE WHEN e.i = r.node THEN e.j ELSE e.i END FROM reach r JOIN ranked e ON e.set_id = r.set_id AND e.rk < r.rk AND (e.i = r.node OR e.j = r.node)),
tree AS (SELECT set_id, i, j, weight FROM ranked e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.set_id = e.set_id AND r.rk = e.rk AND r.node = e.j)),
near AS (SELECT set_id, i AS p, j AS q FROM tree UNION ALL SELECT set_id, j, i FROM tree),
walk AS (SELECT set_id, MIN(p) AS page_idx, CAST(NULL AS INT) AS parent, 0 AS depth, 0e0 AS tx, 0e0 AS ty FROM near GROUP BY set_id
  UNION ALL SELECT w.set_id, n.q, w.page_idx, w.depth + 1, w.tx + h.tx, w.ty + h.ty
  FROM walk w JOIN near n ON n.set_id = w.set_id AND n.p = w.page_idx AND n.q IS DISTINCT FROM w.parent JOIN pairs h ON h.set_id = w.set_id AND h.i = n.q AND h.j = n.p),
moved AS (SELECT set_id, page_idx, tx - LEAST(0, MIN(tx) OVER (PARTITION BY set_id)) AS tx, ty - LEAST(0, MIN(ty) OVER (PARTITION BY set_id)) AS ty FROM walk),
placed AS (SELECT m.set_id, m.page_idx, CAST(TRUNC(tx) AS BIGINT) AS rx0, CAST(TRUNC(ty) AS BIGINT) AS ry0, CAST(TRUNC(tx + cx1 - cx0) AS BIGINT) AS rx1, CAST(TRUNC(ty + cy1 - cy0) AS BIGINT) AS ry1, cx0, cy0, cx1, cy1
  FROM moved m JOIN crops USING (set_id, page_idx)),
canvases AS (SELECT set_id, CAST(GREATEST(0, MAX(rx1)) AS BIGINT) AS canvas_w, CAST(GREATEST(0, MAX(ry1)) AS BIGINT) AS canvas_h FROM placed GROUP BY set_id)"""
ROTATIONS = "rot AS (SELECT set_id, CAST(COALESCE(MIN(CASE WHEN rotation <> 0 THEN rotation END), 0) AS INT) AS set_rotation FROM pages GROUP BY set_id)"


def ask(select: str, *parts: str) -> str:
    """The fixture, some parts, and a final select."""
    return ",".join([FIXTURE, *parts]) + "\n" + select


def ask_recursive(select: str, *parts: str) -> str:
    """The same where a part is recursive."""
    return ",".join([RECURSIVE, *parts]) + "\n" + select


def ask_tree(select: str, *parts: str) -> str:
    return ",".join([RECURSIVE, ORIENTED, UNIQUE, CROPS, POINTS, FITS, TREE, *parts]) + "\n" + select
