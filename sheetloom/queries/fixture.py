"""Sets of drawing sheets derived from the given tables, as one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import cut

FIXTURE = """
WITH k AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation),
sets AS (  -- every customer's orders are one set
  SELECT o_custkey AS set_id, 1 + COUNT(*) % 3 AS n_rows, 1 + CAST(SUM(o_orderkey) AS BIGINT) % 3 AS n_cols
  FROM orders GROUP BY o_custkey),
pages AS (
  SELECT s.set_id, CAST(r.k * s.n_cols + c.k AS INT) AS page_idx,
         CAST(3000 AS BIGINT) AS width, CAST(2000 AS BIGINT) AS height,
         CAST(CASE WHEN (r.k + c.k) % 2 = 0 THEN 0 ELSE 90 * (s.set_id % 4) END AS INT) AS rotation,
         c.k * 2400 + (s.set_id * 7 + c.k * 13 + r.k * 5) % 50 AS ox,
         r.k * 1400 + (s.set_id * 3 + c.k * 11 + r.k * 17) % 40 AS oy
  FROM sets s JOIN k r ON r.k < s.n_rows JOIN k c ON c.k < s.n_cols),
plan_lines AS (
  SELECT set_id, chr(CAST(65 + k.k AS INT)) AS text, 'V' AS ax,
         4 * CAST(FLOOR((150 + 300 * k.k + (set_id * 7 + k.k * 31) % 60) / 4) AS BIGINT) AS pos FROM sets CROSS JOIN k
  UNION ALL
  SELECT set_id, CAST(k.k + 1 AS VARCHAR(10)), 'H',
         4 * CAST(FLOOR((120 + 280 * k.k + (set_id * 5 + k.k * 29) % 60) / 4) AS BIGINT) FROM sets CROSS JOIN k),
clean AS (
  SELECT p.set_id, p.page_idx, l.text, l.ax,
         CASE WHEN l.ax = 'V' THEN l.pos - p.ox ELSE l.pos - p.oy END AS q,
         p.width, p.height, l.pos
  FROM pages p JOIN plan_lines l ON l.set_id = p.set_id
   AND ((l.ax = 'V' AND l.pos > p.ox + 30 AND l.pos < p.ox + p.width - 30)
     OR (l.ax = 'H' AND l.pos > p.oy + 30 AND l.pos < p.oy + p.height - 30))),
segs AS (
  SELECT set_id, page_idx, text,
    CASE WHEN ax='V' THEN q-20 ELSE 0 END AS bx0, CASE WHEN ax='V' THEN 0 ELSE q-20 END AS by0,
    CASE WHEN ax='V' THEN q+20 ELSE 40 END AS bx1, CASE WHEN ax='V' THEN 40 ELSE q+20 END AS by1,
    CASE WHEN ax='V' THEN q ELSE 40 END AS x0, CASE WHEN ax='V' THEN 40 ELSE q END AS y0,
    CASE WHEN ax='V' THEN q ELSE width-10 END AS x1, CASE WHEN ax='V' THEN height-10 ELSE q END AS y1,
    (pos + page_idx) % 4 AS flip
  FROM clean
  UNION ALL  -- noise: a label that occurs twice on the page (other case, blanks)
  SELECT set_id, page_idx, ' d ', 500, 0, 540, 40, 520, 40, 520, 1990, 0 FROM pages WHERE (set_id + page_idx) % 7 = 0
  UNION ALL
  SELECT set_id, page_idx, 'D ', 700, 0, 740, 40, 720, 40, 720, 1990, 1 FROM pages WHERE (set_id + page_idx) % 7 = 0
  UNION ALL  -- noise: too short
  SELECT set_id, page_idx, 'Z9', 900, 0, 940, 40, 920, 40, 920, 100, 0 FROM pages WHERE (set_id + page_idx) % 5 = 0),
grid_lines AS (
  SELECT set_id, page_idx,
    CAST(ROW_NUMBER() OVER (PARTITION BY set_id, page_idx ORDER BY bx0, by0, text, x0, y0) - 1 AS INT) AS line_ord, text,
    bx0, by0, bx1, by1,
    CASE WHEN flip = 1 THEN x1 ELSE x0 END AS gx0, CASE WHEN flip = 1 THEN y1 ELSE y0 END AS gy0,
    CASE WHEN flip = 1 THEN x0 ELSE x1 END AS gx1, CASE WHEN flip = 1 THEN y0 ELSE y1 END AS gy1
  FROM segs),
segments AS (
  SELECT set_id, page_idx, 0 AS seg_ord, CAST(50 AS BIGINT) AS x0, CAST(40 AS BIGINT) AS y0, CAST(2950 AS BIGINT) AS x1, CAST(1960 AS BIGINT) AS y1
    FROM pages WHERE (set_id + page_idx) % 4 IN (1, 3)
  UNION ALL SELECT set_id, page_idx, 1, 100, 100, 900 + page_idx, 1800 FROM pages WHERE (set_id + page_idx) % 4 = 3
  UNION ALL SELECT set_id, page_idx, 0, 100, 100, 600, 600 FROM pages WHERE (set_id + page_idx) % 4 = 2),
match_lines AS (
  SELECT p.set_id, p.page_idx, CAST(k.k AS INT) AS ml_ord,
    CASE WHEN k.k % 3 = 2 THEN 'other' WHEN k.k % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS type,
    CASE WHEN k.k % 2 = 0 THEN (p.set_id * 37 + p.page_idx * 711 + k.k * 911) % 3000 ELSE 20 END AS x0,
    CASE WHEN k.k % 2 = 0 THEN 20 ELSE (p.set_id * 41 + p.page_idx * 577 + k.k * 613) % 2000 END AS y0,
    CASE WHEN k.k % 2 = 0 THEN (p.set_id * 37 + p.page_idx * 711 + k.k * 911) % 3000 ELSE 2980 END AS x1,
    CASE WHEN k.k % 2 = 0 THEN 1980 ELSE (p.set_id * 41 + p.page_idx * 577 + k.k * 613) % 2000 END AS y1
  FROM pages p JOIN k ON k.k < (p.set_id + p.page_idx) % 6),
text_boxes AS (
  SELECT p.set_id, p.page_idx, CAST(k.k AS INT) AS box_ord,
    (p.set_id * 17 + k.k * 479) % 2700 + 0.5e0 AS x0, (p.page_idx * 53 + k.k * 331) % 1800 + 0.5e0 AS y0,
    (p.set_id * 17 + k.k * 479) % 2700 + 200.75e0 AS x1, (p.page_idx * 53 + k.k * 331) % 1800 + 60.25e0 AS y1
  FROM pages p JOIN k ON k.k < 8),
pixels AS (
  SELECT set_id, page_idx, x, y, MIN(r) AS r, MIN(g) AS g, MIN(b) AS b FROM (
    SELECT p.set_id, p.page_idx,
      (l.l_partkey * 7 + l.l_linenumber * 131 + l.l_orderkey * 119) % 3000 AS x,
      (l.l_suppkey * 61 + l.l_partkey * 3 + l.l_orderkey * 79) % 2000 AS y,
      CAST(l.l_quantity * 5 AS INT) AS r, CAST(l.l_quantity * 4 AS INT) AS g, CAST((l.l_quantity * 3 + l.l_orderkey) % 255 AS INT) AS b
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN pages p ON p.set_id = o.o_custkey) z
  GROUP BY set_id, page_idx, x, y),
overall_lines AS (
  SELECT set_id, text,
    CASE WHEN ax = 'V' THEN d - 8 ELSE 0 END AS bx0, CASE WHEN ax = 'V' THEN 0 ELSE d - 8 END AS by0,
    CASE WHEN ax = 'V' THEN d + 8 ELSE 16 END AS bx1, CASE WHEN ax = 'V' THEN 16 ELSE d + 8 END AS by1,
    CASE WHEN ax = 'V' THEN d ELSE 16 END AS gx0, CASE WHEN ax = 'V' THEN 16 ELSE d END AS gy0,
    CASE WHEN ax = 'V' THEN d ELSE 4000 END AS gx1, CASE WHEN ax = 'V' THEN 4000 ELSE d END AS gy1
  FROM (SELECT set_id, text, ax, CASE WHEN set_id % 2 = 0 THEN CAST(pos / 2 AS BIGINT) ELSE CAST(pos / 4 AS BIGINT) END AS d FROM plan_lines) z),
descriptors AS (
  SELECT CAST(label AS BIGINT) AS set_id, CAST(0 AS INT) AS page_idx, CAST(2 AS INT) AS stripe, vec_id AS kp_id,
    2400 + vec_id * 13 % 600 AS x, vec_id * 29 % 2000 AS y, embedding AS vec FROM embeddings
  UNION ALL
  SELECT CAST(label AS BIGINT), 1, 1, vec_id, vec_id * 13 % 600, vec_id * 29 % 2000, embedding FROM embeddings)
"""
#: The same, for statements with recursive parts.
RECURSIVE = FIXTURE.replace("WITH k AS", "WITH RECURSIVE k AS", 1)
_BASE = ("nation", "orders", "lineitem", "embeddings")


_READY: dict[tuple[str, str, str], DataFrame] = {}
_NAMED: dict[str, tuple[str, str]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the fixture, over the base tables in ``sf_dir``.

    Each is worked out once a session and checkpointed, so that queries start from a
    table as they would in use, not from the text that makes it.
    """
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if _NAMED.get("base") != (app, sf_dir):  # the base tables' names are those of the folder asked for last
        for table in _BASE:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        _NAMED["base"] = (app, sf_dir)
    if key not in _READY:
        _READY[key] = cut(spark.sql(f"{FIXTURE} SELECT * FROM {name}"))
    return _READY[key]
