"""Page bounds, crop regions and stripe widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import GRID, LABEL, PAGE

CROP = ["cx0", "cy0", "cx1", "cy1"]


def page_bounds_from_grids(lines: DataFrame, pages: DataFrame, minimal_area_proportion: float = 0.5) -> DataFrame:
    """(bx0..by1) around a page's labels and lines, null where it is too small or the page has no lines.

    The right edge follows the labels alone.
    """
    x = [F.col(c) for c in ("bx0", "bx1", "gx0", "gx1")]
    y = [F.col(c) for c in ("by0", "by1", "gy0", "gy1")]
    box = lines.groupBy(*PAGE).agg(F.min(F.least(*x)).alias("px0"), F.min(F.least(*y)).alias("py0"), F.max(F.greatest("bx0", "bx1")).alias("px1"), F.max(F.greatest(*y)).alias("py1"))
    large = F.abs(F.col("px0") - F.col("px1")) * F.abs(F.col("py0") - F.col("py1")) >= minimal_area_proportion * F.col("width") * F.col("height")
    return pages.select(*PAGE, "width", "height").join(box, PAGE, "left").select(*PAGE, *[F.when(large, F.col(c)).alias(c) for c in ("px0", "py0", "px1", "py1")])


def largest_segment(segments: DataFrame, pages: DataFrame, area_proportion_threshold: float = 0.25, multi_segment: str = "null") -> DataFrame:
    """(sx0..sy1) of a page's segment if it is large enough.

    With several segments there is none, or with multi_segment='largest' the largest,
    the first on a tie.
    """
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    best = segments.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("x0", "y0", "x1", "y1", area.alias("area")), F.struct(area, -F.col("seg_ord"))).alias("s"))
    if multi_segment == "null":
        best = best.where("n = 1")
    best = best.join(pages.select(*PAGE, "width", "height"), PAGE).where(F.col("s.area") >= F.col("width") * F.col("height") * area_proportion_threshold)
    return best.select(*PAGE, *[F.col(f"s.{c}").alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])


def select_crop_regions(pages: DataFrame, segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """cx0..cy1 of every page: its segment, else its grid bounds, else all of it."""
    whole = F.struct(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.col("width").cast("long").alias("x1"), F.col("height").cast("long").alias("y1"))
    box = lambda p: F.when(F.col(f"{p}x0").isNotNull(), F.struct(*[F.col(p + c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]))
    rows = pages.select(*PAGE, "width", "height").join(segments, PAGE, "left").join(bounds, PAGE, "left")
    rows = rows.withColumn("c", F.coalesce(box("s"), box("p"), whole))
    return rows.select(*PAGE, *[F.col(f"c.{c}").alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")])


def crop_regions(oriented: DataFrame, segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Crop regions with the default thresholds, from lines that are only oriented."""
    return select_crop_regions(pages, largest_segment(segments, pages), page_bounds_from_grids(oriented, pages))


def union_bounding_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around x0..y1 of each key; negative coordinates count as unset."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return boxes.groupBy(*keys).agg(F.min(known("x0")).alias("x0"), F.min(known("y0")).alias("y0"), F.max(known("x1")).alias("x1"), F.max(known("y1")).alias("y1"))


def grid_crop_area(lines: DataFrame, pages: DataFrame, keys: list[str] | None = None, to_add_perc: float = 0) -> DataFrame:
    """cx0..cy1 around label circles and line ends (x_center.. from add_label_center), padded and clipped to the page.

    The pad across goes to the top, the pad down to the left.
    """
    keys = keys or PAGE
    x = [F.col("x_center") - F.col("x_radius"), F.col("x_center") + F.col("x_radius"), F.col("gx0"), F.col("gx1")]
    y = [F.col("y_center") - F.col("y_radius"), F.col("y_center") + F.col("y_radius"), F.col("gy0"), F.col("gy1")]
    box = lines.groupBy(*keys).agg(F.min(F.least(*x)).alias("x0"), F.min(F.least(*y)).alias("y0"), F.max(F.greatest(*x)).alias("x1"), F.max(F.greatest(*y)).alias("y1"))
    across = F.bround((F.col("x1") - F.col("x0")) * F.lit(float(to_add_perc))).cast("long")
    down = F.bround((F.col("y1") - F.col("y0")) * F.lit(float(to_add_perc))).cast("long")
    clip = lambda e, most: F.least(F.greatest(e, F.lit(0)), F.col(most)).cast("long")
    rows = box.join(pages.select(*keys, "width", "height"), keys)
    return rows.select(
        *keys,
        clip(F.col("x0") - down, "width").alias("cx0"),
        clip(F.col("y0") - across, "height").alias("cy0"),
        F.least(F.col("x1") + across, F.col("width")).cast("long").alias("cx1"),
        F.least(F.col("y1") + down, F.col("height")).cast("long").alias("cy1"),
    )


def redaction_rects(crops: DataFrame, pages: DataFrame) -> DataFrame:
    """Up to four strips (side, x0..y1) of the page outside its crop; none if the crop leaves the page's first corner."""
    rows = crops.join(pages.select(*PAGE, "width", "height"), PAGE).where(F.least(*CROP) >= 0)
    zero = F.lit(0).cast("long")
    x0, y0, x1, y1, w, h = (F.col(c).cast("long") for c in (*CROP, "width", "height"))

    def strip(side: int, there, *box):  # noqa: ANN001, ANN202
        return F.when(there, F.struct(F.lit(side).alias("side"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))]))

    strips = F.array_compact(F.array(strip(1, x0 > 0, zero, zero, x0, h), strip(3, y0 > 0, zero, zero, w, y0), strip(2, x1 < w, x1, zero, w, h), strip(4, y1 < h, zero, y1, w, h)))
    return rows.select(*PAGE, F.inline(strips))


def stripe_widths(match_lines: DataFrame, crops: DataFrame, default: float = 0.3) -> DataFrame:
    """(stripe, width) of every page for left 1, right 2, top 3 and bottom 4.

    The last match line near enough to an edge gives twice its distance; a horizontal
    one must be nearer than a vertical one.
    """
    size = crops.withColumns({"w": F.col("cx1") - F.col("cx0"), "h": F.col("cy1") - F.col("cy0")})
    whole = lambda e: F.when(e >= 0, F.floor(e)).otherwise(F.ceil(e)).cast("long")
    flat = F.col("type") == "horizontal"
    middle = F.when(flat, whole((F.col("y0") + F.col("y1")) / 2) - F.col("cy0")).otherwise(whole((F.col("x0") + F.col("x1")) / 2) - F.col("cx0"))
    rows = match_lines.where(F.col("type").isin("horizontal", "vertical")).join(size, PAGE).withColumn("v", middle).withColumn("dim", F.when(flat, F.col("h")).otherwise(F.col("w")))
    rows = rows.withColumn("dist", F.least("v", F.col("dim") - F.col("v")))
    rows = rows.where(F.when(flat, F.col("dist") <= default * F.col("h") * 0.75).otherwise(F.col("dist") <= default * F.col("w")))
    stripe = F.when(flat, F.when(F.col("v") <= F.col("dim") / 2, 3).otherwise(4)).otherwise(F.when(F.col("v") <= F.col("dim") / 2, 1).otherwise(2))
    found = rows.withColumn("stripe", stripe).groupBy(*PAGE, "stripe").agg(F.max_by(F.col("dist") * 2, "ml_ord").alias("found"))
    all_ = size.select(*PAGE, "w", "h", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("stripe"))
    usual = whole(F.lit(default) * F.when(F.col("stripe") <= 2, F.col("w")).otherwise(F.col("h")))
    return all_.join(found, [*PAGE, "stripe"], "left").select(*PAGE, "stripe", F.coalesce("found", usual).cast("long").alias("width"))
