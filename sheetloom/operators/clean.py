"""Cleaning of labelled grid lines: order, duplicates, length, axis, crop and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import line_type

PAGE = ["set_id", "page_idx"]
GRID = ["gx0", "gy0", "gx1", "gy1"]
LABEL = ["bx0", "by0", "bx1", "by1"]


def _spans() -> tuple[Column, Column]:
    return F.abs(F.col("gx0") - F.col("gx1")), F.abs(F.col("gy0") - F.col("gy1"))


def orient_grid_lines(lines: DataFrame) -> DataFrame:
    """Turn each line to run down (steep) or right, and number a page's lines along their own axis."""
    dx, dy = _spans()
    swap = F.when(dx < dy, F.col("gy0") > F.col("gy1")).otherwise(F.col("gx0") > F.col("gx1"))
    turned = lines.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("gx0", "gx1"), ("gy0", "gy1"), ("gx1", "gx0"), ("gy1", "gy0"))})
    along = F.when(dx > dy, F.col("gx0")).otherwise(F.col("gy0"))
    order = Window.partitionBy(*PAGE).orderBy(along, "line_ord")
    return turned.withColumn("line_ord", (F.row_number().over(order) - 1).cast("int"))


def label_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def drop_duplicate_labels(lines: DataFrame) -> DataFrame:
    """Drop every line whose trimmed, lower-cased label occurs again on its page; a null label repeats like any other."""
    same = Window.partitionBy(*PAGE, label_key(F.col("text")))
    return lines.withColumn("_n", F.count(F.lit(1)).over(same)).where("_n = 1").drop("_n")


def drop_short_lines(lines: DataFrame, min_line_length: int = 100) -> DataFrame:
    return lines.where(F.greatest(*_spans()) >= min_line_length)


def clean_grid_lines(lines: DataFrame, min_line_length: int = 100) -> DataFrame:
    """Duplicates are counted before short lines go."""
    return drop_short_lines(drop_duplicate_labels(orient_grid_lines(lines)), min_line_length)


def split_by_axis(lines: DataFrame, same_coord_delta: int = 2) -> DataFrame:
    """Add axis (V, H or O) and axis_pos, the place across the axis on the page."""
    dx, dy = _spans()
    axis = F.when(dx < same_coord_delta, "V").when(dy < same_coord_delta, "H").otherwise("O")
    across = F.when(F.col("axis") == "V", F.col("gx0")).when(F.col("axis") == "H", F.col("gy0"))
    order = Window.partitionBy(*PAGE, "axis").orderBy(across, "line_ord")
    return lines.withColumn("axis", axis).withColumn("axis_pos", (F.row_number().over(order) - 1).cast("int"))


def keep_straight_lines(lines: DataFrame) -> DataFrame:
    """Add line_type and keep exactly horizontal and vertical lines."""
    return lines.withColumn("line_type", line_type([F.col(c) for c in GRID])).where("line_type <> 'other'")


def add_label_center(lines: DataFrame) -> DataFrame:
    half = lambda e: F.floor(e / 2).cast("long")
    x0, y0, x1, y1 = (F.col(c) for c in LABEL)
    return lines.withColumns({"x_center": half(x0 + x1), "y_center": half(y0 + y1), "x_radius": half(F.abs(x0 - x1)), "y_radius": half(F.abs(y0 - y1))})


def shift_and_clip_to_crop(lines: DataFrame, crops: DataFrame, keep_cropped: bool = True) -> DataFrame:
    """Move lines to their page's crop (cx0..cy1) and clamp them, or drop them where they lie outside.

    The far limits are the crop's own far coordinates, not its sizes. Labels move but
    are never clamped.
    """
    rows = lines.join(crops.select(*PAGE, "cx0", "cy0", "cx1", "cy1"), PAGE)
    rows = rows.withColumns({c: F.col(c) - F.col("cx0" if "x" in c else "cy0") for c in GRID + LABEL})
    x0, y0, x1, y1 = (F.col(c) for c in GRID)
    if keep_cropped:
        inside = (F.greatest(x0, x1) >= 0) & (F.greatest(y0, y1) >= 0) & (F.least(x0, x1) <= F.col("cx1")) & (F.least(y0, y1) <= F.col("cy1"))
        rows = rows.where(inside).withColumns({c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("cx1" if "x" in c else "cy1")) for c in GRID})
    else:
        rows = rows.where((F.least(x0, y0, x1, y1) >= 0) & (F.greatest(x0, x1) <= F.col("cx1")) & (F.greatest(y0, y1) <= F.col("cy1")))
    return rows.select(*lines.columns)


def parse_grid_name(text: Column) -> Column:
    """struct(l, n, d): lower-cased letters, whole number and decimals at the start of a label; fields compare in this order."""
    part = lambda i: F.regexp_extract(text, r"^([a-zA-Z]*)(\d+)?(\.\d+)?", i)
    whole = F.coalesce(F.nullif(part(2), F.lit("")).cast("long"), F.lit(0))
    decimal = F.coalesce(F.nullif(part(3), F.lit("")).cast("double"), F.lit(0.0))
    return F.struct(F.lower(part(1)).alias("l"), whole.alias("n"), decimal.alias("d"))


_NAME = "struct<l:string,n:bigint,d:double>"


def _longest_run(names: Column, falling: bool) -> Column:
    """Places of one longest strictly rising (falling) subsequence.

    A fold keeps, for every length, the run with the least last name (``ends``), and for every
    name the place before it in its run; of equally long runs the one that ends last is kept.
    """
    start = F.struct(F.array().cast(f"array<struct<name:{_NAME},at:int>>").alias("ends"), F.array().cast("array<int>").alias("before"))

    def step(acc: Column, name: Column) -> Column:
        ends = acc["ends"]
        k = F.size(F.filter(ends, lambda e: e["name"] > name if falling else e["name"] < name))
        own = F.array(F.struct(name.alias("name"), F.size(acc["before"]).alias("at")))
        return F.struct(F.concat(F.slice(ends, 1, k), own, F.slice(ends, k + 2, F.size(ends))).alias("ends"), F.array_append(acc["before"], F.coalesce(F.get(ends, k - 1)["at"], F.lit(-1))).alias("before"))

    def walk_back(acc: Column) -> Column:
        last = F.struct(F.element_at(acc["ends"], -1)["at"].alias("at"), F.array().cast("array<int>").alias("run"))
        back = lambda own, _: F.struct(F.get(acc["before"], own["at"]).alias("at"), F.concat(F.array(own["at"]), own["run"]).alias("run"))
        return F.aggregate(acc["ends"], last, back, lambda own: own["run"])

    return F.aggregate(names, start, step, walk_back)


def keep_monotone_names(lines: DataFrame) -> DataFrame:
    """Named lines (name, name_idx, coord) per page and axis whose names rise or fall with their place.

    ``lines`` comes from split_by_axis. Of the longest rising and the longest falling
    run the rising one is taken only if it is longer; name_idx counts along the run and
    name_rank by name. A page's lines of an axis are one small array.
    """
    named = lines.where("axis <> 'O'").select(*PAGE, "axis", F.struct("axis_pos", parse_grid_name(F.col("text")).cast(_NAME).alias("name"), F.when(F.col("axis") == "V", F.col("gx0")).otherwise(F.col("gy0")).alias("coord"), "text").alias("line"))
    pages = named.groupBy(*PAGE, "axis").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    names = F.transform("lines", lambda x: x["name"])
    pages = pages.withColumns({"_up": _longest_run(names, False), "_down": _longest_run(names, True)})
    kept = F.when(F.size("_up") > F.size("_down"), F.col("_up")).otherwise(F.col("_down"))
    rows = pages.select(*PAGE, "axis", "lines", F.posexplode(kept).alias("name_idx", "_at")).withColumn("line", F.get("lines", F.col("_at")))
    order = Window.partitionBy(*PAGE, "axis").orderBy("name", "name_idx")
    rows = rows.select(*PAGE, "axis", F.col("line.text").alias("text"), F.col("line.name").alias("name"), "name_idx", F.col("line.coord").alias("coord"))
    return rows.withColumn("name_rank", (F.row_number().over(order) - 1).cast("int"))


def pick_set_rotation(pages: DataFrame) -> DataFrame:
    """(set_id, set_rotation): the least rotation that is not 0, else 0."""
    return pages.groupBy("set_id").agg(F.coalesce(F.min(F.when(F.col("rotation") != 0, F.col("rotation"))), F.lit(0)).alias("set_rotation"))
