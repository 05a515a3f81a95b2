"""Intersections of named lines, and the pages that share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import fix_coords_line, line_intersection, scale_bbox_by_bbox
from ..plans import cut
from .bounds import CROP
from .clean import GRID, PAGE


def grid_points(lines: DataFrame, crops: DataFrame, both_orders: bool = False) -> DataFrame:
    """(text_a, text_b, x, y) where two lines of a page with different labels cross, seen from the crop.

    Axis-parallel lines count as endless. Each pair of labels is given once, text_a below
    text_b, or with both_orders twice.
    """
    shifted = scale_bbox_by_bbox([F.col(c) for c in CROP], [F.col(c) for c in GRID])
    rows = cut(lines.join(crops.select(*PAGE, *CROP), PAGE).select(*PAGE, "text", *[c.alias(n) for n, c in zip(GRID, shifted)]))
    upright, flat = F.col("gx0") == F.col("gx1"), F.col("gy0") == F.col("gy1")
    rows = rows.withColumn("axis", F.when(flat, "H").when(upright, "V").otherwise("O"))
    h, v = rows.where("axis = 'H'"), rows.where("axis = 'V'")
    # most pages have only such lines: a plain product of the two kinds, whose point needs no geometry
    crossed = h.select(*PAGE, F.col("text").alias("th"), F.col("gy0").cast("double").alias("y")).join(v.select(*PAGE, F.col("text").alias("tv"), F.col("gx0").cast("double").alias("x")), PAGE).where("th <> tv")
    crossed = crossed.select(*PAGE, F.least("th", "tv").alias("text_a"), F.greatest("th", "tv").alias("text_b"), "x", "y")
    # pairs with an inclined line, of which there are few, and lines that coincide
    inclined = rows.where("axis = 'O'").select(*PAGE, F.col("text").alias("to"), *[F.col(c).alias(f"o{c}") for c in GRID])
    rest = inclined.join(rows, PAGE).where((F.col("to") != F.col("text")) & ((F.col("axis") != "O") | (F.col("to") < F.col("text"))))
    own, other = [F.col(f"o{c}") for c in GRID], [F.col(c) for c in GRID]
    swap = F.col("to") > F.col("text")
    met = F.when(swap, line_intersection(other, own)).otherwise(line_intersection(own, other))
    rest = rest.select(*PAGE, F.least("to", "text").alias("text_a"), F.greatest("to", "text").alias("text_b"), met.alias("p"))
    twin = rows.where("axis <> 'O'").select(*PAGE, *GRID, F.col("text").alias("tt"))
    same = rows.join(twin, [*PAGE, *GRID]).where("text < tt").select(*PAGE, F.col("text").alias("text_a"), F.col("tt").alias("text_b"), F.col("gx0").cast("double").alias("x"), F.col("gy0").cast("double").alias("y"))
    found = crossed.unionByName(rest.where("p.x is not null").select(*PAGE, "text_a", "text_b", "p.x", "p.y")).unionByName(same)
    if both_orders:
        found = found.unionByName(found.select(*PAGE, F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"), "x", "y"))
    return found


def matched_points(points: DataFrame) -> DataFrame:
    """(set_id, i, j, x, y, to_x, to_y): pages i < j of a set with a point of the same two labels; one equi-join on the labels."""
    a = points.select("set_id", "text_a", "text_b", F.col("page_idx").alias("i"), "x", "y")
    b = points.select("set_id", "text_a", "text_b", F.col("page_idx").alias("j"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    return a.join(b, ["set_id", "text_a", "text_b"]).where("i < j").select("set_id", "i", "j", "text_a", "text_b", "x", "y", "to_x", "to_y")


def shared_points(lines: DataFrame, crops: DataFrame, most: int = 64) -> DataFrame:
    """matched_points of grid_points, from pages that meet with their lines instead of points that meet by their labels.

    A page's lines are one row; two pages of a set are joined once and share the crossings of the lines that they share, so
    points are neither shuffled nor joined. Sets of more than ``most`` pages, whose pairs of pages may be far more than
    those with a common point, and sets with inclined lines or lines that coincide go through their points.
    """
    shifted = scale_bbox_by_bbox([F.col(c) for c in CROP], [F.col(c) for c in GRID])
    rows = lines.join(crops.select(*PAGE, *CROP), PAGE).select(*PAGE, "text", *[c.alias(n) for n, c in zip(GRID, shifted)])
    flat, upright = F.col("gy0") == F.col("gy1"), F.col("gx0") == F.col("gx1")
    kind = lambda own, at: F.collect_list(F.when(own, F.struct("text", F.col(at).cast("double").alias("at"))))
    plain = F.coalesce(flat | upright, F.lit(False))
    pages = rows.groupBy(*PAGE).agg(kind(flat, "gy0").alias("hs"), kind(~flat & upright, "gx0").alias("vs"), (~F.min(plain) | (F.size(F.collect_set(F.struct(*GRID))) < F.count(F.lit(1)))).alias("odd"))
    pages = cut(pages)
    apart = cut(pages.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.max("odd").alias("odd")).where(F.col("odd") | (F.col("n") > most)).select("set_id"))
    if apart.isEmpty():
        return _met_pages(pages)
    by_label = matched_points(grid_points(lines.join(apart, "set_id", "left_semi"), crops))
    return _met_pages(pages.join(apart, "set_id", "left_anti")).unionByName(by_label)


def _met_pages(pages: DataFrame) -> DataFrame:
    """matched_points of pages with their horizontal and vertical lines (text, at) as hs and vs."""
    a = pages.select("set_id", F.col("page_idx").alias("i"), F.col("hs").alias("ha"), F.col("vs").alias("va"))
    b = pages.select("set_id", F.col("page_idx").alias("j"), F.col("hs").alias("hb"), F.col("vs").alias("vb"))
    alike = lambda own, other: F.flatten(F.transform(own, lambda p: F.transform(F.filter(other, lambda q: q["text"] == p["text"]), lambda q: record(text=p["text"], at=p["at"], to=q["at"]))))
    pair = ["set_id", "i", "j"]
    met = worked_out(a.join(b, "set_id").where("i < j"), pair, hh=alike("ha", "hb"), vv=alike("va", "vb"), hv=alike("ha", "vb"), vh=alike("va", "hb"))
    # lines of one label may lie the other way on the other page: then the first one's place there is across
    ways = F.array(F.struct(F.lit(False).alias("across"), F.col("hh").alias("h"), F.col("vv").alias("v")), F.struct(F.lit(True).alias("across"), F.col("hv").alias("h"), F.col("vh").alias("v")))
    met = met.select(*pair, F.inline(ways)).select(*pair, "across", "v", F.explode("h").alias("h")).select(*pair, "across", "h", F.explode("v").alias("v")).where("h.text <> v.text")
    to = lambda x, y: F.when(F.col("across"), F.col(y)).otherwise(F.col(x))
    names = [F.least("h.text", "v.text").alias("text_a"), F.greatest("h.text", "v.text").alias("text_b")]
    return met.select(*pair, *names, F.col("v.at").alias("x"), F.col("h.at").alias("y"), to("v.to", "h.to").alias("to_x"), to("h.to", "v.to").alias("to_y"))


def shared_labels(lines: DataFrame, overall: DataFrame) -> DataFrame:
    """Lines whose label occurs on the set's overall plan."""
    return lines.join(overall.select("set_id", "text"), ["set_id", "text"], "left_semi")


def record(**fields: Column) -> Column:
    """A struct whose names hold inside functions of array elements too, where aliases may get lost."""
    return F.named_struct(*[x for name, e in fields.items() for x in (F.lit(name), e)])


def worked_out(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, each worked out once a row: a generator stands between them and what reads them, so that they are not copied into functions of array elements."""
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))


def page_arrays(lines: DataFrame, keys: list[str], tol: int = 1, more: Column | None = None) -> DataFrame:
    """One row per page: its horizontal and vertical lines (line_type) as ``hs`` and ``vs``, sorted by label, with ends in order (l0..l3).

    ``dead`` are the crossings given way to by others of the same labels, and ``more`` is a struct that each line keeps as ``more``.
    """
    ends = fix_coords_line([F.col(c) for c in GRID])
    line = F.struct("text", "line_ord", *[e.alias(f"l{k}") for k, e in enumerate(ends)], *([more.alias("more")] if more is not None else []))
    kind = lambda t: F.sort_array(F.collect_list(F.when(F.col("line_type") == t, line)))
    pages = lines.groupBy(*keys).agg(kind("horizontal").alias("hs"), kind("vertical").alias("vs"))
    return worked_out(pages, keys, hs=F.col("hs"), vs=F.col("vs"), dead=superseded(tol))


def reach(h: Column, v: Column, tol: int = 1) -> Column:
    """Whether a horizontal and a vertical line with ordered ends l0..l3 meet; both ends of a line may lie ``tol`` off. Their point is (v.l0, h.l1)."""

    def near(low: Column, value: Column, high: Column) -> Column:
        return ((low <= value - tol) & (value - tol <= high)) | ((low <= value + tol) & (value + tol <= high))

    same = (h["l0"] == v["l0"]) & (h["l1"] == v["l1"]) & (h["l2"] == v["l2"]) & (h["l3"] == v["l3"])
    return same | (near(h["l0"], v["l0"], h["l2"]) & near(v["l1"], h["l1"], v["l3"]))


def superseded(tol: int = 1) -> Column:
    """Of pages of page_arrays with labels that repeat, the crossings (i, j) that have a later one of the same labels, by line_ord; null for other pages."""
    repeats = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["text"]))) < F.size(a)
    met = F.flatten(F.transform("hs", lambda h, i: F.filter(F.transform("vs", lambda v, j: F.when(reach(h, v, tol), record(h=h["text"], v=v["text"], oh=h["line_ord"], ov=v["line_ord"], i=i, j=j))), lambda p: p.isNotNull())))
    later = lambda a, p, k: p["h"].eqNullSafe(F.get(a, k + 1)["h"]) & p["v"].eqNullSafe(F.get(a, k + 1)["v"]) & (k + 1 < F.size(a))
    lost = F.element_at(F.transform(F.array(F.array_sort(met)), lambda a: F.transform(F.filter(a, lambda p, k: later(a, p, k)), lambda p: record(i=p["i"], j=p["j"]))), 1)
    return F.when(repeats("hs") | repeats("vs"), lost)


def page_hv_points(lines: DataFrame, keys: list[str] | None = None, tol: int = 1) -> DataFrame:
    """(text_h, text_v, x, y) where a horizontal and a vertical line (line_type) of a page really meet; the last of equal labels counts.

    A page's lines are one row of two arrays, so its points need no shuffle of their own.
    """
    keys = keys or PAGE
    return array_points(page_arrays(lines, keys, tol), keys, tol)


def array_crossings(pages: DataFrame, keys: list[str], tol: int = 1) -> DataFrame:
    """(keys, text_h, text_v, x, y, h, v) of the lines of page_arrays that meet."""
    rows = pages.select(*keys, "dead", "vs", F.posexplode("hs").alias("i", "h"))
    rows = rows.select(*keys, "dead", "i", "h", F.posexplode("vs").alias("j", "v")).where(reach(F.col("h"), F.col("v"), tol))
    # a function of elements keeps the filter, and those joined to it, out of the one method of a stage, which grows too long to be compiled
    rows = rows.where(F.col("dead").isNull() | ~F.exists("dead", lambda d: (d["i"] == F.col("i")) & (d["j"] == F.col("j"))))
    return rows.select(*keys, F.col("h.text").alias("text_h"), F.col("v.text").alias("text_v"), F.col("v.l0").cast("long").alias("x"), F.col("h.l1").cast("long").alias("y"), "h", "v")


def array_points(pages: DataFrame, keys: list[str], tol: int = 1) -> DataFrame:
    """The points of page_arrays."""
    return array_crossings(pages, keys, tol).drop("h", "v")
