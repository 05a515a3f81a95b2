"""Whole workloads against planted layouts."""

import random

from sheetloom.operators import bounds, clean
from sheetloom.plans import anchored, keypoints
from sheetloom.queries import QUERIES
from sheetloom.queries.fixture import view

DATA = "/root/testdata/sf0.001"
LINE = "set_id long, page_idx int, line_ord int, text string, bx0 long, by0 long, bx1 long, by1 long, gx0 long, gy0 long, gx1 long, gy1 long"
BOX = "set_id long, page_idx int, seg_ord int, x0 long, y0 long, x1 long, y1 long"


def keypoint_set(set_id, shift, seed):
    """Two pages that show the same 40 points, the second one moved by ``shift``; five points of it are elsewhere."""
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        x, y, vec = rng.randint(2000, 2900), rng.randint(0, 1900), [rng.random() for _ in range(8)]
        rows.append((set_id, 0, 2, k, float(x), float(y), vec))
        far = 300 if k % 8 == 0 else 0
        rows.append((set_id, 1, 1, k, float(x - shift[0] + far), float(y - shift[1]), vec))
    return rows


def test_keypoints_place_pages_without_lines(spark):
    pages = spark.createDataFrame([(n, p, 3000, 2000, 0) for n in (1, 2, 3) for p in (0, 1)], "set_id long, page_idx int, width int, height int, rotation int")
    points = keypoint_set(1, (1800, 40), 1) + keypoint_set(2, (2000, -30), 2)
    descriptors = spark.createDataFrame(points, "set_id long, page_idx int, stripe int, kp_id long, x double, y double, vec array<float>")
    compared = spark.createDataFrame([(n, 0, 1, 2, 1) for n in (1, 2, 3)], "set_id long, i int, j int, stripe_i int, stripe_j int")
    placed, canvases = keypoints.place_sheets(pages, spark.createDataFrame([], LINE), spark.createDataFrame([], BOX), descriptors, compared)
    assert {(r.set_id, r.page_idx, r.rx0, r.ry0) for r in placed.collect()} == {(1, 0, 0, 0), (1, 1, 1800, 40), (2, 0, 0, 30), (2, 1, 2000, 0)}
    assert {(r.set_id, r.canvas_w, r.canvas_h) for r in canvases.collect()} == {(1, 4800, 2040), (2, 5000, 2030)}


def test_turned_keypoints_are_the_last_resort(spark):
    """Of two candidates of a pair, one of them turned, the straight one is taken; a pair with a turned one only keeps it, scored lower."""
    straight = [(s, p, t, k, x, y, v) for s, p, t, k, x, y, v in keypoint_set(1, (1800, 40), 3)]
    turned = []
    for s, p, _, k, x, y, v in keypoint_set(1, (1800, 40), 4):
        turned.append((s, p, 3 if p == 0 else 4, 100 + k, x, y, v) if p == 0 else (s, p, 4, 100 + k, 1500 - y, x + 100, v))
    alone = [(2, *row[1:]) for row in turned]
    schema = "set_id long, page_idx int, stripe int, kp_id long, x double, y double, vec array<float>"
    compared = spark.createDataFrame([(1, 0, 1, 2, 1), (1, 0, 1, 3, 4), (2, 0, 1, 3, 4)], "set_id long, i int, j int, stripe_i int, stripe_j int")
    crops = spark.createDataFrame([(n, p, 0, 0, 3000, 2000) for n in (1, 2) for p in (0, 1)], "set_id long, page_idx int, cx0 long, cy0 long, cx1 long, cy1 long")
    loose = {"intersection_area_threshold": 2.0, "min_intersection_len_threshold": 0.0}
    found = {r.set_id: r for r in keypoints.keypoint_transforms(spark.createDataFrame(straight + turned + alone, schema), compared, crops, **loose).collect()}
    assert (found[1].stripe_i, found[1].tx, found[1].ty) == (2, 1800, 40) and found[2].stripe_i == 3
    assert abs(found[2].score * 1.5 - found[1].score) < 0.5


def test_keypoints_leave_complete_sets_to_their_lines(spark):
    tables = [view(spark, DATA, name) for name in ("pages", "grid_lines", "segments", "descriptors")]
    none = spark.createDataFrame([], "set_id long, i int, j int, stripe_i int, stripe_j int")
    placed, _ = keypoints.place_sheets(*tables, none)
    by_lines = QUERIES["p6_place_rects"](spark, DATA).join(QUERIES["p4_is_complete"](spark, DATA).where("complete").select("set_id"), "set_id")
    key = lambda rows: sorted((r.set_id, r.page_idx, r.rx0, r.ry0, r.rx1, r.ry1) for r in rows.collect())
    assert key(placed) == key(by_lines) != []


def test_anchored_sheets_keep_the_planted_shifts(spark):
    found = QUERIES["w3_anchor_to_overall"](spark, DATA).toPandas()
    lines = clean.add_label_center(clean.keep_straight_lines(view(spark, DATA, "grid_lines")))
    crops = bounds.grid_crop_area(lines, view(spark, DATA, "pages"))  # sheets are cropped to their lines
    rows = found.merge(view(spark, DATA, "pages").toPandas(), on=["set_id", "page_idx"]).merge(crops.toPandas(), on=["set_id", "page_idx"])
    rows["dx"], rows["dy"] = rows.x0 - rows.cx0 - rows.ox, rows.y0 - rows.cy0 - rows.oy
    spread = rows.groupby("set_id")[["dx", "dy"]].agg(lambda v: v.max() - v.min())
    assert len(rows) > 0 and (spread <= 4).all().all()  # plans are drawn at half or quarter size, in whole pixels


def anchored_by_hand(pages, lines, plan, plan_lines):
    """Of one set: {page: rectangle}, canvas. A page is (width, height, rotation), a line (text, bbox, ends)."""
    r = min([p[2] for p in pages.values() if p[2]] + [plan[2]])

    def turned(own, page):
        w, h = (page[1], page[0]) if page[2] != r and r in (90, 270) else page[:2]
        at = {0: lambda x, y: (x, y), 90: lambda x, y: (y, h - x), 180: lambda x, y: (w - x, h - y), 270: lambda x, y: (w - y, x)}[r]
        out = []
        for text, b, g in own:
            if g[0] == g[2] or g[1] == g[3]:
                radius = (abs(b[0] - b[2]) // 2, abs(b[1] - b[3]) // 2)
                out.append((text, at((b[0] + b[2]) // 2, (b[1] + b[3]) // 2), radius[::-1] if r in (90, 270) else radius, at(*g[:2]) + at(*g[2:])))
        xs = [v for _, c, d, g in out for v in (c[0] - d[0], c[0] + d[0], g[0], g[2])]
        ys = [v for _, c, d, g in out for v in (c[1] - d[1], c[1] + d[1], g[1], g[3])]
        return out, [min(max(min(xs), 0), w), min(max(min(ys), 0), h), min(max(xs), w), min(max(ys), h)]

    def meet(h, v):  # ends in order
        h, v = (sorted((g[:2], g[2:])) for g in (h, v))
        inside = lambda lo, x, hi: lo <= x - 1 <= hi or lo <= x + 1 <= hi
        return (v[0][0], h[0][1]) if inside(h[0][0], v[0][0], h[1][0]) and inside(v[0][1], h[0][1], v[1][1]) else None

    flat = lambda g: g[1] == g[3]
    over, area = turned(plan_lines, plan)
    place = {}
    for text, _, _, g in over:
        place.setdefault(text, g)
    scales, points, sizes = [], {}, {}
    for page, own in lines.items():
        own, crop = turned(own, pages[page])
        shared = [x for x in own if x[0] in place]
        up = [x for x in shared if not flat(x[3])]
        axis, use = (0, up) if len(up) >= 2 else (1, [x for x in shared if flat(x[3])])
        use = sorted(use, key=lambda x: x[1][axis])
        gaps = [(abs(a[3][axis] - b[3][axis]), -k, a[0], b[0]) for k, (a, b) in enumerate(zip(use, use[1:]))]
        gap, _, a, b = max(gaps)
        scales.append(gap / abs(place[a][axis] - place[b][axis]))
        move = lambda g: (g[0] - crop[0], g[1] - crop[1], g[2] - crop[0], g[3] - crop[1])
        found = {(h[0], v[0]): meet(move(h[3]), move(v[3])) for h in shared if flat(h[3]) for v in shared if not flat(v[3])}
        points[page], sizes[page] = {k: p for k, p in found.items() if p}, (crop[2] - crop[0], crop[3] - crop[1])
    scales = sorted(s for s in scales if s > 1)
    scale = max(scales, key=scales.count)  # these sets have one scale
    place = {t: [round((v - area[k % 2]) * scale) for k, v in enumerate(g)] for t, g in place.items()}
    counts = {}
    for own in points.values():
        for k in own:
            counts[k] = counts.get(k, 0) + 1
    out = {}
    for page, own in points.items():
        usable = {k: meet(place[k[0]], place[k[1]]) for k in own}
        usable = {k: p for k, p in usable.items() if p}
        common = {k: p for k, p in usable.items() if counts[k] == max(counts.values())} or usable
        seen, rects = set(), []
        for k in sorted(common):
            if not seen & set(k):
                seen |= set(k)
                rects.append((common[k][0] - own[k][0], common[k][1] - own[k][1]))
        tops = [x for x in set(rects) if rects.count(x) == max(map(rects.count, rects))]
        x, y = tops[0] if len(tops) == 1 else [sum(c) / len(rects) for c in zip(*rects)]
        out[page] = (x, y, x + sizes[page][0], y + sizes[page][1])
    return out, (round(scale * (area[2] - area[0])), round(scale * (area[3] - area[1])))


def test_turned_sheets_are_anchored(spark):
    rng = random.Random(2)
    sheet, drawn, page_rows, line_rows, plan_rows, over_rows = {}, {}, [], [], [], []
    for n, (rotation, turns) in enumerate([(0, (0, 90)), (90, (90, 90)), (90, (0, 90)), (180, (180, 0)), (270, (270, 270))]):
        plan = (1000, 800, rotation)
        up, across = sorted(rng.sample(range(50, 950, 7), 6)), sorted(rng.sample(range(50, 750, 7), 5))
        lines = [(f"V{k}", (x - 9, 0, x + 10, 20), (x, 20, x, 790)) for k, x in enumerate(up)] + [(f"H{k}", (0, y - 9, 20, y + 10), (990, y, 20, y)) for k, y in enumerate(across)]
        over = [*lines, ("odd", (1, 1, 9, 9), (5, 5, 60, 90))]
        pages, own = {}, {}
        for p, turn in enumerate(turns):
            dx, dy = 300 * p, 40
            pages[p] = (1500, 1700, turn)
            scaled = [(t, tuple(2 * v - (dx, dy)[k % 2] for k, v in enumerate(b)), tuple(2 * v - (dx, dy)[k % 2] for k, v in enumerate(g))) for t, b, g in lines]
            own[p] = [(t, b, g) for t, b, g in scaled if (0 < g[0] < 1500 if g[0] == g[2] else True)] + [("Q", (3, 3, 9, 9), (9, 9, 70, 9))]
        sheet[n], drawn[n] = pages, anchored_by_hand(pages, own, plan, over)
        page_rows += [(n, p, *v) for p, v in pages.items()]
        line_rows += [(n, p, k, t, *b, *g) for p, ls in own.items() for k, (t, b, g) in enumerate(ls)]
        plan_rows.append((n, *plan))
        over_rows += [(n, 0, k, t, *b, *g) for k, (t, b, g) in enumerate(over)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    rects, canvases = anchored.anchor_sheets(
        table(page_rows, "set_id long, page_idx int, width int, height int, rotation int"), table(line_rows, LINE), table(over_rows, LINE).drop("page_idx"), table(plan_rows, "set_id long, width int, height int, rotation int")
    )
    assert {(r.set_id, r.page_idx): (r.x0, r.y0, r.x1, r.y1) for r in rects.collect()} == {(n, p): tuple(map(float, v)) for n, (own, _) in drawn.items() for p, v in own.items()}
    assert {r.set_id: (r.canvas_w, r.canvas_h) for r in canvases.collect()} == {n: c for n, (_, c) in drawn.items()}


def test_anchoring_without_lines_gives_nothing(spark):
    pages = spark.createDataFrame([(1, 0, 3000, 2000, 0)], "set_id long, page_idx int, width int, height int, rotation int")
    empty = spark.createDataFrame([], LINE)
    plans = spark.createDataFrame([(1, 4000, 4000, 0)], "set_id long, width long, height long, rotation int")
    rects, canvases = anchored.anchor_sheets(pages, empty, empty.drop("page_idx"), plans)
    assert rects.count() == 0 and canvases.count() == 0
