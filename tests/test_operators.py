"""Hand-made cases: quirks, ties, gaps and broken input."""

import json
import math
import random

from pyspark.sql import functions as F

from sheetloom.functions import geometry as g
from sheetloom.operators import clean, fit, graph, match, place, raster
from sheetloom.sources import manifests

LINE = "set_id long, page_idx int, line_ord int, text string, bx0 long, by0 long, bx1 long, by1 long, gx0 long, gy0 long, gx1 long, gy1 long"


def line(page, order, text, x0, y0, x1, y1):
    return (1, page, order, text, 0, 0, 1, 1, x0, y0, x1, y1)


def test_duplicate_labels_are_counted_before_short_lines_go(spark):
    rows = [line(0, 0, " d ", 0, 0, 0, 50), line(0, 1, "D", 9, 0, 9, 500), line(0, 2, "E", 20, 500, 20, 0), line(0, 3, None, 30, 0, 30, 400)]
    kept = clean.clean_grid_lines(spark.createDataFrame(rows, LINE)).collect()
    assert sorted((r.text or "", r.gy0, r.gy1) for r in kept) == [("", 0, 400), ("E", 0, 500)]


def test_longest_run_of_names(spark):
    rows = [line(0, k, t, x, 0, x, 500) for k, (t, x) in enumerate([("A", 1), ("C", 2), ("B", 3), ("D", 4), ("A.5", 5)])]
    kept = clean.keep_monotone_names(clean.split_by_axis(spark.createDataFrame(rows, LINE))).collect()
    assert len(kept) == 3 and [r.name_rank for r in sorted(kept, key=lambda r: r.name)] == [0, 1, 2]


def test_tree_of_disconnected_sets_keeps_the_smallest_page(spark):
    edges = spark.createDataFrame([(1, 0, 2, 0.5), (1, 3, 4, 0.1), (1, 2, 5, 0.5), (1, 0, 5, 0.5)], "set_id long, i int, j int, weight double")
    assert {(r.i, r.j) for r in graph.spanning_forest(edges).collect()} == {(3, 4), (0, 2), (0, 5)}
    assert [(r.parent, r.child) for r in graph.stitch_sequence(edges).orderBy("seq").collect()] == [(0, 2), (0, 5)]


def forest_by_hand(edges):
    up, kept = {}, []

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for w, i, j in sorted((w, i, j) for i, j, w in edges):
        if top(i) != top(j):
            up[top(i)] = top(j)
            kept.append((i, j, w))
    return kept


def sequence_by_hand(tree):
    near = {}
    for i, j, _ in tree:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    depth, queue, out = {min(near): 0}, [min(near)], []
    for page in queue:
        for other in sorted(near[page]):
            if other not in depth:
                depth[other] = depth[page] + 1
                queue.append(other)
                out.append((page, other, depth[other]))
    return out


def graphs():
    """Chains, stars, random and disconnected graphs, with many equal weights."""
    rng = random.Random(5)
    chain = list(range(60))
    rng.shuffle(chain)
    yield 1, [(min(a, b), max(a, b), 0.5) for a, b in zip(chain, chain[1:])]
    yield 2, [(min(7, k), max(7, k), 1.0 / (k % 3 + 1)) for k in range(40) if k != 7]
    for n in range(3, 9):
        edges = {(i, j): rng.randint(1, 4) / 4 for i, j in (sorted(rng.sample(range(n * 6), 2)) for _ in range(n * 9))}
        yield n, [(i, j, w) for (i, j), w in edges.items()]
    yield 9, [(4, 9, 1.0)]


def test_trees_and_walks_of_graphs(spark):
    sets = dict(graphs())
    edges = spark.createDataFrame([(n, *e) for n, own in sets.items() for e in own], "set_id long, i int, j int, weight double")
    want = {n: forest_by_hand(own) for n, own in sets.items()}
    assert {(r.set_id, r.i, r.j, r.weight) for r in graph.spanning_forest(edges).collect()} == {(n, *e) for n, own in want.items() for e in own}
    found = sorted((r.set_id, r.seq, r.parent, r.child, r.depth) for r in graph.stitch_sequence(edges).collect())
    assert found == [(n, k, *row) for n, own in sorted(want.items()) for k, row in enumerate(sequence_by_hand(own))]
    assert graph.spanning_forest(edges.limit(0)).count() == 0 and graph.stitch_sequence(edges.limit(0)).count() == 0


def test_turned_and_scaled_transforms_are_composed(spark):
    rng = random.Random(6)
    pairs, sequence, want = [], [], {}
    for n in range(3):
        placed = {0: (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)}
        for k in range(1, 40):
            parent = k - 1 if n == 0 else rng.randrange(k)
            turn, scale = rng.choice([(1, 0), (0, 1), (-1, 0), (0, -1)]), rng.choice([1.0, 1.0, 2.0, 0.5])
            a, c = turn[0] * scale, turn[1] * scale
            h = (a, -c, float(rng.randint(-50, 50)), c, a, float(rng.randint(-50, 50)))
            sequence.append((n, k - 1, parent, k, 1 if parent == 0 else 2))
            if n == 2 and k == 20:  # no transform is known for this page, so its children start anew
                continue
            back = rng.random() < 0.5
            det = h[0] * h[4] - h[1] * h[3]
            inverse = (h[4] / det, -h[1] / det, (h[1] * h[5] - h[4] * h[2]) / det, -h[3] / det, h[0] / det, (h[3] * h[2] - h[0] * h[5]) / det)
            pairs.append((n, parent, k, *inverse) if back else (n, k, parent, *h))
            p = placed.get(parent, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
            placed[k] = (p[0] * h[0] + p[1] * h[3], p[0] * h[1] + p[1] * h[4], p[0] * h[2] + p[1] * h[5] + p[2], p[3] * h[0] + p[4] * h[3], p[3] * h[1] + p[4] * h[4], p[3] * h[2] + p[4] * h[5] + p[5])
        dx, dy = (min(0.0, *(p[k] for p in placed.values())) for k in (2, 5))
        want |= {(n, k): (p[0], p[1], p[2] - dx, p[3], p[4], p[5] - dy) for k, p in placed.items()}
    found = graph.compose_placements(
        spark.createDataFrame(sequence, "set_id long, seq int, parent int, child int, depth int"), spark.createDataFrame(pairs, "set_id long, i int, j int, a double, b double, tx double, c double, d double, ty double")
    )
    got = {(r.set_id, r.page_idx): (r.a, r.b, r.tx, r.c, r.d, r.ty) for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(x - y) <= 1e-6 * max(1, abs(y)) for k in want for x, y in zip(got[k], want[k]))


def longest_by_hand(keys):
    """Length of the longest rising subsequence."""
    best = [1] * len(keys)
    for k in range(len(keys)):
        best[k] = 1 + max((best[m] for m in range(k) if keys[m] < keys[k]), default=0)
    return max(best, default=0)


def test_runs_of_names_are_longest(spark):
    rng = random.Random(8)
    pages = {p: [f"{rng.choice('AbC')}{rng.randint(1, 9)}.{rng.randint(0, 3)}" for _ in range(rng.randint(1, 25))] for p in range(12)}
    rows = [line(p, k, t, 10 * k, 0, 10 * k, 500) for p, own in pages.items() for k, t in enumerate(own)]
    found = {}
    for r in clean.keep_monotone_names(clean.split_by_axis(spark.createDataFrame(rows, LINE))).collect():
        found.setdefault(r.page_idx, []).append((r.name_idx, tuple(r.name), r.coord, r.text))
    for p, own in pages.items():
        keys = [(t[0].lower(), int(t[1]), float("0" + t[2:])) for t in own]
        up, down = longest_by_hand(keys), longest_by_hand(keys[::-1])
        run = sorted(found[p])
        assert len(run) == max(up, down) and [c for _, _, c, _ in run] == sorted(c for _, _, c, _ in run)
        pairs = list(zip(run, run[1:]))
        assert all(a[1] < b[1] for a, b in pairs) if up > down else all(a[1] > b[1] for a, b in pairs)


def test_turned_and_scaled_points_are_fitted(spark):
    rng, rows, want = random.Random(9), [], {}
    for n, (turn, scale) in enumerate([(0, 1), (179.9, 1), (-90, 2), (33.3, 0.4), (90, 1), (-0.2, 1.01)]):
        a, c = scale * math.cos(math.radians(turn)), scale * math.sin(math.radians(turn))
        want[n] = (a, c, 300.0, -20.0)
        for k in range(60):
            x, y = rng.uniform(0, 3000), rng.uniform(0, 2000)
            u, v = a * x - c * y + 300, c * x + a * y - 20
            if k % 5 < 2:  # two fifths are elsewhere
                u, v = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
            rows.append((n, 0, 1, x, y, u + rng.uniform(-0.5, 0.5), v + rng.uniform(-0.5, 0.5)))
    rows += [(90, 0, 1, 5.0, 5.0, 7.0, 7.0), (91, 0, 1, 5.0, 5.0, 7.0, 7.0), (91, 0, 1, 5.0, 5.0, 9.0, 7.0)]  # one point, and equal ones
    fits = fit.fit_turned(spark.createDataFrame(rows, "set_id long, i int, j int, x double, y double, to_x double, to_y double")).collect()
    assert {r.set_id for r in fits} == set(want)
    for r in fits:
        a, c, tx, ty = want[r.set_id]
        assert abs(r.a - a) < 1e-3 and abs(r.c - c) < 1e-3 and abs(r.tx - tx) < 2 and abs(r.ty - ty) < 2 and 36 <= r.n <= 38
        assert abs(math.cos(math.radians(r.rot)) - a / math.hypot(a, c)) < 1e-3


def test_inclined_lines(spark):
    box = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(
        g.line_intersection(box(0, 0, 10, 10), box(0, 10, 10, 0)).alias("x"),
        g.line_intersection(box(5, 0, 5, 10), box(0, 0, 10, 10)).alias("v"),
        g.line_intersection(box(0, 0, 10, 10), box(0, 1, 10, 11)).alias("n"),
        g.line_intersection(box(0, 0, 4, 0), box(9, 5, 9, 8)).alias("far"),
    ).first()
    assert tuple(row.x) == (True, 5.0, 5.0) and tuple(row.v) == (True, 5.0, 5.0) and row.n.x is None and tuple(row.far) == (False, 9.0, 0.0)


def test_one_neighbour_gives_no_match(spark):
    points = [(1, 0, 2, 7, 0.0, 0.0, [1.0, 0.0]), (1, 1, 1, 8, 0.0, 0.0, [1.0, 0.0])]
    table = spark.createDataFrame(points, "set_id long, page_idx int, stripe int, kp_id long, x double, y double, vec array<float>")
    wanted = spark.createDataFrame([(1, 0, 1, 2, 1)], "set_id long, i int, j int, stripe_i int, stripe_j int")
    assert match.knn_ratio_match(table, wanted).count() == 0


def test_json_sources_keep_places_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "A", "bbox": [0, 0, 1, 1], "grid": [0, 0, 0, 9]}, {"text": "B", "bbox": [0, 0, 1, 1], "grid": [5, 0, 5, 9]}]))
    (tmp_path / "b.json").write_text("{broken")
    files = spark.createDataFrame([(1, 0, "grid_lines", "a.json"), (1, 1, "grid_lines", "b.json"), (1, 2, "grid_lines", "c.txt")], "set_id long, page_idx int, kind string, file_key string")
    assert [r.error for r in manifests.validate_suffix(files).orderBy("page_idx").collect()] == [None, None, "suffix"]
    read = manifests.read_entity_json(spark, files, "grid_lines", str(tmp_path), str(tmp_path))
    assert {r.page_idx for r in read.collect()} == {0, 1, 2}
    assert [(r.line_ord, r.text) for r in manifests.grid_rows(read).orderBy("line_ord").collect()] == [(0, "A"), (1, "B")]
    manifests.write_json_results(read.select("set_id", "text"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == read.count()


def test_pixels_meet_rectangles_through_cells(spark):
    draw = random.Random(7)
    spots = {(0, draw.randrange(700), draw.randrange(500)) for _ in range(3000)} | {(0, 100 + k % 40, 60 + k // 40) for k in range(1600)} | {(1, 5000 + 37 * k, 4090 + k) for k in range(60)}
    pixels = spark.createDataFrame([(1, p, x, y, 0, 0, 0, f"m{x}") for p, x, y in spots], "set_id long, page_idx int, x long, y long, r int, g int, b int, fx string")
    boxes = []
    for _ in range(60):
        x, y = draw.randrange(-20, 700), draw.randrange(-20, 500)
        boxes.append((0, x, y, x + draw.choice([-3, 0, 1, 16, 90, 400]), y + draw.choice([-3, 0, 1, 16, 90, 400])))
    boxes += [(1, 0, 0, 9000, 9000), (1, 5000, 4090, 5001, 4091), (2, 0, 0, 9, 9), (0, 96, 48, 160, 112)]
    parts = spark.createDataFrame([(1, k, 1000, *box) for k, box in enumerate(boxes)], "set_id long, i int, j int, page_idx int, ox0 long, oy0 long, ox1 long, oy1 long")
    texts = spark.createDataFrame([(1, p, x0 + 0.7, y0 + 0.2, x1 + 0.9, y1 + 0.0) for p, x0, y0, x1, y1 in boxes[:12] + boxes[-3:] if x0 >= 0 and y0 >= 0 and x1 >= 0 and y1 >= 0], "set_id long, page_idx int, x0 double, y0 double, x1 double, y1 double")
    inside = lambda b, s: b[0] == s[0] and b[1] <= s[1] < b[3] and b[2] <= s[2] < b[4]
    for most in (4, 256):
        weights = {r.i: r.region_weight for r in place.overlap_weights(parts, pixels, most=most).collect()}
        assert weights == {k: sum(inside(box, s) for s in spots) for k, box in enumerate(boxes)}
        left = {(r.page_idx, r.x, r.y) for r in raster.mask_text(pixels, texts, most=most).collect()}
        cut_boxes = [(t.page_idx, int(t.x0), int(t.y0), int(t.x1) + 1, int(t.y1) + 1) for t in texts.collect()]
        assert left == {s for s in spots if not any(inside(box, s) for box in cut_boxes)}
    assert raster.mask_text(pixels, texts.limit(0)).columns == pixels.columns
    assert place.overlap_weights(parts.limit(0), pixels).count() == 0
    assert {r.region_weight for r in place.overlap_weights(parts, pixels.limit(0)).collect()} == {0}


def test_pivots_leave_out_blocks_but_no_match(spark):
    draw = random.Random(3)
    centres = [[40.0 * (k == d) for d in range(8)] for k in range(8)]
    rows = []
    for page in (0, 1):
        for k in range(240):
            vec = [c + draw.gauss(0, 1) for c in centres[k % 8]]
            rows.append((1, page, 1, page * 1000 + k, float(k), float(page), vec))
    first = {r[3]: r for r in rows}
    rows += [(1, 1, 1, 1900 + k, 0.0, 0.0, [v + 0.01 for v in first[k][6]]) for k in range(30)]  # clear matches
    rows += [(1, 1, 1, 1950, 0.0, 0.0, first[3][6]), (1, 1, 1, 1951, 0.0, 0.0, first[3][6])]  # two equal ones: none
    rows += [(1, 2, 1, 2000, 0.0, 0.0, centres[0])]
    table = spark.createDataFrame(rows, "set_id long, page_idx int, stripe int, kp_id long, x double, y double, vec array<double>")
    wanted = spark.createDataFrame([(1, 0, 1, 1, 1), (1, 0, 2, 1, 1), (1, 1, 2, 1, 1)], "set_id long, i int, j int, stripe_i int, stripe_j int")
    expected = {}
    for r in rows[:240]:
        near = sorted((math.dist(r[6], o[6]), o[3]) for o in rows if o[1] == 1)[:2]
        if near[0][0] < 0.7 * near[1][0]:
            expected[r[3]] = near[0][1]
    assert 20 < len(expected) and 3 not in expected
    for block in (24, 1024):
        found = match.knn_ratio_match(table, wanted, block=block).collect()
        assert {(r.i, r.j, r.kp_i): r.kp_j for r in found} == {(0, 1, a): b for a, b in expected.items()}
    pairs = match.block_pairs(match.descriptor_blocks(table, 24), wanted).where("j = 1").groupBy("needed").count().collect()
    count = {r.needed: r["count"] for r in pairs}
    assert count[False] > count[True]
    assert match.knn_ratio_match(table.limit(0), wanted).count() == 0
