"""Steps that go through pages instead of points: the same rows, without the joins and files that grew too large."""

import os
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheetloom.operators import fit, points
from sheetloom.plans import cut, shared_folder
from sheetloom.queries import QUERIES
from sheetloom.queries.fixture import view
from sheetloom.sources import manifests

DATA = "/root/testdata/sf0.001"
LINE = "set_id long, page_idx int, line_ord int, text string, gx0 long, gy0 long, gx1 long, gy1 long, line_type string"


def joined_by(frame, name):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join " in line and f"{name}#" in line]


def test_anchor_points_are_not_joined(spark):
    """F1 to F5: points of sheets get their places on the plan from the lines, not by joins of points."""
    for name in ("a8_usable_anchor_pairs", "a8_disjoint_anchor_pairs", "j10_overall_points", "a9_page_rect_vote", "w3_anchor_to_overall"):
        assert joined_by(QUERIES[name](spark, DATA), "text_h") == [], name


def test_points_of_repeated_labels(spark):
    """F8, F12: of equal labels the last lines that meet count, whatever else repeats, and null is a label like others."""
    rng, lines = random.Random(5), []
    for page in range(6):
        for k in range(14):
            text, a, b = rng.choice(["A", "B", None, "C"] if page else [f"L{k}"]), rng.randint(0, 90), rng.randint(0, 90)
            low, high = sorted(rng.sample(range(100), 2))
            lines.append((1, page, k, text, low, a, high, a, "horizontal") if k % 2 else (1, page, k, text, b, high, b, low, "vertical"))
    best = {}
    for _, page, k, text, x0, y0, x1, y1, kind in lines:
        for _, other, m, label, u0, v0, u1, v1, upright in lines:
            near = lambda lo, at, hi: lo <= at - 1 <= hi or lo <= at + 1 <= hi
            if page == other and (kind, upright) == ("horizontal", "vertical") and near(x0, u0, x1) and near(v1, y0, v0):
                best[page, text, label] = max(best.get((page, text, label), (-1,)), (k, m, u0, y0))
    found = points.page_hv_points(spark.createDataFrame(lines, LINE))
    rows = found.collect()
    assert {(r.page_idx, r.text_h, r.text_v, r.x, r.y) for r in rows} == {(*key, *value[2:]) for key, value in best.items()} and len(rows) == len(best) > 20
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_points_by_pages_and_by_labels(spark):
    """F7, F9 to F19: pages that meet with their lines share the points that labels find, also with inclined, coinciding and turned lines."""
    rng, lines = random.Random(8), []
    for set_id in range(1, 7):
        for page in range(4):
            for k in range(9):
                text, at, turned = rng.choice("ABCDEFGH"), rng.randint(0, 900), set_id > 2 and page == 3
                ends = (at, 10, at, 900) if (k % 2 == 0) != turned else (10, at, 900, at)
                if set_id == 5 and k == 0:
                    ends = (10, 20, 700, at)
                lines.append((set_id, page, k, text, *ends, ""))
                if set_id == 6 and k == 1:
                    lines.append((set_id, page, 20, "Z" if page else "Y", *ends, ""))
    frame = spark.createDataFrame(lines, LINE)
    crops = frame.select("set_id", "page_idx").distinct().select("*", *[F.lit(v).cast("long").alias(c) for c, v in (("cx0", 3), ("cy0", 5), ("cx1", 950), ("cy1", 950))])
    names = ["set_id", "i", "j", "text_a", "text_b", "x", "y", "to_x", "to_y"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*[F.round(c, 6).alias(c) if c[-1] in "xy" else c for c in names]).collect())
    want = rows(points.matched_points(points.grid_points(frame, crops)))
    assert len({r[0] for r in want}) == 6
    for most in (64, 3):
        assert rows(points.shared_points(frame, crops, most)) == want
    assert joined_by(points.shared_points(frame.where("set_id < 5"), crops), "text_a") == []


def test_votes_are_not_joined_back(spark):
    """inliers are told apart where their votes are counted."""
    rows = [(1, 0, 1, float(k), float(k), k + d, k + 2.0) for k, d in enumerate([5.0, 5.0, 9.0, 9.0, 30.0, 5.4])]
    found = fit.vote_inliers(spark.createDataFrame(rows, "set_id long, i int, j int, x double, y double, to_x double, to_y double"))
    assert sorted(r.x for r in found.collect()) == [0.0, 1.0, 5.0]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_later_steps_are_small(spark):
    """F9 to F19: what several steps read is a table of columns in the shared folder, without the shuffle files that made it."""
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert rows.count() == 10 and "Relation" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_packed_files_read_as_single_ones(spark, tmp_path):
    """no file for each set, and the same rows as from single files, broken and absent ones too."""
    texts = {"1/a.json": '[{"text":"A","bbox":[1,2,3,4],"grid":[5,6,7,8]},{"text":"\\"B\\u00e9","bbox":[1],"grid":null}]', "1/b.json": "no json", "2/a.json": "[]", "2/b.json": '[{"text":null}]'}
    for key, text in texts.items():
        os.makedirs(tmp_path / "single" / key[0], exist_ok=True)
        (tmp_path / "single" / key).write_text(text)
    manifests.write_packed(spark.createDataFrame(list(texts.items()), "file_key string, content string"), str(tmp_path / "packed"))
    files = spark.createDataFrame([(int(k[0]), 0 if "a" in k[2:3] else 1, "grid_lines", k) for k in [*texts, "3/a.json"]], "set_id long, page_idx int, kind string, file_key string")
    single = manifests.read_entity_json(spark, files, "grid_lines", str(tmp_path / "single"), f"{tmp_path}/single/*")
    packed = manifests.read_packed_json(spark, files, "grid_lines", str(tmp_path / "packed"))
    rows = lambda df: sorted(((r.set_id, r.page_idx, r.text, r.bbox, r.grid) for r in df.collect()), key=str)
    assert rows(single) == rows(packed) and len(rows(packed)) == 6
    folder = shared_folder(spark).removeprefix("file:")
    known = set(os.listdir(folder))
    QUERIES["s3_read_entity_json"](spark, DATA).count()
    made = [f for d in set(os.listdir(folder)) - known for _, _, names in os.walk(f"{folder}/{d}") for f in names if f.endswith(".gz")]
    assert 0 < len(made) < view(spark, DATA, "pages").select("set_id").distinct().count()


def test_overlays_work_out_placements_once(spark, monkeypatch):
    """one tree for the rectangles and for the count of processed pages."""
    from sheetloom.operators import graph

    calls, whole = [], graph.stitch_sequence
    monkeypatch.setattr(graph, "stitch_sequence", lambda edges: calls.append(1) or whole(edges))
    assert entry.queries()["p10_overlay_instructions"](spark, DATA).count() > 0
    assert len(calls) == 1
