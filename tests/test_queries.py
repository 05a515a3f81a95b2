"""Queries against DuckDB on the smallest tables, and the planted layout."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sheetloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["s2_validate_suffix", "c1_orient_grid_lines", "c7_shift_and_clip_to_crop", "c9_keep_monotone_names", "b5_grid_crop_area", "b7_stripe_widths", "g13_line_intersection", "j3_pair_grid_transforms", "j6_knn_ratio_match", "t2_fit_robust", "t9_best_pair_transform", "p2_spanning_forest", "p8_overlap_regions", "r2_mask_text", "o2_pair_order_stats", "o7_acceptable_placement", "a1_rotate_grids", "a4_select_scale", "s3_read_entity_json", "s4_write_placements", "a8_disjoint_anchor_pairs", "w3_anchor_to_overall", "j4_page_pair_candidates", "j5_stripe_pair_candidates", "j8_shared_labels"]


def rows(frame):
    names = sorted(frame.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return names, sorted((tuple(clean(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for table in ("nation", "orders", "lineitem", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(engine.sql(ORACLE_SQL[name]).df())


def test_flagship_recovers_the_planted_layout(spark):
    from sheetloom.queries.fixture import view

    placed = entry.entry(spark).toPandas()
    pages = view(spark, DATA, "pages").toPandas()
    crops = QUERIES["b3_select_crop_regions"](spark, DATA).toPandas()
    rows_ = placed.merge(pages, on=["set_id", "page_idx"]).merge(crops, on=["set_id", "page_idx"])
    rows_["x"] = rows_.ox + rows_.cx0 - rows_.rx0
    rows_["y"] = rows_.oy + rows_.cy0 - rows_.ry0
    spread = rows_.groupby("set_id")[["x", "y"]].agg(lambda v: v.max() - v.min())
    assert len(rows_) == len(placed) > 0 and (spread == 0).all().all()


def test_no_query_without_its_tables(spark):
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert os.path.isdir(Path(DATA))
