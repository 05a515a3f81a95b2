"""Operators over tables keyed by (set_id, page_idx): DataFrames in, DataFrames out, nothing collected."""
