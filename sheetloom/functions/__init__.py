"""Column expressions for points, lines, rectangles and affine transforms."""
