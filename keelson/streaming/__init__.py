"""Column-only operators (fixed-parameter scoring) on streaming DataFrames."""
