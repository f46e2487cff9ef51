"""Operators over rasters, runs, segments and layouts: DataFrames in, DataFrames out."""
