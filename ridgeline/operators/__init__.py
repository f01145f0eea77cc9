"""Operators over rasters, features and scenarios; each takes and gives DataFrames."""
