"""Ridgeline: hazard analytics over elevation rasters and feature tables, as Spark jobs."""
