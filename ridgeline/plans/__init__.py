"""Registered queries and their SQL in DuckDB's dialect."""

from . import areas, buildings, files, floods, hazards, layers, requests, terrains, tiles, waters

PARTS = (hazards, terrains, areas, buildings, floods, layers, tiles, waters, requests, files)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
