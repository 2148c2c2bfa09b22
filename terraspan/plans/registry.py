"""The queries of the library and their oracles in SQL."""

from __future__ import annotations

from . import demo_scene, geo_queries, raster_queries, scene_queries, source_queries, state_queries

MODULES = (raster_queries, geo_queries, scene_queries, state_queries, source_queries, demo_scene)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}
