"""All registered queries with their DuckDB SQL."""

from gridloom.plans import build_queries, colour_queries, detail_queries, format_queries, mosaic_queries, pack_queries, pixel_queries, policy_queries, report_queries, study_queries, tile_queries

_MODULES = (tile_queries, pixel_queries, policy_queries, study_queries, colour_queries, pack_queries, build_queries, format_queries, mosaic_queries, report_queries, detail_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
