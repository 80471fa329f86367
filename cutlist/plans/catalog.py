"""All registered queries of the media operators, and their SQL, over the stand-ins of sources.adapters."""

from __future__ import annotations

from . import chunk_queries, cue_queries, file_queries, format_queries, marker_queries, packet_queries, scalar_queries, session_queries, track_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (chunk_queries, packet_queries, track_queries, marker_queries, cue_queries, scalar_queries, session_queries, file_queries, format_queries):
    QUERIES |= _part.REGISTRY.queries
    ORACLE_SQL |= _part.REGISTRY.sql

FLAGSHIP = "hls_plan"
