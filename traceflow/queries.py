"""The library's own queries and their SQL: name -> query(spark, sf_dir), name -> SQL."""

from __future__ import annotations

from traceflow.plans import avo_queries, estimation_queries, map_queries, modelling_queries, section_queries, spectral_queries, stencil_queries, survey_queries, tie_queries, trace_queries, volume_queries
from traceflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "avo_queries", "estimation_queries", "map_queries", "modelling_queries", "section_queries", "spectral_queries", "stencil_queries", "survey_queries", "tie_queries", "trace_queries", "volume_queries"]
