"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from . import archive_queries, model_queries, series_queries, source_queries, space_queries, stream_queries, table_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "station_daily"
