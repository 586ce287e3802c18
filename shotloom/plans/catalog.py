"""All named queries.  Importing the modules registers them."""

from __future__ import annotations

from . import (  # noqa: F401
    audio_queries, join_queries, log_queries, measure_queries, review_queries, search_queries, series_queries, sound_queries, style_queries,
    stream_queries, text_queries, timeline_queries)
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "find_attributes"
