"""All queries of the annotation engine and their SQL."""

from __future__ import annotations

from . import contact_queries, context_queries, detection_queries, entity_queries, identity_queries, label_queries, package_queries, record_queries, report_queries, review_queries, round_queries, stitch_queries, track_queries, tracking_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
