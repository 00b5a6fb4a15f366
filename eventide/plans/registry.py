"""All registered queries of the event-study engine with their SQL twins."""

from __future__ import annotations

from eventide.plans import bars_queries, directional_queries, family_queries, job_queries, panel_queries, source_queries  # noqa: F401  (they register)
from eventide.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
