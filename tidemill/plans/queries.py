"""All registered queries over the fixture tables, with the SQL that checks each."""

from __future__ import annotations

from tidemill.plans import connectors, data, helpers, news, scalars, sources, streams, works  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
