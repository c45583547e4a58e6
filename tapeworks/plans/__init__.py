"""Registered queries, each with the SQL it is checked against, over market views of the given tables."""

from tapeworks.plans import bars, breadth, indicators, resolution, scalars, streaming, walkforward
from tapeworks.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bars", "breadth", "indicators", "resolution", "scalars", "streaming", "walkforward"]
