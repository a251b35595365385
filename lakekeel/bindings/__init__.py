"""Each operator bound to the test tables, next to the SQL that gives the same rows."""

from lakekeel.bindings import flows, joins, nested, projections, rules, scans, streams, upserts  # noqa: F401
from lakekeel.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
