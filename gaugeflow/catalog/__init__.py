"""All registered queries."""

from gaugeflow.catalog import preparing, results, signals, testing
from gaugeflow.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "preparing", "results", "signals", "testing"]
