"""Every query by name, with the SQL that checks it where SQL can."""

from tsengine.plans.catalog import collections, features, forecasting, panels, records, scores, windowed
from tsengine.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collections", "features", "forecasting", "panels", "records", "scores", "windowed"]
