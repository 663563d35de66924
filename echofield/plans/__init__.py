"""Queries over the driver's tables, with SQL for each that SQL can express."""

from . import decoding, points, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decoding", "points", "streams"]
