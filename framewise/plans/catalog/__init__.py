"""All queries; importing the modules registers them."""

from framewise.plans.catalog import (
    aggregates,
    boxes,
    columns,
    files,
    matching,
    scenes,
    streams,
    time_text,
)
from framewise.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "aggregates", "boxes", "columns", "files", "matching", "scenes", "streams", "time_text",
]
