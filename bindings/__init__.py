"""Queries over the driver's tables: each operator bound to data, with its SQL twin."""

from bindings.registry import ORACLES, QUERIES  # noqa: F401
from bindings import (  # noqa: F401
    aggregates, cleaning, features, geometry, jobs, joins, learning, rasters, sources, splits, windows,
)
