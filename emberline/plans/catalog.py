"""All domain queries and their SQL, by name."""

from . import assembly, fires, labels, lake, passes, pixels, rasters, regions, series, stacks, streams, tables, training  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
