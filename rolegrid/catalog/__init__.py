"""Registered queries. Importing this package fills the registry."""

from rolegrid.catalog import checks, discovery, jobs, merges, reads, telemetry, texts, whole, windows  # noqa: F401
from rolegrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
