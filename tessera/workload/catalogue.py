"""Collects every registered query."""
from tessera.workload import columns, delegated, proposals, scans, sheets, stores, streams, values, wiki  # noqa: F401
from tessera.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
