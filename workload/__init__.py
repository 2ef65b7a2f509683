"""Queries that run the library's jobs over the supplied tables, each with an independent SQL restatement."""

import importlib

from workload.registry import ORACLES, QUERIES

for _part in ("ratios", "facts", "labels", "reports", "state", "links", "records"):
    if importlib.util.find_spec(f"workload.{_part}"):
        importlib.import_module(f"workload.{_part}")

__all__ = ["ORACLES", "QUERIES"]
