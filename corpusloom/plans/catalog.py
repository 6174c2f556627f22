"""Importing this module registers every query."""

import importlib

from corpusloom.plans.registry import ORACLES, QUERIES

for _part in ("search", "hybrid", "indexing", "chunks", "dialogues", "planning", "datasets", "scoring", "requests", "scopes"):
    importlib.import_module(f"corpusloom.plans.{_part}")

__all__ = ["ORACLES", "QUERIES"]
