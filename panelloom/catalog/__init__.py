"""All registered queries."""

import importlib

from panelloom.catalog.registry import ORACLES, QUERIES

for _module in ["q_sources", "q_prepare", "q_aggregates", "q_sequences", "q_statistics", "q_scenarios", "q_inference", "q_models"]:
    importlib.import_module(f"panelloom.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
