"""Registered queries over the provided tables, each with its SQL twin."""

import importlib

from workload.registry import ORACLES, QUERIES

for _topic in ("features", "backtest", "market", "scores", "studies", "audit", "sources", "models"):
    importlib.import_module(f"workload.q_{_topic}")

__all__ = ["ORACLES", "QUERIES"]
