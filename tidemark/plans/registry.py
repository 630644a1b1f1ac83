"""All registered queries by their name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from tidemark.plans.catalog import ORACLES, QUERIES

for _section in ("sources", "rules", "joins", "aggregates", "statistics", "features", "flow", "labels", "ranking", "scalars", "streams", "plugins", "flagship"):
    importlib.import_module(f"tidemark.plans.q_{_section}")

__all__ = ["ORACLES", "QUERIES"]
