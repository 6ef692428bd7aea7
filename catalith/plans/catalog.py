"""All named queries over the tables and the SQL that says the same."""

from __future__ import annotations

import importlib
import pkgutil

from catalith import plans
from catalith.plans.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module not in ("catalog", "registry"):
        importlib.import_module(f"catalith.plans.{_module}")

__all__ = ["QUERIES", "SQL"]
