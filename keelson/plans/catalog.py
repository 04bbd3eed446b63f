"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import flagship, pipelines, q_eval, q_large, q_models, q_tabular  # noqa: F401
from .registry import INVENTORY, ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "INVENTORY"]
