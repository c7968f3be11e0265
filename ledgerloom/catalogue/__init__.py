"""Named queries over the fixture tables, and the SQL they are compared with."""

from __future__ import annotations

from . import questions, retrieval, rows, stores, tables, texts  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
