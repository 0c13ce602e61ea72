"""Runnable queries, one per capability, with the SQL that must give the same rows."""

from __future__ import annotations

from fieldweave.catalog import aggregate, cell, composite, join, project, scalar, source_sink, stream  # noqa: F401
from fieldweave.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
