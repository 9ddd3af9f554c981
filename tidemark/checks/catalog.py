"""Imports every query module, so the registry is complete."""

from __future__ import annotations

from tidemark.checks import analytics, relational, scalars, texts  # noqa: F401
from tidemark.checks.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
