"""Registered queries and their DuckDB oracles."""

from . import kernels
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "kernels"]
