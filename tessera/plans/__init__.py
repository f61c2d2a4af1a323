"""All queries of the library by name, with their SQL."""

from . import project_tables, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "project_tables", "tables"]
