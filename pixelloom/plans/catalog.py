"""All queries over the driver tables, each with its DuckDB counterpart where SQL has one."""

from . import classification, correction, indices, matching, quality, transforms  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
