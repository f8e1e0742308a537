"""All queries of the barcode operators."""

from . import catalog, file_catalog  # noqa: F401
from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
