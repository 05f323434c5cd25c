"""Registered queries: every operator on the shared tables, with the SQL that must give the same rows."""

from loomdex.plans.catalog import chunks, conversion, registry, search  # noqa: F401  (registration)
from loomdex.plans.catalog.base import ENTRIES

__all__ = ["ENTRIES"]
