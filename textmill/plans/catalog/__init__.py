"""All queries by name, with the SQL that checks them."""

from textmill.plans.catalog import control, documents, ingest, metrics, search, streams  # noqa: F401
from textmill.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
