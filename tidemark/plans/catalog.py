"""All registered queries over the catalogue tables, and their SQL."""

from tidemark.plans import catalog_groups, catalog_io, catalog_models, catalog_rows  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
