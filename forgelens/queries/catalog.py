"""All registered queries."""

from forgelens.queries import dependencies, files, history, metrics  # noqa: F401
from forgelens.queries.common import QUERIES

__all__ = ["QUERIES"]
