"""All queries of the library's own operators."""

from . import details, pages, search, text, work  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
