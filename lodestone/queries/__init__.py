"""Registered queries, one or more for each operator, and the SQL that says the same."""

from lodestone.queries import algebra, examples, learning, library, more, rows, statistics  # noqa: F401
from lodestone.queries.registry import QUERIES, SQL  # noqa: F401
