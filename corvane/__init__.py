"""A small SQL dialect and its operators on Spark DataFrames."""

from .engine import Engine
from .errors import QueryError

__all__ = ["Engine", "QueryError"]
