"""The error that queries raise."""

from __future__ import annotations


class QueryError(Exception):
    """A query that can't be read or bound; line and column count from 1."""

    def __init__(self, message: str, line: int = 1, column: int = 1):
        super().__init__(message, line, column)
        self.message, self.line, self.column = message, line, column

    def __str__(self) -> str:
        return f"{self.line}:{self.column}: {self.message}"
