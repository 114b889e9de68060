"""Relational operators: each turns bound nodes into DataFrame operations and leaves the physical strategy to Catalyst."""

from .relational import lower

__all__ = ["lower"]
