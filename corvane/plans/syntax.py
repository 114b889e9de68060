"""What the grammar yields. Every node keeps the token that it is reported at."""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import Token


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool
    at: Token


@dataclass(frozen=True)
class Name:
    qualifier: str | None
    name: str
    at: Token


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr
    at: Token


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    at: Token


@dataclass(frozen=True)
class Call:
    """An aggregate; argument None is COUNT(*)."""

    function: str
    argument: Expr | None
    at: Token


Expr = Literal | Name | Unary | Binary | Call


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None
    at: Token


@dataclass(frozen=True)
class Join:
    kind: str  # "inner" or "left"
    source: Source
    condition: Expr


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Query:
    #: None is SELECT *.
    items: tuple[Item, ...] | None
    star: Token | None
    source: Source
    joins: tuple[Join, ...]
    where: Expr | None
    group_by: tuple[Expr, ...]
    order_by: tuple[Order, ...]
    limit: int | None
