"""A small neutral syntax tree: what lineage needs to know of a query, and nothing of the parser it came from."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names and types of a struct's fields; a type may be unknown, and None in place of the tuple means an unknown shape.
Fields = tuple[tuple[str, str | None], ...]


@dataclass(frozen=True)
class Expr:
    """An expression. text is its SQL and fields the struct shape that it states literally; both are known of outer expressions only."""

    text: str = field(default="", kw_only=True)
    fields: Fields | None = field(default=None, kw_only=True)


@dataclass(frozen=True)
class Name(Expr):
    """A column, or a path that starts at one: a, t.a, t.a.b."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class Path(Expr):
    """A path with subscripts: the column under it, and the expressions in its subscripts."""

    base: Expr
    inner: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Parts(Expr):
    """Any construct whose sources are those of its parts, in order."""

    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Silent(Expr):
    """A construct that contributes no sources: literals, window calls, subqueries and what is not known."""


@dataclass(frozen=True)
class Item:
    """An entry of a select list."""

    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Star:
    """* or alias.*; limited where some columns are excepted or replaced."""

    alias: str | None = None
    limited: bool = False


@dataclass(frozen=True)
class Relation:
    """An entry of FROM; parts is None for what is no plain table (a subquery, a table function)."""

    alias: str
    parts: tuple[str, ...] | None


@dataclass(frozen=True)
class Select:
    items: tuple[Item | Star, ...]
    relations: tuple[Relation, ...]
    joins: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cte:
    name: str
    query: Query
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Query:
    """body is None where it is no SELECT: a set operation, VALUES and the like."""

    ctes: tuple[Cte, ...]
    body: Select | None
