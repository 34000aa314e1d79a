"""Syntax tree of a path query. All nodes are hashable values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Names:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Indexes:
    indexes: tuple[int, ...]


@dataclass(frozen=True)
class Slice:
    start: int | None
    stop: int | None
    step: int


@dataclass(frozen=True)
class Wildcard:
    pass


@dataclass(frozen=True)
class Filter:
    test: Any


@dataclass(frozen=True)
class Descend:
    """``..`` with the selector that follows it."""

    selector: Any


@dataclass(frozen=True)
class Path:
    root: str  # "$" or "@"
    steps: tuple[Any, ...]


@dataclass(frozen=True)
class Literal:
    """A constant; containers are held as JSON text so that the tree stays hashable."""

    value: Any
    json: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / %
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    value: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Exists:
    value: Any


@dataclass(frozen=True)
class Not:
    test: Any


@dataclass(frozen=True)
class And:
    tests: tuple[Any, ...]


@dataclass(frozen=True)
class Or:
    tests: tuple[Any, ...]
