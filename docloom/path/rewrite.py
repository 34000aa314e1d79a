"""From query text to something that can be run: classification, legacy paths, folding, hoisting."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

from . import ast as A
from .parser import PathError, parse


@dataclass(frozen=True)
class Compiled:
    """A compiled path. ``tree``: its expression, with constants folded."""

    text: str
    tree: Any
    legacy: bool

    @property
    def projection(self) -> bool:
        """A computed result rather than nodes of the document."""
        return not (isinstance(self.tree, A.Path) and self.tree.root == "$")

    @property
    def static(self) -> bool:
        """At most one node can match: only single names and single indexes."""
        return not self.projection and all((isinstance(s, A.Names) and len(s.names) == 1) or (isinstance(s, A.Indexes) and len(s.indexes) == 1) for s in self.tree.steps)

    @property
    def steps(self) -> tuple:
        return () if self.projection else self.tree.steps


def is_jsonpath(text: str) -> bool:
    """Whether a path is in the new style; anything else is a legacy path."""
    if text.startswith("$"):
        return True
    try:
        tree = parse(text)
    except PathError:
        return False
    return mentions_root(tree)


def mentions_root(tree: Any) -> bool:
    if isinstance(tree, A.Path):
        return tree.root == "$"
    if isinstance(tree, A.Binary):
        return mentions_root(tree.left) or mentions_root(tree.right)
    if isinstance(tree, A.Unary):
        return mentions_root(tree.value)
    if isinstance(tree, A.Call):
        return any(map(mentions_root, tree.args))
    return False


def normalised(text: str) -> tuple[str, bool]:
    """(path in the new style, whether it was a legacy one)."""
    if is_jsonpath(text):
        return text, False
    if text == ".":
        return "$", True
    return ("$" if text.startswith((".", "[")) else "$.") + text, True


def folded(tree: Any) -> Any:
    """Constant arithmetic done once, here."""
    from .evaluate import NOTHING, binary, unary

    if isinstance(tree, A.Binary):
        tree = replace(tree, left=folded(tree.left), right=folded(tree.right))
        if isinstance(tree.left, A.Literal) and isinstance(tree.right, A.Literal) and tree.left.json is None and tree.right.json is None:
            got = binary(tree.op, tree.left.value, tree.right.value)
            return tree if got is NOTHING else A.Literal(got)
    elif isinstance(tree, A.Unary):
        tree = replace(tree, value=folded(tree.value))
        if isinstance(tree.value, A.Literal) and tree.value.json is None:
            got = unary(tree.op, tree.value.value)
            return tree if got is NOTHING else A.Literal(got)
    elif isinstance(tree, A.Call):
        return replace(tree, args=tuple(map(folded, tree.args)))
    elif isinstance(tree, A.Compare):
        return replace(tree, left=folded(tree.left), right=folded(tree.right))
    elif isinstance(tree, A.Exists):
        return replace(tree, value=folded(tree.value))
    elif isinstance(tree, A.Not):
        return replace(tree, test=folded(tree.test))
    elif isinstance(tree, (A.And, A.Or)):
        return replace(tree, tests=tuple(map(folded, tree.tests)))
    elif isinstance(tree, A.Path):
        return replace(tree, steps=tuple(map(folded, tree.steps)))
    elif isinstance(tree, A.Filter):
        return replace(tree, test=folded(tree.test))
    elif isinstance(tree, A.Descend):
        return replace(tree, selector=folded(tree.selector))
    return tree


@lru_cache(maxsize=4096)
def compile_path(text: str) -> Compiled:
    """Compile a path of either style; raises :class:`PathError`."""
    path, legacy = normalised(text)
    return Compiled(text, folded(parse(path)), legacy)
