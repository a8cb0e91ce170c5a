"""Stable digests of strategies, for cache keys."""

from __future__ import annotations

import ast
import hashlib
import inspect
import textwrap
import warnings
from typing import Any

from ..functions.expr import ColExpr, Condition, Custom, EntryRef, Limit, Lit, as_condition

_ALIASES: dict[type, str] = {}


def register_alias(kind: type, name: str) -> None:
    """Use name for kind in digests, so that renaming the class keeps them."""
    _ALIASES[kind] = name


def text_digest(parts: Any) -> str:
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def _name(x: Any) -> str:
    return _ALIASES.get(type(x), type(x).__name__)


def describe(node: Any) -> Any:
    """Nested tuples of a condition or expression; custom columns by their SQL text."""
    if isinstance(node, Custom):
        return "Custom", str(node.expr)
    if isinstance(node, Lit):
        return "Lit", float(node.value)
    if isinstance(node, (Condition, ColExpr)):
        own = [v for k, v in sorted(vars(node).items()) if isinstance(v, (str, int, float)) and not isinstance(v, bool)]
        kids = [describe(c) for c in node.children()]
        return (_name(node), *own, *kids, *(["no price"] if isinstance(node, Limit) and node.price is None else []), *(["entry"] if isinstance(node, EntryRef) else []))
    return repr(node)


def _plain(function: Any, above: frozenset = frozenset()) -> str:
    """Source of a function without comments, docstrings and layout, and of functions of its module that it calls.

    above holds the callers, whose source is not given again: functions may call each other.
    """
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(function)))
    except (OSError, TypeError, SyntaxError):
        return repr(function)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant):
            node.body = node.body[1:] or [ast.Pass()]
    called = sorted({n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)})
    scope = getattr(function, "__globals__", {})
    above |= {function}
    local = [_plain(f, above) for c in called if inspect.isfunction(f := scope.get(c)) and f.__module__ == function.__module__ and f not in above]
    return "\n".join([ast.unparse(tree), *local])


def strategy_artifact(strategy: Any) -> str:
    """16 hex digits of a strategy's class name, conditions and preparation."""
    for name in ("entry", "exit"):
        source = _plain(getattr(type(strategy), name))
        if "if self." in source:
            warnings.warn(f"{name} branches on the instance, so its digest holds for this instance only", stacklevel=2)
    parts = [_name(strategy), describe(as_condition(strategy.entry())), describe(as_condition(strategy.exit()))]
    if hasattr(strategy, "init"):
        parts.append(_plain(type(strategy).init))
    return text_digest(parts)


def combined_strategy_artifact(*strategies: Any) -> str:
    return text_digest([strategy_artifact(s) for s in strategies])
