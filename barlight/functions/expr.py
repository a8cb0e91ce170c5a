"""Column expressions and conditions over bars.

Every node resolves to a Spark Column for a given window (lags need the bar
order), and to numpy arrays for the sequential exit scan. Nulls follow
three-valued logic; a NaN operand counts as null, so it never fires.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

Operand = Any


def known(c: Column) -> Column:
    """c as a double, null where it is NaN."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


class ColExpr:
    """Base of value expressions; arithmetic and comparisons build new nodes."""

    def column(self, w: WindowSpec) -> Column:
        raise NotImplementedError

    def values(self, frame: Frame) -> np.ndarray:
        raise NotImplementedError

    def children(self) -> list[Any]:
        return []

    def __add__(self, other: Operand) -> ColExpr:
        return BinOp("+", self, as_expr(other))

    def __radd__(self, other: Operand) -> ColExpr:
        return BinOp("+", as_expr(other), self)

    def __sub__(self, other: Operand) -> ColExpr:
        return BinOp("-", self, as_expr(other))

    def __rsub__(self, other: Operand) -> ColExpr:
        return BinOp("-", as_expr(other), self)

    def __mul__(self, other: Operand) -> ColExpr:
        return BinOp("*", self, as_expr(other))

    def __rmul__(self, other: Operand) -> ColExpr:
        return BinOp("*", as_expr(other), self)

    def __truediv__(self, other: Operand) -> ColExpr:
        return BinOp("/", self, as_expr(other))

    def __rtruediv__(self, other: Operand) -> ColExpr:
        return BinOp("/", as_expr(other), self)

    def __mod__(self, other: Operand) -> ColExpr:
        return BinOp("%", self, as_expr(other))

    def __rmod__(self, other: Operand) -> ColExpr:
        return BinOp("%", as_expr(other), self)

    def __neg__(self) -> ColExpr:
        return BinOp("-", Lit(0), self)

    def __gt__(self, other: Operand) -> Condition:
        return ValueGT(self, other)

    def __ge__(self, other: Operand) -> Condition:
        return ValueGTE(self, other)

    def __lt__(self, other: Operand) -> Condition:
        return ValueLT(self, other)

    def __le__(self, other: Operand) -> Condition:
        return ValueLTE(self, other)


@dataclass
class Frame:
    """Arrays of one instrument's bars [low, high) with pinned entry snapshots."""

    arrays: dict[str, np.ndarray]
    low: int
    high: int
    pinned: dict[str, float] = field(default_factory=dict)
    back: int = 0

    def take(self, name: str) -> np.ndarray:
        """The column `back` bars before each place; NaN before the first bar."""
        out = np.full(self.high - self.low, np.nan)
        first = max(self.low - self.back, 0)
        part = self.arrays[name][first : max(first, self.high - self.back)]
        out[len(out) - len(part) :] = part
        return out

    def shifted(self, back: int) -> Frame:
        return Frame(self.arrays, self.low, self.high, self.pinned, self.back + back)


@dataclass(frozen=True)
class Col(ColExpr):
    name: str

    def column(self, w: WindowSpec) -> Column:
        return F.col(self.name)

    def values(self, frame: Frame) -> np.ndarray:
        return frame.take(self.name)


@dataclass(frozen=True)
class Lit(ColExpr):
    value: float

    def column(self, w: WindowSpec) -> Column:
        return F.lit(self.value)

    def values(self, frame: Frame) -> np.ndarray:
        return np.full(frame.high - frame.low, float(self.value))


@dataclass(frozen=True)
class EntryRef(ColExpr):
    """Value of a column at the bar whose entry signal opened the position."""

    name: str

    def column(self, w: WindowSpec) -> Column:
        return F.col(f"_entry_{self.name}")

    def values(self, frame: Frame) -> np.ndarray:
        return np.full(frame.high - frame.low, frame.pinned[self.name])


@dataclass(frozen=True)
class BinOp(ColExpr):
    op: str
    left: ColExpr
    right: ColExpr

    def children(self) -> list[Any]:
        return [self.left, self.right]

    def column(self, w: WindowSpec) -> Column:
        a, b = self.left.column(w), self.right.column(w)
        if self.op in "+-*":
            return {"+": a + b, "-": a - b, "*": a * b}[self.op]
        # Division by zero is an infinity or NaN of doubles, not an error; the remainder has the divisor's sign.
        a, b = a.cast("double"), b.cast("double")
        if self.op == "/":
            zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
            return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
        return F.when(b == 0, F.when(a.isNotNull(), float("nan"))).otherwise(a - F.floor(F.try_divide(a, b)) * b)

    def values(self, frame: Frame) -> np.ndarray:
        a, b = self.left.values(frame), self.right.values(frame)
        with np.errstate(all="ignore"):
            return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.mod}[self.op](a, b)


def Pct(base: Operand, pct: float) -> ColExpr:
    """base moved by pct percent."""
    return BinOp("*", as_expr(base), Lit(1 + pct / 100))


def as_expr(x: Operand) -> ColExpr:
    """A column name, number or expression as an expression."""
    if isinstance(x, ColExpr):
        return x
    if isinstance(x, str):
        return Col(x)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return Lit(x)
    raise TypeError(f"a column name, number or expression is needed, not {x!r}")


Truth = tuple[np.ndarray, np.ndarray]


class Condition:
    """Base of boolean conditions; truth() gives (true, known) arrays."""

    trade_side: int | None = None

    def column(self, w: WindowSpec) -> Column:
        raise NotImplementedError

    def truth(self, frame: Frame) -> Truth:
        raise NotImplementedError

    def children(self) -> list[Any]:
        return []

    def __and__(self, other: Condition) -> Condition:
        return All(self, as_condition(other))

    def __or__(self, other: Condition) -> Condition:
        return Any_(self, as_condition(other))

    def __invert__(self) -> Condition:
        return Not(self)


class _Compare(Condition):
    """Comparison of two values; price names the level of a limit order."""

    symbol = ""

    def __init__(self, a: Operand, b: Operand):
        self.a, self.b = as_expr(a), as_expr(b)

    def children(self) -> list[Any]:
        return [self.a, self.b]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.a!r}, {self.b!r})"

    def _columns(self, a: Column, b: Column) -> Column:
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[self.symbol]

    def column(self, w: WindowSpec) -> Column:
        return self._columns(known(self.a.column(w)), known(self.b.column(w)))

    def truth(self, frame: Frame) -> Truth:
        a, b = self.a.values(frame), self.b.values(frame)
        call = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[self.symbol]
        return call(a, b), ~(np.isnan(a) | np.isnan(b))


class ValueGT(_Compare):
    symbol = ">"


class ValueGTE(_Compare):
    symbol = ">="


class ValueLT(_Compare):
    symbol = "<"


class ValueLTE(_Compare):
    symbol = "<="


PriceIsAbove, PriceIsBelow = ValueGT, ValueLT


def _all(*truths: Truth) -> Truth:
    false = np.logical_or.reduce([k & ~t for t, k in truths])
    true = np.logical_and.reduce([k & t for t, k in truths])
    return true, true | false


class _Cross(Condition):
    now, before = ValueGT, ValueLTE

    def __init__(self, a: Operand, b: Operand):
        self.a, self.b = as_expr(a), as_expr(b)

    def children(self) -> list[Any]:
        return [self.a, self.b]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.a!r}, {self.b!r})"

    def column(self, w: WindowSpec) -> Column:
        a, b = known(self.a.column(w)), known(self.b.column(w))
        was_b = b if isinstance(self.b, Lit) else F.lag(b).over(w)
        was_a = F.lag(a).over(w)
        return (a > b) & (was_a <= was_b) if self.now is ValueGT else (a < b) & (was_a >= was_b)

    def truth(self, frame: Frame) -> Truth:
        now = self.now(self.a, self.b).truth(frame)
        return _all(now, self.before(self.a, self.b).truth(frame.shifted(1)))


class Crossover(_Cross):
    """a rises above b: above now, not above on the bar before."""


class Crossunder(_Cross):
    """a falls below b."""

    now, before = ValueLT, ValueGTE


class _Trend(Condition):
    compare = ValueGT

    def __init__(self, col: Operand, period: int = 1):
        self.col, self.period = as_expr(col), period

    def children(self) -> list[Any]:
        return [self.col]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.col!r}, {self.period})"

    def column(self, w: WindowSpec) -> Column:
        a = known(self.col.column(w))
        was = F.lag(a, self.period).over(w)
        return a > was if self.compare is ValueGT else a < was

    def truth(self, frame: Frame) -> Truth:
        a, b = self.col.values(frame), self.col.values(frame.shifted(self.period))
        return (a > b if self.compare is ValueGT else a < b), ~(np.isnan(a) | np.isnan(b))


class IsRising(_Trend):
    """Above its value `period` bars ago."""


class IsFalling(_Trend):
    compare = ValueLT


class Custom(Condition):
    """A boolean Column or SQL text; for the exit scan it is computed beforehand and may not use entry snapshots."""

    def __init__(self, expr: Column | str):
        self.expr, self.name = expr, None

    def __repr__(self) -> str:
        return f"Custom({self.expr})"

    def column(self, w: WindowSpec) -> Column:
        return F.expr(self.expr) if isinstance(self.expr, str) else self.expr

    def truth(self, frame: Frame) -> Truth:
        if self.name is None:
            raise ValueError("a custom expression must be computed before the scan")
        value = frame.take(self.name)
        return value > 0, ~np.isnan(value)


class _Many(Condition):
    def __init__(self, *conditions: Condition):
        self.conditions = [as_condition(c) for c in conditions]
        if not self.conditions:
            raise ValueError("at least one condition is needed")

    def children(self) -> list[Any]:
        return self.conditions

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(repr, self.conditions))})"


class All(_Many):
    def column(self, w: WindowSpec) -> Column:
        out = self.conditions[0].column(w)
        for c in self.conditions[1:]:
            out = out & c.column(w)
        return out

    def truth(self, frame: Frame) -> Truth:
        return _all(*(c.truth(frame) for c in self.conditions))


class Any_(_Many):
    def column(self, w: WindowSpec) -> Column:
        out = self.conditions[0].column(w)
        for c in self.conditions[1:]:
            out = out | c.column(w)
        return out

    def truth(self, frame: Frame) -> Truth:
        parts = [c.truth(frame) for c in self.conditions]
        true = np.logical_or.reduce([t & k for t, k in parts])
        return true, true | np.logical_and.reduce([k for _, k in parts])


class Not(Condition):
    def __init__(self, inner: Condition):
        self.inner = as_condition(inner)

    def children(self) -> list[Any]:
        return [self.inner]

    def __repr__(self) -> str:
        return f"Not({self.inner!r})"

    def column(self, w: WindowSpec) -> Column:
        return ~self.inner.column(w)

    def truth(self, frame: Frame) -> Truth:
        t, k = self.inner.truth(frame)
        return ~t & k, k


class Limit(Condition):
    """An exit filled on its own bar at a price; as the top of an exit only, inside other conditions it is its inner condition."""

    def __init__(self, inner: Condition, price: Operand | None = None):
        self.inner, self.price = as_condition(inner), price

    def children(self) -> list[Any]:
        return [self.inner, *([as_expr(self.price)] if self.price is not None else [])]

    def __repr__(self) -> str:
        return f"Limit({self.inner!r}, {self.price!r})"

    def column(self, w: WindowSpec) -> Column:
        return self.inner.column(w)

    def truth(self, frame: Frame) -> Truth:
        return self.inner.truth(frame)

    def resolve_price(self, w: WindowSpec) -> Column:
        if self.price is not None:
            return as_expr(self.price).column(w)
        if isinstance(self.inner, _Compare):
            return self.inner.b.column(w)
        raise ValueError("a limit on something else than a comparison needs a price")


def as_condition(x: Condition | Column | str) -> Condition:
    return x if isinstance(x, Condition) else Custom(x)


def walk(node: Any):
    """node and all nodes below it."""
    yield node
    for child in node.children():
        yield from walk(child)


def collect_entry_refs(node: Any) -> list[str]:
    """Columns that EntryRef nodes name, sorted."""
    return sorted({n.name for n in walk(node) if isinstance(n, EntryRef)})
