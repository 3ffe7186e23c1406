"""Predicates and expressions as plain values, built by hand or by ``plans.sql``."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal

Value = bool | int | float | str | date | time | datetime | Decimal | None


class Expr:
    """An expression; Python's arithmetic operators and the methods below combine expressions and plain values."""

    def __add__(self, other) -> Arithmetic:
        return Arithmetic("+", self, expr(other))

    def __sub__(self, other) -> Arithmetic:
        return Arithmetic("-", self, expr(other))

    def __mul__(self, other) -> Arithmetic:
        return Arithmetic("*", self, expr(other))

    def __truediv__(self, other) -> Arithmetic:
        return Arithmetic("/", self, expr(other))

    def __radd__(self, other) -> Arithmetic:
        return expr(other) + self

    def __rsub__(self, other) -> Arithmetic:
        return expr(other) - self

    def __rmul__(self, other) -> Arithmetic:
        return expr(other) * self

    def __rtruediv__(self, other) -> Arithmetic:
        return expr(other) / self

    def eq(self, other) -> Compare:
        return Compare(self, "=", expr(other))

    def ne(self, other) -> Compare:
        return Compare(self, "<>", expr(other))

    def __lt__(self, other) -> Compare:
        return Compare(self, "<", expr(other))

    def __le__(self, other) -> Compare:
        return Compare(self, "<=", expr(other))

    def __gt__(self, other) -> Compare:
        return Compare(self, ">", expr(other))

    def __ge__(self, other) -> Compare:
        return Compare(self, ">=", expr(other))

    def is_null(self) -> IsNull:
        return IsNull(self)

    def is_not_null(self) -> IsNotNull:
        return IsNotNull(self)

    def between(self, low, high) -> Between:
        return Between(self, expr(low), expr(high))

    def is_in(self, *items) -> In:
        return In(self, tuple(map(expr, items)))

    def like(self, pattern: str) -> Like:
        return Like(self, pattern)


@dataclass(frozen=True)
class ColumnRef(Expr):
    """A column by its exact name."""

    name: str


@dataclass(frozen=True)
class Literal(Expr):
    value: Value


@dataclass(frozen=True)
class BitLiteral(Expr):
    bits: str


@dataclass(frozen=True)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr


class Predicate:
    def __and__(self, other: Predicate) -> And:
        return And(self, other)

    def __or__(self, other: Predicate) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    left: Expr
    op: str
    right: Expr


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate


@dataclass(frozen=True)
class IsNull(Predicate):
    operand: Expr


@dataclass(frozen=True)
class IsNotNull(Predicate):
    operand: Expr


@dataclass(frozen=True)
class Between(Predicate):
    operand: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class In(Predicate):
    operand: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Like(Predicate):
    """``%`` is any run of characters and ``_`` one; there is no escape, and a backslash is itself."""

    operand: Expr
    pattern: str


@dataclass(frozen=True)
class Exists(Predicate):
    """A wrapper without an effect of its own: true, false or unknown as what it holds."""

    inner: Predicate


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


def lit(value: Value) -> Literal:
    return Literal(value)


def expr(value) -> Expr:
    return value if isinstance(value, Expr) else Literal(value)
