"""Predicates checked against a schema and lowered to Spark columns.

All checks and all rewriting happen here, on the driver, before anything runs; what comes out is an
ordinary Boolean column, so Catalyst pushes comparisons into the parquet scan, prunes columns and
compiles the rest. The column is written as one text in Spark's SQL, which Spark reads in one call; all
operators stand in it as functions, as Spark's parser takes long over nested parentheses. What Spark does otherwise than
these predicates want is written out:

- integers saturate at their type's bounds, and integer division cuts towards zero;
- a literal zero as divisor gives NULL, while a zero in a column is an error;
- an expression that can fail gives NULL where it does, and beside it a Boolean text tells where; a row
  fails only if AND and OR, from left to right, come to such an operand before an earlier one decides;
- ``NULL IN ()`` is unknown; LIKE has no escape; CHAR compares without its padding;
- names are case-sensitive, and types that don't go together are refused.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.strict import parse_literal
from quern.plans import ast
from quern.plans.typed import Typed, field_of, type_of_literal, wider
from quern.types import DOUBLE, INT_BOUNDS, TEXT, SqlType, TypeMismatch, type_of

#: What is said of a row on which an expression fails.
FAILED = "division by zero, or a NUMERIC out of range"
_FOLDS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}
_TRIED = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide"}


@dataclass(frozen=True)
class Sql:
    """An expression as text. ``type`` is None for a bare NULL; ``value`` is a literal's."""

    text: str
    type: SqlType | None
    constant: bool = False
    value: object = None
    #: Where the expression fails, and so is NULL; None if no row can make it.
    error: str | None = None
    #: Whether it is a bare column.
    column: bool = False
    #: Columns whose NULL the text does not pass on.
    columns: frozenset[str] = frozenset()

    @property
    def whole(self) -> str:
        """The text that is NULL where it should be."""
        return _call("when", _joined("and", [_call("isnotnull", c) for c in sorted(self.columns)]), self.text) if self.columns else self.text


def lower(predicate: ast.Predicate, schema: T.StructType) -> Column:
    """The predicate as a nullable Boolean column; NULL is unknown. A row on which it fails ends the query."""
    parts = [_predicate(p, schema) for p in _chain(predicate, ast.And)]
    first = next((i for i, (_, e) in enumerate(parts) if e is not None), len(parts))
    # what stands before the first that can fail stands alone, so that it can be pushed into the scan
    alone = [t for t, _ in parts[:first]]
    if first < len(parts):
        wrong = _guarded(parts, decides=False)
        alone.append(_call("when", wrong, _raised("boolean"), _joined("and", [t for t, _ in parts[first:]])))
    return F.expr(_joined("and", alone))


def lower_checked(predicate: ast.Predicate, schema: T.StructType) -> tuple[Column, Column]:
    """(truth, whether the row fails): no row ends the query; where one fails its truth is NULL."""
    truth, wrong = _predicate(predicate, schema)
    return (F.expr(truth), F.lit(False)) if wrong is None else (F.expr(_call("when", _call("not", wrong), truth)), F.expr(wrong))


def lower_expr(expression: ast.Expr, schema: T.StructType) -> Typed:
    """The expression as a column; a row on which it fails ends the query."""
    x = _expr(expression, schema)
    text = x.whole if x.error is None else _call("when", x.error, _raised(_name(x.type)), x.whole)
    return Typed(F.expr(text), x.type, x.constant, x.value)


def _raised(kind: str) -> str:
    return f"CAST(raise_error({_quoted(FAILED)}) AS {kind})"


# ---- texts


def _name(kind: SqlType) -> str:
    return kind.spark.simpleString()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _call(function: str, *operands: str) -> str:
    return f"`{function}`({', '.join(operands)})"


def _cast(text: str, kind: str) -> str:
    return f"CAST({text} AS {kind})"


def _joined(op: str, parts: list[str]) -> str:
    """In a tree as low as can be, since Spark's planning goes down to its ground."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return _call(op, _joined(op, parts[:half]), _joined(op, parts[half:]))


def constant(v: object, kind: SqlType | None = None) -> Sql:
    """A literal; ``kind`` where it is known better than from the value."""
    kind = kind or type_of_literal(v)
    if kind is None:
        return Sql("NULL", None, True)
    if v is None:
        return Sql(_cast("NULL", _name(kind)), kind, True)
    match v:
        case bool():
            text = str(v).upper()
        case int() if kind.name in ("INT", "BIGINT"):
            text = f"{v}{'L' * (kind.name == 'BIGINT')}"
        case float() if kind is DOUBLE and math.isfinite(v):
            text = f"{v!r}D"
        case str() if kind.is_text or kind.family == "bit":
            text = _quoted(v)
        case _:
            plain = v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, (date, time)) else v
            text = _cast(_quoted(str(plain)), _name(kind))
    return Sql(text, kind, True, v)


def _expr(expression: ast.Expr, schema: T.StructType) -> Sql:
    match expression:
        case ast.ColumnRef(name):
            f = field_of(schema, name)
            if sum(x.lower() == name.lower() for x in schema.fieldNames()) > 1:
                raise TypeMismatch(f"column {name!r} can't be told from another whose name differs in case only")
            if (kind := type_of(f)) is None:
                raise TypeMismatch(f"column {name!r} has no SQL type: {f.dataType.simpleString()}")
            return Sql(f"`{name.replace('`', '``')}`", kind, column=True)
        case ast.Literal(value):
            return constant(value)
        case ast.BitLiteral(bits):
            return constant(bits, SqlType("BIT", (len(bits),)))
        case ast.Arithmetic(op, left, right):
            return arithmetic(op, _expr(left, schema), _expr(right, schema))
    raise TypeMismatch(f"not an expression: {expression!r}")


# ---- arithmetic


def _number(x: Sql, op: str) -> Sql:
    """TRUE and FALSE stand for 1 and 0 in arithmetic, as literals only."""
    if x.constant and isinstance(x.value, bool):
        return constant(int(x.value))
    if x.type is not None and not x.type.is_numeric:
        raise TypeMismatch(f"{op} takes numbers, not {x.type}")
    return x


def arithmetic(op: str, a: Sql, b: Sql) -> Sql:
    a, b = _number(a, op), _number(b, op)
    if a.constant and a.value is None or b.constant and b.value is None:
        return constant(None, a.type or b.type)
    if op == "/" and b.constant and b.value == 0:
        return constant(None, wider(a.type, b.type))
    kind, wrong = wider(a.type, b.type), [a.error, b.error]
    if kind.family == "decimal":
        tried = _call(_TRIED[op], a.whole, b.whole)
        return Sql(tried, kind, error=_any(*wrong, _joined("and", [_call("isnotnull", a.whole), _call("isnotnull", b.whole), _call("isnull", tried)])))
    if a.constant and b.constant:
        return constant(_folded(op, a.value, b.value, kind), kind) if kind.family == "integer" else constant(_FOLDS[op](float(a.value), float(b.value)))
    if op == "/" and not b.constant:
        wrong.append(_call("and", _call("isnotnull", a.whole), _call("=", b.whole, "0")))
        b = replace(b, text=_call("nullif", b.whole, _cast("0", _name(b.type))))
    if kind.family == "integer":
        return replace(_saturating(op, a, b, kind), error=_any(*wrong))
    return Sql(_call(op, _cast(a.whole, "double"), _cast(b.whole, "double")), DOUBLE, error=_any(*wrong))


def _any(*wrong: str | None) -> str | None:
    """Whether any is true; None if there is none."""
    found = [e for e in wrong if e is not None]
    return _call("when", *[x for e in found for x in (e, "TRUE")], "FALSE") if found else None


def _folded(op: str, a: int, b: int, kind: SqlType) -> int:
    found = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if op == "/" else _FOLDS[op](a, b)
    low, high = INT_BOUNDS[kind.name]
    return min(max(found, low), high)


def _saturating(op: str, a: Sql, b: Sql, kind: SqlType) -> Sql:
    low, high = INT_BOUNDS[kind.name]
    within = b.constant and b.value != -1
    if kind.name != "BIGINT":
        # the exact result of two of at most 32 bits fits 64; greatest and least pass over NULL, so that is seen to
        # once for the whole expression: each operand stands here once, however deep they are nested
        x, y = _cast(a.text, "bigint"), _cast(b.text, "bigint")
        if op == "/":
            found = _call("div", x, y) if within else _call("least", _call("div", x, y), f"{high}L")
        else:
            found = _call("greatest", _call("least", _call(op, x, y), f"{high}L"), f"{low}L")
        return Sql(_cast(found, _name(kind)), kind, columns=a.columns | b.columns | {s.text for s in (a, b) if s.column})
    x, y = _cast(a.whole, "bigint"), _cast(b.whole, "bigint")
    if op == "/":
        found = _call("div", x, y)
        return Sql(found if within else _call("when", _call("and", _call("=", x, f"{low}L"), _call("=", y, "-1L")), f"{high}L", found), kind)
    beyond = _call("=", _call(">", x, "0"), _call(">", y, "0")) if op == "*" else _call(">=", x, "0")
    return Sql(_call("coalesce", _call(_TRIED[op], x, y), _call("when", _call("and", _call("isnotnull", x), _call("isnotnull", y)), _call("when", beyond, f"{high}L", f"{low}L"))), kind)


# ---- comparison


def aligned(sides: list, what: str, make: Callable) -> tuple[list, bool]:
    """The sides of a comparison in types that compare, literals (by ``make``) in the others' type, and whether
    padding is to be taken off."""
    kinds = [s.type for s in sides if s.type is not None]
    declared = [s.type for s in sides if s.type is not None and not s.constant]
    target = next((k for k in declared if not k.is_text and not k.is_numeric), None) or next(iter(declared), None)
    if target is None and kinds:
        target = next((k for k in kinds if not k.is_text), kinds[0])
    out = []
    for s in sides:
        if s.constant and s.value is not None and target is not None and s.type != target:
            if isinstance(s.value, bool) and target.is_numeric:
                s = make(int(s.value))
            elif isinstance(s.value, str) and s.type is TEXT and not target.is_text and not target.is_numeric:
                s = make(parse_literal(s.value, target), target)
        out.append(s)
    families = {"number" if s.type.is_numeric else "text" if s.type.is_text else s.type.family for s in out if s.type is not None}
    if len(families) > 1:
        raise TypeMismatch(f"{what} can't compare {' with '.join(sorted({str(s.type) for s in out if s.type is not None}))}")
    return out, any(s.type is not None and s.type.family == "char" for s in out)


def _sides(sides: list[Sql], what: str) -> list[str]:
    out, padded = aligned(sides, what, constant)
    return [_call("rtrim", s.whole) if padded and s.type is not None else s.whole for s in out]


def _like(x: Sql, pattern: str) -> str:
    if x.type is not None and not x.type.is_text:
        raise TypeMismatch(f"LIKE takes text, not {x.type}")
    if x.type is None:
        return _cast("NULL", "boolean")
    escape = next(c for c in map(chr, range(1, 32)) if c not in pattern)
    return _call("like", x.text, _quoted(pattern), _quoted(escape))


def _in(x: Sql, items: list[Sql]) -> str:
    if not items:
        return _call("when", _call("isnotnull", x.whole), "FALSE")
    return _call("in", *_sides([x, *items], "IN"))


# ---- predicates


def _chain(p: ast.Predicate, kind: type) -> list[ast.Predicate]:
    """The operands of nested ANDs (or ORs), from left to right."""
    out, left = [], [p]
    while left:
        p = left.pop()
        if isinstance(p, kind):
            left += [p.right, p.left]
        else:
            out.append(p)
    return out


def _guarded(parts: list[tuple[str, str | None]], *, decides: bool) -> str | None:
    """Whether the row fails at one of the operands before an earlier one is ``decides``; each stands here once."""
    last = max((i for i, (_, e) in enumerate(parts) if e is not None), default=-1)
    cases = []
    for i, (t, e) in enumerate(parts[: last + 1]):
        if e is not None:
            cases += [e, "TRUE"]
        if i < last:
            cases += [t if decides else _call("not", t), "FALSE"]
    return _call("when", *cases, "FALSE") if cases else None


def _predicate(p: ast.Predicate, schema: T.StructType) -> tuple[str, str | None]:
    """(the truth, whether the row fails; None if none can)."""
    match p:
        case ast.Compare(left, op, right):
            a, b = _expr(left, schema), _expr(right, schema)
            x, y = _sides([a, b], op)
            return _call("not", _call("=", x, y)) if op == "<>" else _call(op, x, y), _any(a.error, b.error)
        case ast.And() | ast.Or():
            parts = [_predicate(x, schema) for x in _chain(p, type(p))]
            either = isinstance(p, ast.Or)
            return _joined("or" if either else "and", [t for t, _ in parts]), _guarded(parts, decides=either)
        case ast.Not(inner):
            x, e = _predicate(inner, schema)
            return _call("not", x), e
        case ast.IsNull(operand):
            x = _expr(operand, schema)
            return _call("isnull", x.whole), x.error
        case ast.IsNotNull(operand):
            x = _expr(operand, schema)
            return _call("isnotnull", x.whole), x.error
        case ast.Between(operand, low, high):
            return _predicate(ast.And(ast.Compare(operand, ">=", low), ast.Compare(operand, "<=", high)), schema)
        case ast.In(operand, items):
            x, found = _expr(operand, schema), [_expr(i, schema) for i in items]
            return _in(x, found), _any(*[i.error for i in (x, *found)])
        case ast.Like(operand, pattern):
            x = _expr(operand, schema)
            return _like(x, pattern), x.error
        case ast.Exists(inner):
            return _predicate(inner, schema)
    raise TypeMismatch(f"not a predicate: {p!r}")
