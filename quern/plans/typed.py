"""Spark columns with their SQL types, which expressions and functions check before anything runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.types import BIGINT, BOOLEAN, DATE, DOUBLE, INT, INT_BOUNDS, TEXT, TIME, TIMESTAMP, WIDENING, SqlType, TypeMismatch, as_type, type_of


@dataclass(frozen=True)
class Typed:
    """``type`` is None for a bare NULL. ``constant`` tells literals, whose value ``value`` is, from other columns."""

    column: Column
    type: SqlType | None
    constant: bool = False
    value: object = None

    def alias(self, name: str) -> Column:
        kept = {} if self.type is None else {"metadata": {"sqlType": str(self.type)}}
        return self.column.alias(name, **kept)


def field_of(schema: T.StructType, name: str) -> T.StructField:
    """The first field of exactly this name."""
    found = [f for f in schema.fields if f.name == name]
    if not found:
        raise TypeMismatch(f"there is no column {name!r}; names are case-sensitive: {', '.join(schema.fieldNames())}")
    return found[0]


def value(df: DataFrame, name: str) -> Typed:
    """A column of ``df`` by its exact name, with its type."""
    kind = type_of(f := field_of(df.schema, name))
    if kind is None:
        raise TypeMismatch(f"column {name!r} has no SQL type: {f.dataType.simpleString()}")
    return Typed(F.col(f"`{name.replace('`', '``')}`"), kind)


def typed(column: Column, kind: SqlType | str) -> Typed:
    return Typed(column, as_type(kind))


def type_of_literal(v: object) -> SqlType | None:
    match v:
        case None:
            return None
        case bool():
            return BOOLEAN
        case int():
            kind = next((k for k in (INT, BIGINT) if INT_BOUNDS[k.name][0] <= v <= INT_BOUNDS[k.name][1]), None)
            if kind is None:
                raise TypeMismatch(f"{v} is beyond BIGINT")
            return kind
        case float():
            return DOUBLE
        case str():
            return TEXT
        case Decimal():
            _, digits, exponent = v.as_tuple()
            scale = max(0, -exponent)
            return SqlType("NUMERIC", (max(len(digits) + max(0, exponent), scale, 1), scale))
        case datetime():
            return TIMESTAMP
        case date():
            return DATE
        case time():
            return TIME
    raise TypeMismatch(f"{v!r} has no SQL type")


def constant(v: object, kind: SqlType | None = None) -> Typed:
    """A literal; ``kind`` where it is known better than from the value."""
    kind = kind or type_of_literal(v)
    if kind is None:
        return Typed(F.lit(None), None, True, None)
    if v is None:
        return Typed(F.lit(None).cast(kind.spark), kind, True, None)
    plain = v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, (date, time)) else v
    column = F.lit(plain) if isinstance(v, (bool, str)) or (isinstance(v, float) and kind is DOUBLE) else F.lit(str(plain) if not isinstance(plain, (int, float)) else plain).cast(kind.spark)
    return Typed(column, kind, True, v)


def wider(a: SqlType, b: SqlType) -> SqlType:
    """The type to which mixed numeric operands widen."""
    if "decimal" in (a.family, b.family):
        if "float" in (a.family, b.family):
            return DOUBLE
        return a if a.family == "decimal" else b
    found = WIDENING[max(WIDENING.index(a.name), WIDENING.index(b.name))]
    # a REAL holds fewer digits than integers do, so REAL with anything is DOUBLE PRECISION
    return DOUBLE if "REAL" in (a.name, b.name) else SqlType(found)
