"""The SQL column types: names, Spark types, limits, and schemas that carry them as field metadata.

A plain Spark schema can't tell CHAR(5) from VARCHAR(20), so a column's declared type travels in its
``StructField.metadata`` under ``sqlType``; a field without it gets the nearest type of its Spark type.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T


class TypeMismatch(ValueError):
    """Types that don't go together, found before anything runs."""


@dataclass(frozen=True)
class _Spec:
    family: str
    spark: Callable[..., T.DataType]
    #: Bytes and alignment in fixed-width storage; no size where the length varies.
    size: Callable[..., int | None]
    align: int
    #: Names of the parameters.
    takes: tuple[str, ...] = ()
    also: tuple[str, ...] = ()


def _digits(precision: int, scale: int) -> int:
    return (precision + 2) // 2


_SPECS = {
    "SMALLINT": _Spec("integer", T.ShortType, lambda: 2, 2),
    "INT": _Spec("integer", T.IntegerType, lambda: 4, 4, also=("INTEGER",)),
    "BIGINT": _Spec("integer", T.LongType, lambda: 8, 8),
    "REAL": _Spec("float", T.FloatType, lambda: 4, 4),
    "DOUBLE PRECISION": _Spec("float", T.DoubleType, lambda: 8, 8, also=("DOUBLEPRECISION", "FLOAT8")),
    "NUMERIC": _Spec("decimal", T.DecimalType, _digits, 1, ("precision", "scale")),
    "DECIMAL": _Spec("decimal", T.DecimalType, _digits, 1, ("precision", "scale")),
    "BOOLEAN": _Spec("boolean", T.BooleanType, lambda: 1, 1, also=("BOOL",)),
    "CHAR": _Spec("char", lambda n: T.StringType(), lambda n: n, 1, ("size",)),
    "CHARACTER": _Spec("char", lambda n: T.StringType(), lambda n: n, 1, ("size",)),
    "VARCHAR": _Spec("varchar", lambda n: T.StringType(), lambda n: None, 1, ("size",)),
    "DATE": _Spec("date", T.DateType, lambda: 4, 4),
    "TIME": _Spec("time", lambda: T.TimeType(6), lambda: 8, 8),
    "TIMESTAMP": _Spec("timestamp", T.TimestampNTZType, lambda: 8, 8),
    "BIT": _Spec("bit", lambda n: T.StringType(), lambda n: (n + 7) // 8, 1, ("size",)),
}
_NAMES = {alias: name for name, spec in _SPECS.items() for alias in (name, *spec.also)}
MAX_SIZE = 65535
MAX_PRECISION = 38
#: Numeric types from the narrowest; mixed operands widen to the wider one.
WIDENING = ("SMALLINT", "INT", "BIGINT", "REAL", "DOUBLE PRECISION")
INT_BOUNDS = {"SMALLINT": (-(1 << 15), (1 << 15) - 1), "INT": (-(1 << 31), (1 << 31) - 1), "BIGINT": (-(1 << 63), (1 << 63) - 1)}


@dataclass(frozen=True)
class SqlType:
    name: str
    args: tuple[int, ...] = ()

    @property
    def spec(self) -> _Spec:
        return _SPECS[self.name]

    @property
    def family(self) -> str:
        return self.spec.family

    @property
    def spark(self) -> T.DataType:
        return self.spec.spark(*self.args)

    @property
    def size(self) -> int | None:
        """Bytes of a value in fixed-width storage; None where lengths vary."""
        return self.spec.size(*self.args)

    @property
    def least_size(self) -> int:
        """Bytes that any value takes at least: its width, or a two-byte length."""
        return 2 if self.size is None else self.size

    @property
    def align(self) -> int:
        return self.spec.align

    @property
    def is_numeric(self) -> bool:
        return self.family in ("integer", "float", "decimal")

    @property
    def is_text(self) -> bool:
        return self.family in ("char", "varchar")

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})" if self.args else self.name


def parse_type(text: str) -> SqlType:
    """A type from its name, in any case, with its parameters in parentheses."""
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9 ]*?)\s*(?:\(([^()]*)\))?\s*", text)
    name = _NAMES.get(m[1].upper()) if m else None
    if name is None:
        raise TypeMismatch(f"unknown type {text!r}")
    takes, given = _SPECS[name].takes, [] if m[2] is None else [x.strip() for x in m[2].split(",")]
    if len(given) != len(takes) or not all(re.fullmatch(r"[0-9]{1,5}", x) for x in given):
        raise TypeMismatch(f"{name} takes {' and '.join(takes) or 'no parameters'}: {text!r}")
    args = tuple(map(int, given))
    if takes == ("size",) and args[0] > MAX_SIZE:
        raise TypeMismatch(f"the size of {name} is at most {MAX_SIZE}: {text!r}")
    if len(takes) == 2 and not (1 <= args[0] <= MAX_PRECISION and args[1] <= args[0]):
        raise TypeMismatch(f"{name} has a precision of 1 to {MAX_PRECISION} and no greater scale: {text!r}")
    return SqlType(name, args)


SMALLINT, INT, BIGINT, REAL, DOUBLE = (SqlType(n) for n in WIDENING)
BOOLEAN, DATE, TIME, TIMESTAMP = (SqlType(n) for n in ("BOOLEAN", "DATE", "TIME", "TIMESTAMP"))
#: Text of any length up to the largest that can be declared; also the type of results of text functions.
TEXT = SqlType("VARCHAR", (MAX_SIZE,))


def as_type(given: SqlType | str) -> SqlType:
    return given if isinstance(given, SqlType) else parse_type(given)


def of_spark(kind: T.DataType) -> SqlType | None:
    """The nearest SQL type of a Spark type; None where there is none (arrays, maps, binaries)."""
    if isinstance(kind, T.DecimalType):
        return SqlType("NUMERIC", (kind.precision, kind.scale))
    plain = {T.ByteType: SMALLINT, T.ShortType: SMALLINT, T.IntegerType: INT, T.LongType: BIGINT, T.FloatType: REAL, T.DoubleType: DOUBLE, T.BooleanType: BOOLEAN, T.StringType: TEXT, T.VarcharType: TEXT, T.DateType: DATE, T.TimestampNTZType: TIMESTAMP, T.TimestampType: TIMESTAMP, T.TimeType: TIME}
    if isinstance(kind, T.CharType):
        return SqlType("CHAR", (kind.length,))
    return plain.get(type(kind))


def type_of(f: T.StructField) -> SqlType | None:
    """The declared type of a field, else the nearest one."""
    declared = (f.metadata or {}).get("sqlType")
    return parse_type(declared) if declared else of_spark(f.dataType)


@dataclass(frozen=True)
class Constraints:
    """What a table's declaration says about a column; kept, not enforced."""

    not_null: bool = False
    unique: bool = False
    default: str | None = None
    check: str | None = None


@dataclass(frozen=True)
class Column:
    name: str
    type: SqlType
    nullable: bool = True
    constraints: Constraints = field(default_factory=Constraints)

    @property
    def struct_field(self) -> T.StructField:
        kept = {k: v for k, v in vars(self.constraints).items() if v}
        return T.StructField(self.name, self.type.spark, True, {"sqlType": str(self.type)} | ({"constraints": kept} if kept else {}))


@dataclass(frozen=True)
class Schema:
    """A table's columns in order."""

    columns: tuple[Column, ...]

    @classmethod
    def of(cls, *columns: tuple[str, SqlType | str] | Column) -> Schema:
        return cls(tuple(c if isinstance(c, Column) else Column(c[0], as_type(c[1])) for c in columns))

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.struct_field for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def schema_of(struct: T.StructType | Iterable[T.StructField]) -> Schema:
    """The columns of a Spark schema that have an SQL type."""
    return Schema(tuple(Column(f.name, kind, f.nullable) for f in struct if (kind := type_of(f)) is not None))
