"""A table as text: a header of names and types, then a numbered line for each row.

Rows come partition by partition, so the driver never holds the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, time
from decimal import Decimal

from pyspark.sql import DataFrame

from quern.types import SqlType, type_of


def shown(value: object, kind: SqlType | None) -> str:
    """A value as it is displayed: text in quotes, bits as a literal, times to the microsecond."""
    if value is None:
        return "NULL"
    family = kind.family if kind else None
    if family == "bit":
        return f"B'{value}'"
    if family == "char":
        return f"'{value.rstrip(' ')}'"
    match value:
        case bool():
            return str(value).lower()
        case str():
            return f"'{value}'"
        case float():
            return _float(value)
        case Decimal():
            return f"{value:f}"
        case datetime():
            return value.strftime("%Y-%m-%d %H:%M:%S.%f")
        case time():
            return value.strftime("%H:%M:%S.%f")
        case date():
            return value.isoformat()
    return str(value)


def _float(v: float) -> str:
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "inf" if v > 0 else "-inf"
    return f"{v:.0f}" if v == int(v) else f"{Decimal(repr(v)):f}"


def lines(df: DataFrame) -> Iterator[str]:
    kinds = [type_of(f) for f in df.schema]
    yield " | ".join(f"{f.name} ({kind or f.dataType.simpleString().upper()})" for f, kind in zip(df.schema, kinds, strict=True))
    for i, row in enumerate(df.toLocalIterator(), 1):
        yield f"Tuple {i}: " + " ".join(f"{f.name}={shown(v, kind)}" for f, kind, v in zip(df.schema, kinds, row, strict=True))


def show(df: DataFrame, write=print) -> None:
    for line in lines(df):
        write(line)
