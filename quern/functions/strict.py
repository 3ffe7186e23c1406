"""Strict reading of text as SQL types, as Spark columns and, for literals, in Python.

A text is a value of a type only if it has the type's form and fits its limits; nothing is rounded,
cut or guessed, which Spark's own casts do. The forms are regular expressions that both sides share, so
a form is checked in the JVM, within generated code, before Spark's cast is trusted with the text.
"""

from __future__ import annotations

import math
import operator
import re
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.types import INT_BOUNDS, SqlType, TypeMismatch, as_type

#: White space as Unicode defines it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_TIME = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_SPECIAL = r"[+-]?(?i:inf|infinity|nan)"
_TRUE, _FALSE = ("true", "t", "1"), ("false", "f", "0")


def trim(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(text, F.lit(SPACE))


def _bare(text: Column, quotes: str) -> Column:
    """Trimmed, and without the quotes around it."""
    out = trim(text)
    for q in quotes:
        out = F.btrim(out, F.lit(q))
    return out


def form(kind: SqlType) -> str:
    """The form of the type's texts, once trimmed and without quotes."""
    match kind.family:
        case "integer":
            return r"[+-]?[0-9]+"
        case "float":
            return f"{_NUMBER}|{_SPECIAL}"
        case "decimal":
            precision, scale = kind.args
            return rf"(?=.)[+-]?0*[0-9]{{0,{precision - scale}}}(\.[0-9]{{0,{scale}}})?"
        case "boolean":
            return f"(?i:{'|'.join(_TRUE + _FALSE)})"
        case "date":
            return _DATE
        case "time":
            return rf"{_TIME}(\.[0-9]{{1,6}})?"
        case "timestamp":
            return rf"{_DATE} {_TIME}(\.[0-9]{{1,9}})?"
        case "bit":
            return rf"[01]{{{kind.args[0]}}}"
        case _:
            return r"(?s:.*)"


_QUOTES = {"decimal": "\"'", "char": "\"'", "varchar": "\"'", "date": "'", "time": "'", "timestamp": "'"}


def _body(text: Column, kind: SqlType) -> Column:
    """The text trimmed and without quotes; most texts have neither at their ends, which is cheap to see."""
    out = _bare(F.regexp_replace(trim(text), r"^[Bb](?='[\s\S]*'$)", "") if kind.family == "bit" else text, "'" if kind.family == "bit" else _QUOTES.get(kind.family, ""))
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    bare = [(c > 0x27) & (c < 0x7F) for c in (first, last)] + [~first.isin(ord("B"), ord("b"))] * (kind.family == "bit")
    return F.when(reduce(operator.and_, bare), text).otherwise(out)


def parse(text: Column, kind: SqlType | str) -> Column:
    """The text as a value of the type; null where it isn't one (or is null itself)."""
    kind = as_type(kind)
    return _value(_body(text, kind), kind)


def staged(df: DataFrame, texts: dict[str, tuple[Column, SqlType | str]]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the texts, trimmed and without quotes, as columns of their own, so that each is worked out once
    however often it is looked at; and the values."""
    made = {f"_text_{i}": text for i, (text, _) in enumerate(texts.values())}
    bodies = {f"_body_{i}": _body(F.col(t), as_type(kind)) for i, (t, (_, kind)) in enumerate(zip(made, texts.values(), strict=True))}
    return df.withColumns(made).withColumns(bodies), {name: _value(F.col(b), as_type(kind)) for b, (name, (_, kind)) in zip(bodies, texts.items(), strict=True)}


def validated(df: DataFrame, texts: dict[str, tuple[Column, SqlType | str]]) -> DataFrame:
    """``df`` with a column for each name: whether the text is a value of the type; null for null."""
    rows, values = staged(df, texts)
    return rows.select(*df.columns, *[F.when(F.col(f"_text_{i}").isNotNull(), v.isNotNull()).alias(name) for i, (name, v) in enumerate(values.items())])


def _value(body: Column, kind: SqlType) -> Column:
    """The value of a trimmed and unquoted text."""
    match kind.family:
        case "char":
            size = kind.args[0]
            return F.when(F.octet_length(body) <= size, F.concat(body, F.repeat(F.lit(" "), F.lit(size) - F.octet_length(body))))
        case "varchar":
            return F.when(F.octet_length(body) <= kind.args[0], body)
        case "bit":
            found = body
        case "boolean":
            found = F.lower(body).isin(*_TRUE)
        case "decimal":
            found = F.concat(F.regexp_extract(body, "^[+-]?", 0), F.lit("0"), F.regexp_replace(body, "^[+-]", "")).try_cast(kind.spark)
        case "float":
            found = F.when(body.rlike(r"^[+-]?(?i:nan)\z"), F.lit(math.nan).cast(kind.spark)).otherwise(body.try_cast(kind.spark))
        case _:
            found = body.try_cast(kind.spark)
    return F.when(body.rlike(f"^(?:{form(kind)})\\z"), found)


def validate(text: Column, kind: SqlType | str) -> Column:
    """Whether the text is a value of the type; null for null."""
    return F.when(text.isNotNull(), parse(text, kind).isNotNull())


def complaint(text: Column, kind: SqlType | str, name: str) -> Column:
    """What is wrong with the text of the column called ``name``; null if nothing is."""
    kind = as_type(kind)
    return F.when(~validate(text, kind), F.concat(F.lit(f"{name}: not a {kind}: '"), text, F.lit("'")))


def parse_literal(text: str, kind: SqlType) -> bool | int | float | str | date | time | datetime | Decimal:
    """The same for one text, in Python; what isn't a value of the type is a mistake in the query."""

    def wrong() -> TypeMismatch:
        return TypeMismatch(f"{text!r} is not a {kind}")

    body = text.strip(SPACE)
    if kind.family == "bit":
        body = re.sub(r"^[Bb](?='[\s\S]*'$)", "", body).strip("'")
    for q in _QUOTES.get(kind.family, ""):
        body = body.strip(q)
    if kind.is_text:
        if len(body.encode()) > kind.args[0]:
            raise wrong()
        return body.ljust(len(body) + kind.args[0] - len(body.encode())) if kind.family == "char" else body
    if not re.fullmatch(form(kind), body):
        raise wrong()
    try:
        match kind.family:
            case "integer":
                low, high = INT_BOUNDS[kind.name]
                if not low <= (found := int(body)) <= high:
                    raise wrong()
                return found
            case "float":
                return float(body)
            case "decimal":
                sign, digits = re.fullmatch(r"([+-]?)(.*)", body).groups()
                return Decimal(f"{sign}0{digits}")
            case "boolean":
                return body.lower() in _TRUE
            case "date":
                return date(*map(int, body.split("-")))
            case "time" | "timestamp":
                whole, _, fraction = body.partition(".")
                fields = list(map(int, re.findall("[0-9]+", whole)))
                return (time if kind.family == "time" else datetime)(*fields, int(fraction[:6].ljust(6, "0")))
            case _:
                return body
    except ValueError as e:
        raise wrong() from e
