"""The scalar functions: typed columns in, typed columns out, NULL for NULL.

Every function checks its arguments' types before anything runs and is a Spark expression, so it is
compiled with the query it stands in. Text functions give VARCHAR; a CHAR's padding doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.strict import SPACE, parse
from quern.plans.typed import Typed, constant
from quern.types import BIGINT, DATE, INT, TEXT, TIME, TIMESTAMP, SqlType, TypeMismatch, as_type

#: The parts of each family that ``extract`` knows.
PARTS = {
    "date": ("YEAR", "MONTH", "DAY"),
    "time": ("HOUR", "MINUTE", "SECOND"),
    "timestamp": ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"),
}
_PART = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}


def _need(x: Typed, ok: bool, what: str) -> Typed:
    if not ok:
        raise TypeMismatch(f"{what} is expected, not {x.type or 'NULL'}")
    return x


def _text(x: Typed) -> Column:
    """The text without a CHAR's padding."""
    _need(x, x.type is not None and x.type.is_text, "text")
    return F.rtrim(x.column) if x.type.family == "char" else x.column


def _numeric(x: Typed) -> Typed:
    return _need(x, x.type is not None and x.type.is_numeric, "a number")


# ---- text


def length(x: Typed) -> Typed:
    """Characters (code points)."""
    return Typed(F.char_length(_text(x)).cast("long"), BIGINT)


def substring(x: Typed, start: int, count: int) -> Typed:
    """``count`` characters from the place ``start``, counted from 1; empty past the end."""
    if start < 1 or count < 0:
        raise TypeMismatch(f"substring starts at 1 or later and takes no negative count: {start}, {count}")
    return Typed(F.substring(_text(x), start, count), TEXT)


def upper(x: Typed) -> Typed:
    return Typed(F.upper(_text(x)), TEXT)


def lower(x: Typed) -> Typed:
    return Typed(F.lower(_text(x)), TEXT)


def _stripped(x: Typed, strip) -> Typed:
    _text(x)
    return Typed(strip(x.column, F.lit(SPACE)), TEXT)


def trim(x: Typed) -> Typed:
    """Without white space, of any kind, at both ends."""
    return _stripped(x, F.btrim)


def ltrim(x: Typed) -> Typed:
    return _stripped(x, F.ltrim)


def rtrim(x: Typed) -> Typed:
    return _stripped(x, F.rtrim)


# ---- dates and times


def extract(part: str, x: Typed) -> Typed:
    """A part as an INT; seconds without their fraction. A DATE has no hours, a TIME no years."""
    part = part.upper()
    _need(x, x.type is not None and x.type.family in PARTS, "a DATE, TIME or TIMESTAMP")
    if part not in PARTS[x.type.family]:
        raise TypeMismatch(f"{x.type} has no {part}; it has {', '.join(PARTS[x.type.family])}")
    return Typed(_PART[part](x.column).cast("int"), INT)


# ---- numbers


def abs_(x: Typed) -> Typed:
    _numeric(x)
    return Typed(F.abs(x.column).cast(x.type.spark), x.type)


def round_(x: Typed, places: int = 0) -> Typed:
    """Half away from zero. Integers stay as they are; floats are scaled, rounded and scaled back, in their
    own precision; a decimal keeps ``places`` digits at most."""
    kind = _numeric(x).type
    if kind.family == "integer":
        return x
    if kind.family == "decimal":
        precision, scale = kind.args
        if (target := max(places, 0)) >= scale:
            return x
        out = SqlType(kind.name, (min(38, precision - scale + target + 1), target))
        return Typed(F.round(x.column, target).cast(out.spark), out)
    factor = F.lit(10.0**places).cast(kind.spark)
    scaled = x.column * factor
    # at 2^52 and beyond (2^23 in single precision) every number is whole
    whole = F.floor(F.abs(scaled).cast("double")).cast("double")
    half = F.when(F.abs(scaled).cast("double") - whole >= 0.5, whole + 1.0).otherwise(whole)
    bound = float(1 << (23 if kind.name == "REAL" else 52))
    rounded = F.when((F.abs(scaled) < bound) & ~F.isnan(scaled), F.signum(scaled.cast("double")) * half).otherwise(scaled.cast("double")).cast(kind.spark)
    return Typed((rounded / factor).cast(kind.spark), kind)


def _whole(x: Typed, f) -> Typed:
    kind = _numeric(x).type
    if kind.family == "integer":
        return x
    if kind.family == "decimal":
        precision, scale = kind.args
        if not scale:
            return x
        out = SqlType(kind.name, (min(38, precision - scale + 1), 0))
        return Typed(f(x.column).cast(out.spark), out)
    # Spark's floor and ceil give BIGINT, in which infinities and large numbers have no place
    bound = float(1 << (23 if kind.name == "REAL" else 52))
    return Typed(F.when((F.abs(x.column) < bound) & ~F.isnan(x.column), f(x.column).cast(kind.spark)).otherwise(x.column), kind)


def floor(x: Typed) -> Typed:
    """The type stays; a decimal loses its scale."""
    return _whole(x, F.floor)


def ceiling(x: Typed) -> Typed:
    return _whole(x, F.ceil)


# ---- conversion


def _plain(x: Column) -> Column:
    """A float's shortest digits without an exponent, and without a fraction where there is none; from 1e38 on
    with an exponent all the same."""
    text = F.regexp_replace(x.cast("string"), r"\.0$", "")
    digits = F.coalesce(text.try_cast("decimal(38,20)").cast("string"), text.try_cast("decimal(38,0)").cast("string"), text)
    return F.when(F.contains(text, F.lit("E")), F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(text)


def literal_text(x: Typed) -> Column:
    """The text that stands for a value: what ``cast_strict`` reads again."""
    match x.type.family if x.type else None:
        case "char":
            return F.rtrim(x.column)
        case "time":
            seconds = F.rpad(F.regexp_replace(x.column.cast("string"), r"^[0-9:]{8}\.?", ""), 6, "0")
            return F.concat(F.substring(x.column.cast("string"), 1, 8), F.lit("."), seconds)
        case "float":
            return _plain(x.column)
        case "timestamp":
            return F.date_format(x.column.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        case _:
            return x.column.cast("string")


def cast_strict(x: Typed, kind: SqlType | str, *, or_null: bool = False) -> Typed:
    """The value's text read strictly as another type: nothing is cut or rounded, and what isn't a value of
    the type is an error, or NULL if ``or_null``."""
    kind = as_type(kind)
    if x.type is None:
        return Typed(F.lit(None).cast(kind.spark), kind)
    text = literal_text(x)
    out = parse(text, kind)
    if not or_null:
        wrong = F.raise_error(F.concat(F.lit(f"not a {kind}: '"), text, F.lit("'"))).cast(kind.spark)
        out = F.when(text.isNull() | out.isNotNull(), out).otherwise(wrong)
    return Typed(out, kind)


def coalesce(*values: Typed) -> Typed:
    """The first that isn't NULL; all are of one family."""
    kinds = [v.type for v in values if v.type is not None]
    if not kinds or len({"number" if k.is_numeric else "text" if k.is_text else k.family for k in kinds}) > 1:
        raise TypeMismatch(f"coalesce takes values of one kind, not {', '.join(str(v.type) for v in values) or 'none'}")
    return Typed(F.coalesce(*[v.column for v in values]), kinds[0])


def nullif(a: Typed, b: Typed) -> Typed:
    """NULL where both are equal, else the first; types that don't compare are refused."""
    from quern.plans.lower import aligned

    (x, y), padded = aligned([a, b], "nullif", constant)
    x, y = (F.rtrim(s.column) if padded and s.type is not None else s.column for s in (x, y))
    return Typed(F.when(x == y, F.lit(None)).otherwise(a.column), a.type)


# ---- the session's clock


def current_date() -> Typed:
    return Typed(F.current_date(), DATE)


def current_time() -> Typed:
    return Typed(F.current_time(6), TIME)


def current_timestamp() -> Typed:
    return Typed(F.localtimestamp(), TIMESTAMP)


FUNCTIONS = {
    "length": length, "substring": substring, "upper": upper, "lower": lower, "trim": trim, "ltrim": ltrim, "rtrim": rtrim,
    "extract": extract, "abs": abs_, "round": round_, "floor": floor, "ceiling": ceiling, "cast": cast_strict,
    "coalesce": coalesce, "nullif": nullif, "current_date": current_date, "current_time": current_time, "current_timestamp": current_timestamp,
}
