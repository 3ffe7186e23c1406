"""Types, strict reading of text, and scalar functions."""

import math
from datetime import date, datetime, time
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.functions.strict import complaint, parse, parse_literal, validate
from quern.plans.typed import constant, typed, value
from quern.types import Column, Constraints, Schema, TypeMismatch, as_type, parse_type, schema_of


@pytest.mark.parametrize(
    ("text", "shown", "size", "align"),
    [
        ("smallint", "SMALLINT", 2, 2), (" Integer ", "INT", 4, 4), ("BIGINT", "BIGINT", 8, 8), ("real", "REAL", 4, 4), ("DOUBLE PRECISION", "DOUBLE PRECISION", 8, 8), ("float8", "DOUBLE PRECISION", 8, 8), ("doubleprecision", "DOUBLE PRECISION", 8, 8),
        ("numeric(10, 2)", "NUMERIC(10,2)", 6, 1), ("DECIMAL(8,3)", "DECIMAL(8,3)", 5, 1), ("bool", "BOOLEAN", 1, 1), ("char(5)", "CHAR(5)", 5, 1), ("CHARACTER(5)", "CHARACTER(5)", 5, 1), ("varchar(20)", "VARCHAR(20)", None, 1),
        ("date", "DATE", 4, 4), ("time", "TIME", 8, 8), ("timestamp", "TIMESTAMP", 8, 8), ("bit(6)", "BIT(6)", 1, 1), ("bit(9)", "BIT(9)", 2, 1),
    ],
)
def test_type_names(text, shown, size, align):
    kind = parse_type(text)
    assert (str(kind), kind.size, kind.align) == (shown, size, align)
    assert parse_type(str(kind)) == kind
    assert kind.least_size == (2 if size is None else size)


@pytest.mark.parametrize("text", ["BLOB", "TEXT", "NUMERIC", "NUMERIC(0,0)", "NUMERIC(4,5)", "NUMERIC(39,1)", "NUMERIC(4)", "VARCHAR(x)", "VARCHAR", "INT(4)", "CHAR(70000)", "CHAR(-1)", ""])
def test_unknown_types(text):
    with pytest.raises(TypeMismatch):
        parse_type(text)


def test_schemas_carry_types():
    schema = Schema((Column("id", parse_type("INT"), False, Constraints(not_null=True, check="id > 0")), Column("c", parse_type("CHAR(5)"))))
    assert schema.struct["c"].metadata == {"sqlType": "CHAR(5)"}
    assert schema.struct["id"].metadata["constraints"] == {"not_null": True, "check": "id > 0"}
    assert [str(c.type) for c in schema_of(schema.struct).columns] == ["INT", "CHAR(5)"]


ACCEPTED = {
    "SMALLINT": {"-32768": -32768, " 12 ": 12, "+7": 7}, "INT": {"2147483647": 2147483647, "007": 7}, "BIGINT": {"9223372036854775807": (1 << 63) - 1},
    "REAL": {"3.5": 3.5, "-Infinity": -math.inf, "1e2": 100.0}, "DOUBLE PRECISION": {"-1.0e100": -1e100, "Infinity": math.inf, ".5": 0.5, "5.": 5.0, "inf": math.inf},
    "NUMERIC(8,2)": {"123.45": Decimal("123.45"), "-.5": Decimal("-0.50"), "000123456.7": Decimal("123456.70"), "'1.5'": Decimal("1.50"), "+2": Decimal("2.00")}, "NUMERIC(2,2)": {"0.12": Decimal("0.12")},
    "BOOLEAN": {"true": True, "F": False, "1": True, "0": False, "T": True}, "VARCHAR(5)": {"abc": "abc", " 'abc' ": "abc", '"x"': "x", "": ""}, "CHAR(5)": {"abc": "abc  ", "é": "é   "},
    "DATE": {"2026-03-26": date(2026, 3, 26), "2024-02-29": date(2024, 2, 29), "2026-3-1": date(2026, 3, 1)}, "TIME": {"13:14:15.123456": time(13, 14, 15, 123456), "23:59:59": time(23, 59, 59)},
    "TIMESTAMP": {"2026-03-26 13:14:15": datetime(2026, 3, 26, 13, 14, 15), "2024-02-29 23:59:59.5": datetime(2024, 2, 29, 23, 59, 59, 500000)}, "BIT(4)": {"B'1011'": "1011", "0001": "0001", "b'0000'": "0000"},
}
REJECTED = {
    "SMALLINT": ["32768", "1.0", "", "1e2", "x", "--1"], "INT": ["2147483648", "1 2", "5d"], "BIGINT": ["9223372036854775808"], "REAL": ["not-real", "1.0f", ""], "DOUBLE PRECISION": ["not-double", "1.0d", "1e", "."],
    "NUMERIC(8,2)": ["123.456", "1234567.89", "", "1.2.3", "1e2", "x"], "NUMERIC(2,2)": ["1", "0.123"], "BOOLEAN": ["maybe", "yes", "on", ""], "VARCHAR(5)": ["abcdef", "éééé"], "CHAR(5)": ["abcdef"],
    "DATE": ["2026-13-01", "2026-02-29", "2026", "2026-03-26 10:00:00", ""], "TIME": ["25:00:00", "23:59:59.1000000", "13:14", ""], "TIMESTAMP": ["2026-03-26", "2026-02-29 00:00:00", "2026-03-26T10:00:00", "2026-03-26 10:00:00Z"], "BIT(4)": ["B'10110'", "B'101'", "1012", ""],
}


@pytest.mark.parametrize("kind", ACCEPTED)
def test_strict_reading(spark, kind):
    texts = [*ACCEPTED[kind], *REJECTED[kind], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(parse(F.col("t"), kind).alias("v"), validate(F.col("t"), kind).alias("ok"), complaint(F.col("t"), kind, "c").alias("why")).collect()
    assert [r["v"] for r in rows[: len(ACCEPTED[kind])]] == list(ACCEPTED[kind].values())
    assert [r["ok"] for r in rows] == [True] * len(ACCEPTED[kind]) + [False] * len(REJECTED[kind]) + [None]
    assert all(r["v"] is None for r in rows[len(ACCEPTED[kind]) :])
    assert rows[-2]["why"].startswith(f"c: not a {kind}") and rows[-1]["why"] is None and rows[0]["why"] is None
    for t, v in ACCEPTED[kind].items():
        assert parse_literal(t, as_type(kind)) == v
    for t in REJECTED[kind]:
        with pytest.raises(TypeMismatch):
            parse_literal(t, as_type(kind))


def test_nan_is_read(spark):
    for text in ("NaN", "-nan", "+NAN"):
        got = spark.range(1).select(parse(F.lit(text), "REAL").alias("r"), parse(F.lit(text), "FLOAT8").alias("d")).first()
        assert math.isnan(got["r"]) and math.isnan(got["d"])


def run(spark, *xs):
    return list(spark.range(1).select(*[x.column.alias(f"c{i}") for i, x in enumerate(xs)]).first())


def text(s, kind="VARCHAR(40)"):
    return typed(F.lit(s), kind)


def num(v, kind):
    return typed(F.lit(str(v)).cast(as_type(kind).spark), kind)


def test_text_functions(spark):
    assert run(spark, S.length(text("  database")), S.length(text("ab   ", "CHAR(5)")), S.length(text("héllo")), S.upper(text("Ab")), S.lower(text("AB   ", "CHAR(5)")), S.length(text(None))) == [10, 2, 5, "AB", "ab", None]
    assert run(spark, S.substring(text("abcdef"), 2, 3), S.substring(text("database"), 5, 99), S.substring(text("database"), 50, 2), S.substring(text("héllo"), 2, 2), S.substring(text("abc"), 1, 0)) == ["bcd", "base", "", "él", ""]
    assert run(spark, S.trim(text("\t  x y\xa0　\n")), S.ltrim(text(" x ")), S.rtrim(text(" x  ")), S.trim(text("")), S.trim(text("ab   ", "CHAR(5)"))) == ["x y", "x ", " x", "", "ab"]
    for bad in (lambda: S.length(num(1, "INT")), lambda: S.substring(text("a"), 0, 1), lambda: S.upper(num(1, "DATE") if False else num(1.5, "FLOAT8")), lambda: S.trim(num(1, "INT"))):
        with pytest.raises(TypeMismatch):
            bad()


def test_extract(spark):
    ts, d, t = typed(F.lit("2026-03-26 13:14:15.9").cast("timestamp_ntz"), "TIMESTAMP"), typed(F.lit("2026-03-26").cast("date"), "DATE"), typed(F.lit("13:14:15.5").cast("time(6)"), "TIME")
    assert run(spark, *[S.extract(p, ts) for p in ("year", "month", "day", "hour", "minute", "second")], S.extract("day", d), S.extract("minute", t), S.extract("SECOND", t)) == [2026, 3, 26, 13, 14, 15, 26, 14, 15]
    for part, x in (("hour", d), ("year", t), ("week", ts), ("year", text("x"))):
        with pytest.raises(TypeMismatch):
            S.extract(part, x)


def test_number_functions(spark):
    f8, n = "FLOAT8", "NUMERIC(8,3)"
    assert run(spark, S.abs_(num(-3.5, f8)), S.abs_(num(-4, "SMALLINT")), S.abs_(num("-1.250", n))) == [3.5, 4, Decimal("1.250")]
    assert run(spark, S.round_(num(3.14159, f8), 3), S.round_(num(1.005, f8), 2), S.round_(num(-2.5, f8)), S.round_(num(2.5, f8)), S.round_(num(125, "INT"), -1), S.round_(num(0.49999999999999994, f8)), S.round_(num(1e300, f8), 2)) == [3.142, 1.0, -3.0, 3.0, 125, 0.0, 1e300]
    assert run(spark, S.round_(num("-2.345", n), 2), S.round_(num("2.344", n), 2), S.round_(num("2.5", n)), S.round_(num("2.5", n), 9), S.round_(num("125.5", n), -2)) == [Decimal("-2.35"), Decimal("2.34"), Decimal("3"), Decimal("2.500"), Decimal("126")]
    assert run(spark, S.floor(num(-123.45, f8)), S.ceiling(num(-123.45, f8)), S.floor(num("-1.5", n)), S.ceiling(num("1.001", n)), S.floor(num(7, "INT")), S.ceiling(num(1e300, f8)), S.floor(num(1.5, "REAL"))) == [-124.0, -123.0, Decimal("-2"), Decimal("2"), 7, 1e300, 1.0]
    assert math.isnan(run(spark, S.floor(num("NaN", f8)))[0]) and run(spark, S.round_(num("Infinity", f8), 1)) == [math.inf]
    for f in (S.abs_, S.round_, S.floor, S.ceiling):
        with pytest.raises(TypeMismatch):
            f(text("x"))


def test_strict_casts(spark):
    assert run(spark, S.cast_strict(text("42"), "INT"), S.cast_strict(num(42, "INT"), "BIGINT"), S.cast_strict(text("2026-03-13"), "DATE"), S.cast_strict(num(5.0, "FLOAT8"), "INT"), S.cast_strict(num("12.50", "NUMERIC(8,2)"), "FLOAT8"), S.cast_strict(num(1e10, "FLOAT8"), "VARCHAR(20)"), S.cast_strict(num(1.5e-5, "FLOAT8"), "VARCHAR(20)")) == [42, 42, date(2026, 3, 13), 5, 12.5, "10000000000", "0.000015"]
    assert run(spark, S.cast_strict(typed(F.lit(True), "BOOLEAN"), "VARCHAR(5)"), S.cast_strict(typed(F.lit("13:14:15.5").cast("time(6)"), "TIME"), "VARCHAR(20)"), S.cast_strict(typed(F.lit("2026-03-26 13:14:15.5").cast("timestamp_ntz"), "TIMESTAMP"), "VARCHAR(30)"), S.cast_strict(text("a"), "CHAR(3)"), S.cast_strict(text(None), "INT")) == ["true", "13:14:15.500000", "2026-03-26 13:14:15.500000", "a  ", None]
    ts = typed(F.lit("2026-03-26 00:00:00").cast("timestamp_ntz"), "TIMESTAMP")
    for x, kind in ((num(1.5, "FLOAT8"), "INT"), (num("12.345", "NUMERIC(8,3)"), "NUMERIC(8,2)"), (ts, "DATE"), (typed(F.lit(True), "BOOLEAN"), "INT"), (text("abcdef"), "VARCHAR(3)"), (text("x"), "INT")):
        assert run(spark, S.cast_strict(x, kind, or_null=True)) == [None]
        with pytest.raises(PySparkException, match="not a"):
            run(spark, S.cast_strict(x, kind))


def test_conditional_functions(spark):
    assert run(spark, S.coalesce(typed(F.lit(None).cast("int"), "INT"), num(10, "INT"), num(20, "INT")), S.nullif(num(7, "INT"), num(7, "INT")), S.nullif(num(7, "INT"), num(8, "INT")), S.nullif(text("ab   ", "CHAR(5)"), text("ab"))) == [10, None, 7, None]
    for bad in (lambda: S.nullif(num(1, "INT"), text("x")), lambda: S.coalesce(num(1, "INT"), text("x")), S.coalesce, lambda: S.coalesce(constant(None))):
        with pytest.raises(TypeMismatch):
            bad()


def test_clock(spark):
    day, now, moment = run(spark, S.current_date(), S.current_time(), S.current_timestamp())
    assert isinstance(day, date) and isinstance(now, time) and isinstance(moment, datetime)


def test_results_keep_their_types(spark):
    df = spark.createDataFrame([("ab",)], Schema.of(("s", "VARCHAR(9)")).struct)
    out = df.select(S.upper(S.substring(value(df, "s"), 1, 1)).alias("u"), S.cast_strict(value(df, "s"), "CHAR(4)").alias("c"))
    assert out.schema["c"].metadata == {"sqlType": "CHAR(4)"} and out.first() == ("A", "ab  ")
    with pytest.raises(TypeMismatch):
        value(df, "S")
