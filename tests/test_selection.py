"""Predicates over small tables: truth tables, comparisons, arithmetic, IN, LIKE, forms of selection."""

import contextlib
import io
import itertools
import operator
from datetime import date
from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import selection
from quern.plans.ast import BitLiteral, Exists, IsNull, Like, col, lit
from quern.plans.lower import lower_expr
from quern.types import Schema, TypeMismatch

TRUTH = {"T": lit(1).eq(1), "F": lit(1).eq(2), "U": lit(1).eq(None)}
VALUE = {"T": True, "F": False, "U": None}


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, Schema.of(*schema).struct)


def truths(df, where):
    return [r["truth"] for r in selection.evaluate(df, where).collect()]


def numbers(spark, values, kind="INT"):
    return frame(spark, [("x", kind)], [(v,) for v in values])


def test_truth_tables(spark):
    one = spark.range(1)
    pairs = list(itertools.product("TFU", repeat=2))
    both = selection.evaluate(selection.evaluate(one, TRUTH["T"] & TRUTH["U"], "a"), TRUTH["T"] | TRUTH["U"], "o")
    assert both.select("a", "o").first() == (None, True)
    made = one.select(*[selection.plan(one, TRUTH[a] & TRUTH[b]).alias(f"and_{a}{b}") for a, b in pairs], *[selection.plan(one, TRUTH[a] | TRUTH[b]).alias(f"or_{a}{b}") for a, b in pairs], *[selection.plan(one, ~TRUTH[a]).alias(f"not_{a}") for a in "TFU"]).first()
    for a, b in pairs:
        assert made[f"and_{a}{b}"] is (False if "F" in (a, b) else None if "U" in (a, b) else True)
        assert made[f"or_{a}{b}"] is (True if "T" in (a, b) else None if "U" in (a, b) else False)
    assert [made[f"not_{a}"] for a in "TFU"] == [False, True, None]


@pytest.mark.parametrize(("op", "expected"), [("=", [False, True, False, None]), ("<>", [True, False, True, None]), ("<", [True, False, False, None]), ("<=", [True, True, False, None]), (">", [False, False, True, None]), (">=", [False, True, True, None])])
def test_comparisons_at_the_boundary(spark, op, expected):
    df = numbers(spark, [17, 18, 19, None])
    assert truths(df, f"x {op} 18") == expected
    flipped = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    assert truths(df, f"18 {flipped} x") == expected


def test_between_and_negations(spark):
    df = numbers(spark, [9, 10, 15, 20, 21, None])
    assert truths(df, "x BETWEEN 10 AND 20") == [False, True, True, True, False, None]
    assert truths(df, "x NOT BETWEEN 10 AND 20") == [True, False, False, False, True, None]
    assert truths(df, "x BETWEEN 20 AND 10") == [False] * 5 + [None]
    assert truths(df, "NOT NOT x = 9") == [True, False, False, False, False, None]


def test_is_null_is_never_unknown(spark):
    df = numbers(spark, [1, None])
    assert truths(df, "x IS NULL") == [False, True]
    assert truths(df, "x + 1 IS NOT NULL") == [True, False]
    with pytest.raises(TypeMismatch):
        selection.plan(df, IsNull(col("y")))


def test_arithmetic(spark):
    df = numbers(spark, [5, -7, 0, None])
    made = df.select(*[lower_expr(e, df.schema).column.alias(n) for n, e in {"half": col("x") / 2, "third": col("x") / -2, "folded": lit(7) / lit(-2), "mixed": col("x") / 2.0, "sum": col("x") + col("x") * 3 - 1, "nothing": col("x") / 0, "nothing2": col("x") / (lit(1) - 1), "null": col("x") + None}.items()]).collect()
    assert [r["half"] for r in made] == [2, -3, 0, None]
    assert [r["third"] for r in made] == [-2, 3, 0, None]
    assert [r["folded"] for r in made] == [-3] * 4
    assert [r["mixed"] for r in made] == [2.5, -3.5, 0.0, None]
    assert [r["sum"] for r in made] == [19, -29, -1, None]
    assert {r[n] for r in made for n in ("nothing", "nothing2", "null")} == {None}
    assert truths(df, "x / 0.0 = 1") == [None] * 4


@pytest.mark.parametrize(("kind", "low", "high"), [("SMALLINT", -(1 << 15), (1 << 15) - 1), ("INT", -(1 << 31), (1 << 31) - 1), ("BIGINT", -(1 << 63), (1 << 63) - 1)])
def test_integers_saturate(spark, kind, low, high):
    df = frame(spark, [("a", kind), ("b", kind)], [(high, 1), (low, 1), (low, -1), (high, high), (low, high), (high, -1), (3, 4), (None, 1)])
    made = df.select(*[lower_expr(e, df.schema).column.alias(n) for n, e in {"add": col("a") + col("b"), "sub": col("a") - col("b"), "mul": col("a") * col("b"), "div": col("a") / col("b")}.items()])
    clamp = lambda v: min(max(v, low), high)
    for row, (a, b) in zip(made.collect(), df.collect(), strict=True):
        if a is None:
            assert tuple(row) == (None,) * 4
        else:
            assert tuple(row) == (clamp(a + b), clamp(a - b), clamp(a * b), clamp(int(abs(a) // abs(b)) * (1 if a * b >= 0 else -1)))
    assert [t for _, t in made.dtypes] == [df.dtypes[0][1]] * 4


def test_division_by_a_column(spark):
    df = numbers(spark, [0, 2])
    with pytest.raises(PySparkException):
        selection.select(df, "10 / x = 5").collect()
    assert [r["x"] for r in selection.select(df, "x <> 0 AND 10 / x = 5").collect()] == [2]
    assert [r["x"] for r in selection.select(df, "x = 0 OR 10 / x = 5").collect()] == [0, 2]
    assert [r["x"] for r in selection.select(df, "NOT (x = 0 OR 10 / x = 4)").collect()] == [2]


def test_in(spark):
    df = numbers(spark, [1, 4, None])
    assert truths(df, "x IN (1, 2, 3)") == [True, False, None]
    assert truths(df, "x IN (1, NULL)") == [True, None, None]
    assert truths(df, "x NOT IN (1, NULL)") == [False, None, None]
    assert truths(df, col("x").is_in()) == [False, False, None]
    assert truths(df, "x IN ()") == [False, False, None]
    assert truths(df, col("x").is_in(*range(50))) == [True, True, None]
    assert truths(df, "x IN (1.0, 4.5)") == [True, False, None]
    assert truths(df, "x IN (x - 1, 2 + 2)") == [False, True, None]
    big = numbers(spark, [1, 1 << 40], "BIGINT")
    assert truths(big, "x IN (1, 1099511627776)") == [True, True]
    with pytest.raises(TypeMismatch):
        selection.plan(df, "x IN (1, 'one')")


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("hello%", ["hello world", "hello"], ["hell", "", "Hello"]), ("%world", ["hello world", "world"], ["worlds"]), ("%lo w%", ["hello world"], ["low"]),
        ("a%b%c", ["abc", "aXYZbZc"], ["abXd", "ac"]), ("a_c", ["abc", "a\nc"], ["ac", "abbc"]), ("hello", ["hello"], ["hello ", "hell"]),
        ("%", ["", "x\ny"], []), ("", [""], ["x"]), (r"a\b", ["a\\b"], ["ab"]), (r"a\%", ["a\\", "a\\x"], ["a%"]), ("a.c", ["a.c"], ["abc"]), ("x%\ny", ["x1\ny"], ["x1y"]),
    ],
)
def test_like(spark, pattern, yes, no):
    df = frame(spark, [("s", "VARCHAR(128)")], [(v,) for v in [*yes, *no, None]])
    assert truths(df, Like(col("s"), pattern)) == [True] * len(yes) + [False] * len(no) + [None]
    assert truths(df, ~Like(col("s"), pattern)) == [False] * len(yes) + [True] * len(no) + [None]


def test_like_takes_text(spark):
    with pytest.raises(TypeMismatch):
        selection.plan(numbers(spark, [1]), "x LIKE '1%'")


def test_text_after_null_text(spark):
    df = frame(spark, [("a", "VARCHAR(16)"), ("b", "VARCHAR(16)"), ("c", "VARCHAR(16)")], [("X", None, "Z"), (None, "mid", None), ("AA", "BB", "CC"), (None, "target", None)])
    assert truths(df, "c = 'Z'") == [True, None, False, None]
    assert truths(df, "b = 'target'") == [None, False, False, True]


def test_types_that_do_not_go_together(spark):
    df = frame(spark, [("i", "INT"), ("s", "VARCHAR(9)"), ("d", "DATE"), ("b", "BOOLEAN"), ("n", "NUMERIC(8,2)"), ("t", "TIMESTAMP"), ("bits", "BIT(4)")], [])
    for bad in ("i = 'one'", "s > 1", "d = 5", "b = 1", "s + 1 = 2", "i = d", "d = 'yesterday'", "t = '2024-01-01'", "i LIKE '1'", "missing = 1", "I = 1"):
        with pytest.raises(TypeMismatch):
            selection.plan(df, bad)
    for good in ("i = 2.5", "i = n", "d = '2024-02-29'", "d = DATE '2024-02-29'", "b = TRUE", "b = 'f'", "n < 1.5", "t > '2024-01-01 10:00:00'", "bits = B'1010'", "bits = '0101'", "s = NULL", "i = TRUE"):
        selection.plan(df, good)


def test_typed_comparisons(spark):
    from datetime import datetime
    from decimal import Decimal

    df = frame(spark, [("d", "DATE"), ("b", "BOOLEAN"), ("n", "NUMERIC(8,3)"), ("t", "TIMESTAMP"), ("bits", "BIT(4)"), ("f", "REAL"), ("x", "DOUBLE PRECISION")], [(date(2024, 2, 29), True, Decimal("12.340"), datetime(2024, 1, 1, 10), "1010", 0.5, float("nan")), (date(2023, 1, 1), False, Decimal("-1"), datetime(2020, 1, 1), "0001", -0.0, -0.0)])
    for where, expected in {
        "d >= '2024-02-29'": [True, False], "b = TRUE": [True, False], "b < 't'": [False, True], "n = 12.34": [True, False], "t < TIMESTAMP '2024-01-01 10:00:00.5'": [True, True],
        "bits > B'0101'": [True, False], "f = 0.5": [True, False], "x > 1e308": [True, False], "x = 0": [False, True], "f = x": [False, True], "n > 0": [True, False],
    }.items():
        assert truths(df, where) == expected, where
    assert truths(df, col("d").eq(date(2024, 2, 29))) == [True, False]
    assert truths(df, col("bits").eq(BitLiteral("1010"))) == [True, False]
    assert truths(df, col("n").eq(Decimal("12.34"))) == [True, False]


def test_char_compares_without_padding(spark):
    df = frame(spark, [("c", "CHAR(5)"), ("v", "VARCHAR(9)")], [("ab   ", "ab"), ("R    ", "r")])
    assert truths(df, "c = 'ab'") == [True, False]
    assert truths(df, "c = v") == [True, False]
    assert truths(df, "c IN ('x', 'ab  ')") == [True, False]
    assert truths(df, "c LIKE '%b'") == [False, False]
    assert truths(df, "c < v") == [False, True]


def test_exists_is_a_wrapper(spark):
    df = numbers(spark, [1, 2, None])
    assert truths(df, Exists(col("x").eq(1))) == [True, False, None]


def test_deep_chains(spark):
    df = numbers(spark, [150, -1, None])
    chain = col("x").eq(150)
    for i in range(150):
        chain = chain | col("x").eq(i + 1000)
    assert truths(df, chain) == [True, False, None]


def test_rows_that_fail(spark):
    df = frame(spark, [("x", "INT"), ("y", "INT")], [(0, 1), (2, 0), (None, 4), (5, None)])
    found = selection.checked(df, "y <> 0 AND 10 / x > y OR x / y = 1").collect()
    assert [r["truth"] for r in found] == [None, None, None, None]
    assert [r["error"] is not None for r in found] == [True, True, False, False]
    items = list(selection.iterate_all(df, "10 / x = 5"))
    assert [i.row["x"] if isinstance(i, selection.Failed) else i["x"] for i in items] == [0, 2]
    # what is decided before doesn't fail, and what fails before isn't decided
    assert truths(df.where("x = 0"), "x <> 0 AND (1 / x = 1 OR 2 / x = 2)") == [False]
    for where in ("1 / x = 1 AND x <> 0", "1 / x = 1 OR x = 0", "x / (10 / x) IS NULL", "10 / x IN (1, 2)", "NOT (x = 1 AND y = 1 OR 10 / x = 1)"):
        with pytest.raises(PySparkException, match="division by zero"):
            truths(df.where("x = 0"), where)
    with pytest.raises(PySparkException, match="division by zero"):
        df.select(lower_expr(col("y") / col("x"), df.schema).column).collect()
    assert [r["truth"] for r in selection.checked(df, "x IS NULL OR x > 2").collect()] == [False, False, True, True]


def test_long_chains_that_may_fail(spark):
    """Plans grow in proportion to the predicate."""
    df = numbers(spark, [3, 60])

    def chain(n):
        return reduce(operator.and_, [(lit(1000) / (col("x") - i - 10)) > -200 for i in range(n)])

    size = lambda n: len(selection.plan(df, chain(n))._jc.toString())
    assert truths(df.where("x = 3"), chain(12)) == [True] and size(80) < 2.2 * size(40)
    nested = col("x").eq(3)
    for i in range(6):
        nested = (nested & (lit(7) / col("x")).eq(2)) | (lit(6) / col("x")).eq(i + 2)
    assert truths(df.where("x = 3"), nested) == [True]


def test_forms_of_selection(spark):
    df = frame(spark, [("v", "INT")], [(5,), (15,), (None,), (20,), (3,)])
    where = "SELECT anything FROM anywhere WHERE v > 10"
    assert sorted(r["v"] for r in selection.select(df, where).collect()) == [15, 20]
    assert selection.count(df, where) == 2
    assert sorted(r["v"] for r in selection.iterate(df, where)) == [15, 20]
    got = []
    assert selection.for_each(df, where, got.append) == 2 and len(got) == 2
    matched, rejected, unknown = selection.buckets(df, where)
    assert [matched.count(), rejected.count(), unknown.count()] == [2, 2, 1]
    assert {r["bucket"]: r["count"] for r in selection.bucketed(df, where).groupBy("bucket").count().collect()} == {"MATCHED": 2, "REJECTED": 2, "UNKNOWN": 1}
    assert selection.select(df, F.col("v") > 10).count() == 2

    def stop(row):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        selection.for_each(df, where, stop)
    empty = df.where("false")
    assert selection.count(empty, where) == 0 and list(selection.iterate(empty, where)) == []


def test_columns_by_place_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, truth int")
    assert selection.column_at(df, 1).columns == ["c`d"]
    assert selection.select(df, '"a.b" = 1 AND `c``d` = 2 AND t.truth = 3').count() == 1
    with pytest.raises(IndexError):
        selection.column_at(df, 3)


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan, code is generated, nothing is shuffled."""
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("cast(id as int) as x", "cast(id % 7 as string) as s", "id * 1.5D as d").write.parquet(path)
    df = spark.read.parquet(path)

    def plan(f):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            f.explain("formatted")
        return said.getvalue()

    found = plan(selection.select(df, "x BETWEEN 1 + 1 AND 10 * 2 AND s LIKE '3%' AND d > 3"))
    for pushed in ("GreaterThanOrEqual(x,2)", "LessThanOrEqual(x,20)", "StringStartsWith(s,3)", "GreaterThan(d,3.0)"):
        assert pushed in found
    assert "* Filter" in found and "Exchange" not in found
    assert "In(x, [1,5])" in plan(selection.select(df, "x IN (1, 5)"))
    guarded = plan(selection.select(df, "x <> 0 AND 10 / x = 5"))
    assert "Not(EqualTo(x,0))" in guarded
    assert "ReadSchema: struct<x:int>" in plan(selection.counting(df, "x > 3"))
