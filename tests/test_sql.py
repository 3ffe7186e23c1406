"""The WHERE language: what it reads, and what it refuses."""

from datetime import date, datetime, time

import pytest

from quern.plans.ast import And, Arithmetic, Between, BitLiteral, ColumnRef, Compare, In, IsNotNull, IsNull, Like, Literal, Not, Or
from quern.plans.sql import SqlError, parse_predicate, predicate_of

A, B = ColumnRef("a"), ColumnRef("b")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a = 1", Compare(A, "=", Literal(1))),
        ("a != 1", Compare(A, "<>", Literal(1))),
        ("a = 1 OR a = 2 AND b = 3", Or(Compare(A, "=", Literal(1)), And(Compare(A, "=", Literal(2)), Compare(B, "=", Literal(3))))),
        ("not a = 1 and b = 2", And(Not(Compare(A, "=", Literal(1))), Compare(B, "=", Literal(2)))),
        ("a + 2 * 3 - b > 1.5", Compare(Arithmetic("-", Arithmetic("+", A, Arithmetic("*", Literal(2), Literal(3))), B), ">", Literal(1.5))),
        ("(a + 2) * 3 <= b", Compare(Arithmetic("*", Arithmetic("+", A, Literal(2)), Literal(3)), "<=", B)),
        ("((a)) = (1)", Compare(A, "=", Literal(1))),
        ("((a = 1))", Compare(A, "=", Literal(1))),
        ("(a = 1) OR (b = 2)", Or(Compare(A, "=", Literal(1)), Compare(B, "=", Literal(2)))),
        ("t.s.a IS NULL", IsNull(A)),
        ("a + 1 IS NOT NULL", IsNotNull(Arithmetic("+", A, Literal(1)))),
        ("a BETWEEN 1 AND 2 AND b = 3", And(Between(A, Literal(1), Literal(2)), Compare(B, "=", Literal(3)))),
        ("a NOT BETWEEN 1 AND 2", Not(Between(A, Literal(1), Literal(2)))),
        ("a IN (1, NULL, 'x')", In(A, (Literal(1), Literal(None), Literal("x")))),
        ("a NOT IN ('it''s')", Not(In(A, (Literal("it's"),)))),
        (r"a LIKE '%\_x'", Like(A, r"%\_x")),
        ("a NOT LIKE 'x'", Not(Like(A, "x"))),
        ("a = TRUE AND b = false", And(Compare(A, "=", Literal(True)), Compare(B, "=", Literal(False)))),
        ("a = -5", Compare(A, "=", Literal(-5))),
        ("a = - b", Compare(A, "=", Arithmetic("-", Literal(0), B))),
        ("a = -9223372036854775808", Compare(A, "=", Literal(-(1 << 63)))),
        ("a = 9223372036854775808", Compare(A, "=", Literal(9223372036854775808.0))),
        ("a = 1e3 AND b = .5", And(Compare(A, "=", Literal(1000.0)), Compare(B, "=", Literal(0.5)))),
        ("a = DATE '2024-02-29'", Compare(A, "=", Literal(date(2024, 2, 29)))),
        ("a = TIMESTAMP '2024-02-29 01:02:03.5'", Compare(A, "=", Literal(datetime(2024, 2, 29, 1, 2, 3, 500000)))),
        ("a = TIME '01:02:03'", Compare(A, "=", Literal(time(1, 2, 3)))),
        ("a = B'1010'", Compare(A, "=", BitLiteral("1010"))),
        ('"a" = 1 -- done', Compare(A, "=", Literal(1))),
        ("date = 1", Compare(ColumnRef("date"), "=", Literal(1))),
        ("a = /* two */ 2", Compare(A, "=", Literal(2))),
    ],
)
def test_reads(text, expected):
    assert parse_predicate(text) == expected
    assert predicate_of(f"SELECT a, count(*) AS n FROM t AS x WHERE {text}") == expected


@pytest.mark.parametrize(
    "sql",
    [
        "", "DELETE FROM t WHERE a = 1", "SELECT * FROM t", "SELECT * FROM t WHERE a = 1; SELECT * FROM t WHERE a = 2", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a", "SELECT * FROM t WHERE a = ",
        "SELECT * FROM t WHERE a = 1 GROUP BY a", "SELECT * FROM t WHERE a = 1 ORDER BY a", "SELECT * FROM t WHERE a = 1 LIMIT 5", "SELECT * FROM t WHERE a = 1 UNION SELECT * FROM t WHERE a = 2",
        "SELECT * FROM t JOIN u ON t.a = u.a WHERE t.a = 1", "SELECT DISTINCT a FROM t WHERE a = 1", "SELECT * FROM t UNION SELECT * FROM u WHERE a = 1", "SELECT * FROM t WHERE upper(a) = 'X'", "SELECT * FROM t WHERE t.f(a) = 1",
        "SELECT * FROM t WHERE CAST(a AS INT) = 1", "SELECT * FROM t WHERE CASE WHEN a = 1 THEN 1 END = 1", "SELECT * FROM t WHERE EXISTS (SELECT 1)", "SELECT * FROM t WHERE a IN (SELECT 1)", "SELECT * FROM t WHERE a = (SELECT 1)",
        "SELECT * FROM t WHERE a % 2 = 0", "SELECT * FROM t WHERE a || b = 'x'", "SELECT * FROM t WHERE a & 1 = 1", "SELECT * FROM t WHERE a LIKE b", "SELECT * FROM t WHERE a LIKE 'x' ESCAPE '!'", "SELECT * FROM t WHERE a = 'open",
        "SELECT * FROM t WHERE (a = 1", "SELECT * FROM t WHERE a = 1)", "SELECT * FROM t WHERE a = DATE '2024-13-01'", "SELECT * FROM t WHERE a = b = c", "SELECT * FROM t WHERE a IS 1", "SELECT * FROM t WHERE a NOT = 1",
    ],
)
def test_refuses(sql):
    with pytest.raises(ValueError):
        predicate_of(sql)


def test_errors_say_where():
    with pytest.raises(SqlError, match="ORDER is not supported"):
        predicate_of("SELECT * FROM t WHERE a = 1 ORDER BY a")
    with pytest.raises(SqlError, match="there is no WHERE"):
        predicate_of("SELECT * FROM t;")
    assert predicate_of("SELECT * FROM t WHERE a = 1 ;") == Compare(A, "=", Literal(1))
