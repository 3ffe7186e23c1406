"""More of the engine's operators as queries, each with the SQL that gives the same rows: sources and sinks, the
catalog and its menu, types and their names, strict reading, and functions on the types that the tables lack."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, time
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.cli import Menu
from quern.functions import scalar as S
from quern.functions.strict import validated
from quern.operators import selection
from quern.plans.typed import typed, value
from quern.session import prepare, shared_dir
from quern.sources.catalog import Catalog, CatalogError
from quern.sources.console import lines, shown
from quern.sources.csv import CsvRows, read_csv
from quern.types import Column, Constraints, Schema, TypeMismatch, parse_type

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(prepare(spark))}/{name}-{uuid.uuid4().hex}"


def _values(rows: list[tuple], *names: str) -> str:
    """SQL for some rows."""

    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _told(spark: SparkSession, told: list[str]) -> DataFrame:
    """Lines that came to the driver, in order."""
    return spark.createDataFrame(list(enumerate(told, 1)), "n int, line string")


# ---- CSV


_CSV = Schema.of(("c_custkey", "BIGINT"), ("c_name", "VARCHAR(18)"), ("c_nationkey", "INT"))
_CSV_LINE = """CASE WHEN c_custkey % 10 = 3 THEN c_custkey || ' , ' || c_name || ',' || c_nationkey || ',more' WHEN c_custkey % 7 = 2 THEN 'x' || c_custkey || ',' || c_name || ',1.5' ELSE c_custkey || ' , ' || c_name || ', ' || c_nationkey END"""
_CSV_GOOD = "c_custkey % 10 <> 3 AND c_custkey % 7 <> 2"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Customers as text: every tenth line has a field too many, every seventh two that aren't numbers."""
    path = _folder(spark, "csv")
    text = table(spark, sf_dir, "customer").select(F.expr(_CSV_LINE).alias("c_custkey,c_name,c_nationkey"))
    text.write.option("header", True).option("quote", "").option("escape", "").option("sep", "\x01").csv(path)
    return path


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found: CsvRows = read_csv(spark, _written(spark, sf_dir), _CSV)
    return found.rejects.select("line", F.array_join("reasons", "; ").alias("reasons"))


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read into a table of the catalog, and read from it again by another catalog object."""
    root = _folder(spark, "catalog")
    catalog = Catalog(spark, root)
    catalog.create_database("shop")
    catalog.create_table("shop", "customer", _CSV)
    catalog.load_csv("shop", "customer", _written(spark, sf_dir))
    return Catalog(spark, root).table("shop", "customer")


# ---- forms of selection


def callback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a callback got, one by one, and how many there were."""
    got: list[str] = []
    n = selection.for_each(table(spark, sf_dir, "nation"), "n_regionkey = 1 OR n_name LIKE '%A'", lambda row: got.append(row["n_name"]))
    return spark.createDataFrame([(x, n) for x in got], "n_name string, n int")


def error_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An iteration in which rows that fail are items of their own."""
    items = selection.iterate_all(table(spark, sf_dir, "nation"), "10 / n_regionkey >= 5")
    return spark.createDataFrame([(i.row["n_nationkey"], True) if isinstance(i, selection.Failed) else (i["n_nationkey"], False) for i in items], "n_nationkey int, failed boolean")


def error_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.checked(table(spark, sf_dir, "nation"), "n_nationkey < 20 AND (10 / n_regionkey >= 5 OR n_nationkey / (n_regionkey - 1) > 3)")
    return found.select("n_nationkey", "truth", F.col("error").isNotNull().alias("failed"))


#: By nation: the truth, or no row where the reading from left to right fails.
_ERRORS = """SELECT n_nationkey, CASE WHEN failed THEN NULL ELSE truth END AS truth, failed FROM (
  SELECT n_nationkey, n_nationkey < 20 AND (10 // nullif(n_regionkey, 0) >= 5 OR n_nationkey // nullif(n_regionkey - 1, 0) > 3) AS truth,
         n_nationkey < 20 AND (n_regionkey = 0 OR (n_regionkey = 1 AND 10 // nullif(n_regionkey, 0) < 5)) AS failed FROM nation)"""
_CHAIN = " AND ".join(f"(100 / (n_nationkey - {i}) > -{200 + i} OR n_nationkey = {i + 1})" for i in range(30, 60))


def _evaluated(where: str) -> Query:
    return lambda spark, sf_dir: selection.evaluate(table(spark, sf_dir, "nation"), where).select("n_nationkey", "truth")


_REFUSED = [("n_missing = 1", "TypeMismatch"), ("N_NAME = 'X'", "TypeMismatch"), ("n_name > 1", "TypeMismatch"), ("n_nationkey = 'one'", "TypeMismatch"), ("n_name + 1 = 2", "TypeMismatch"), ("n_nationkey LIKE '1%'", "TypeMismatch"), ("n_nationkey IN (1, 'a')", "TypeMismatch"),
            ("upper(n_name) = 'X'", "SqlError"), ("n_nationkey % 2 = 1", "SqlError"), ("CAST(n_nationkey AS INT) = 1", "SqlError"), ("EXISTS (SELECT 1)", "SqlError"), ("n_name LIKE 'a' ESCAPE 'b'", "SqlError"), ("n_nationkey = 1 ORDER BY n_name", "SqlError"), ("n_nationkey =", "SqlError"),
            ("n_nationkey = 1 AND n_name = 'X'", "accepted")]


def bound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner says of predicates over ``nation``."""
    df, out = table(spark, sf_dir, "nation"), []
    for text, _ in _REFUSED:
        try:
            selection.plan(df, text)
            out.append((text, "accepted"))
        except ValueError as e:
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "predicate string, found string")


# ---- types

#: Spelling, display form, bytes, alignment, Spark's type.
_TYPES = [
    ("smallint", "SMALLINT", 2, 2, "smallint"), (" INTEGER ", "INT", 4, 4, "int"), ("int", "INT", 4, 4, "int"), ("BigInt", "BIGINT", 8, 8, "bigint"), ("real", "REAL", 4, 4, "float"), ("double precision", "DOUBLE PRECISION", 8, 8, "double"), ("FLOAT8", "DOUBLE PRECISION", 8, 8, "double"),
    ("numeric(10, 2)", "NUMERIC(10,2)", 6, 1, "decimal(10,2)"), ("DECIMAL(38,0)", "DECIMAL(38,0)", 20, 1, "decimal(38,0)"), ("bool", "BOOLEAN", 1, 1, "boolean"), ("char(7)", "CHAR(7)", 7, 1, "string"), ("character(3)", "CHARACTER(3)", 3, 1, "string"), ("varchar(20)", "VARCHAR(20)", None, 1, "string"),
    ("date", "DATE", 4, 4, "date"), ("time", "TIME", 8, 8, "time(6)"), ("timestamp", "TIMESTAMP", 8, 8, "timestamp_ntz"), ("bit(9)", "BIT(9)", 2, 1, "string"), ("text", None, None, None, None), ("numeric(39,0)", None, None, None, None), ("numeric(4,5)", None, None, None, None), ("char", None, None, None, None), ("int(4)", None, None, None, None),
]


def _type(text: str) -> tuple:
    try:
        kind = parse_type(text)
    except TypeMismatch:
        return text, None, None, None, None
    return text, str(kind), kind.size, kind.align, kind.spark.simpleString()


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([_type(t[0]) for t in _TYPES], "spelling string, shown string, bytes int, align int, spark string")


#: Texts of each type and whether they are values of it.
_SPELLINGS: dict[str, list[tuple[str, bool]]] = {
    "SMALLINT": [("32767", True), ("-32768", True), ("32768", False), (" +7 ", True), ("1.0", False), ("", False), ("'5'", False)],
    "INT": [("2147483647", True), ("-2147483649", False), ("0x1", False), ("12a", False), ("007", True)],
    "BIGINT": [("9223372036854775807", True), ("9223372036854775808", False), ("1e3", False), ("-0", True)],
    "REAL": [("1.5", True), ("-2", True), (".5", True), ("1e10", True), ("NaN", True), ("-inf", True), ("Infinity", True), ("1.0d", False), ("abc", False), ("", False), ("1,5", False)],
    "DOUBLE PRECISION": [("1e308", True), ("1.", True), ("+.5E-3", True), ("nan", True), ("1.0f", False), ("--1", False), ("e5", False)],
    "NUMERIC(5,2)": [("123.45", True), ("-999.99", True), ("1000", False), ("1.234", False), ("0001.5", True), ("1e2", False), ("'12.3'", True)],
    "BOOLEAN": [("true", True), ("FALSE", True), ("T", True), ("f", True), ("1", True), ("0", True), ("yes", False), ("on", False), ("2", False), ("", False)],
    "VARCHAR(4)": [("abcd", True), ("abcde", False), ("éé", True), ("ééé", False), ("", True), ("  ab  ", True), ("'abcd'", True)],
    "CHAR(3)": [("abc", True), ("a", True), ("abcd", False), ("€", True), ("€a", False)],
    "DATE": [("2024-02-29", True), ("2023-02-29", False), ("2024-1-5", True), ("2024", False), ("2024-13-01", False), ("2024/01/01", False), ("'2024-01-01'", True), ("2024-01-01 10:00:00", False)],
    "TIME": [("13:14:15", True), ("13:14:15.123456", True), ("24:00:00", False), ("13:14", False), ("13:60:00", False), ("13:14:15.1234567", False), ("'01:02:03'", True)],
    "TIMESTAMP": [("2024-02-29 01:02:03", True), ("2024-02-29 01:02:03.5", True), ("2024-02-29", False), ("2024-02-30 01:02:03", False), ("2024-02-29T01:02:03", False), ("2024-02-29 25:00:00", False)],
    "BIT(4)": [("1010", True), ("B'1010'", True), ("b'0000'", True), ("101", False), ("10102", False), ("1012", False), ("B'101'", False)],
}


def _spelt(kind: str) -> tuple[Query, str]:
    """The nations' keys choose the texts, all of which appear as there are fewer than 25."""
    texts = _SPELLINGS[kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = F.element_at(F.array(*[F.lit(t) for t, _ in texts]), (F.col("n_nationkey") % len(texts) + 1).cast("int"))
        return validated(table(spark, sf_dir, "nation").select("n_nationkey", own.alias("spelling")), {"fits": (F.col("spelling"), kind)})

    return run, f"SELECT n_nationkey, spelling, fits FROM nation JOIN ({_values([(i, *t) for i, t in enumerate(texts)], 'i', 'spelling', 'fits')}) ON n_nationkey % {len(texts)} = i"


_ALL = Schema.of(("a", "SMALLINT"), ("b", "INT"), ("c", "BIGINT"), ("d", "REAL"), ("e", "DOUBLE PRECISION"), ("f", "NUMERIC(8,2)"), ("g", "DECIMAL(38,3)"), ("h", "BOOLEAN"), ("i", "CHAR(5)"), ("j", "CHARACTER(3)"), ("k", "VARCHAR(9)"), ("l", "DATE"), ("m", "TIME"), ("n", "TIMESTAMP"), ("o", "BIT(4)"))
_ROWS = [
    (-32768, 2147483647, -(1 << 63), 0.5, 1e-3, Decimal("-12.30"), Decimal("12345678901234567890.125"), True, "ab   ", "xyz", "héllo", date(2024, 2, 29), time(23, 59, 59, 123456), datetime(1969, 12, 31, 23, 59, 59, 1), "1010"),
    (1, 2, 3, -2.0, 1e20, Decimal("0.00"), Decimal("-1.000"), False, "     ", "a  ", "", date(1, 1, 1), time(0, 0, 0), datetime(2024, 1, 1), "0000"),
    (None,) * 15,
]
_SHOWN = [
    ("-32768", "2147483647", "-9223372036854775808", "0.5", "0.001", "-12.30", "12345678901234567890.125", "true", "'ab'", "'xyz'", "'héllo'", "2024-02-29", "23:59:59.123456", "1969-12-31 23:59:59.000001", "B'1010'"),
    ("1", "2", "3", "-2", "100000000000000000000", "0.00", "-1.000", "false", "''", "'a'", "''", "0001-01-01", "00:00:00.000000", "2024-01-01 00:00:00.000000", "B'0000'"),
    ("NULL",) * 15,
]


def _every_type(spark: SparkSession) -> DataFrame:
    """Rows of every type, made from Python values, stored in a table and read again."""
    catalog = Catalog(prepare(spark), _folder(spark, "catalog"))
    catalog.create_database("db")
    catalog.create_table("db", "every", _ALL)
    catalog.append("db", "every", spark.createDataFrame(_ROWS, _ALL.struct))
    return catalog.table("db", "every")


def row_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value as it is displayed."""
    rows = [[shown(v, c.type) for c, v in zip(_ALL.columns, r, strict=True)] for r in _every_type(spark).toLocalIterator()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in _ALL.names]))


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's fields set, and set to NULL."""
    df = _every_type(spark).where("b IS NOT NULL")
    return df.withColumns({"a": F.lit(7).cast("smallint"), "k": F.lit(None).cast("string"), "h": ~F.col("h")}).select("a", "b", "h", "k")


def append_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't fit a table: too few columns, other names, other types; and those that do, in another order."""
    catalog, out = Catalog(prepare(spark), _folder(spark, "catalog")), []
    catalog.create_database("db")
    catalog.create_table("db", "t", Schema.of(("x", "INT"), ("s", "VARCHAR(5)")))
    for kind in ("x int", "x int, t string", "x bigint, s string", "x int, s string, y int", "s string, x int"):
        try:
            catalog.append("db", "t", spark.createDataFrame([], kind))
            out.append((kind, "appended"))
        except CatalogError:
            out.append((kind, "refused"))
    return spark.createDataFrame(out, "columns string, found string")


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = selection.select(table(spark, sf_dir, "nation"), "n_regionkey >= 1").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") < 4, F.col("n_regionkey") * 0.5).alias("half"))
    return _told(spark, list(lines(df)))


_CONSOLE = """WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey >= 1)
SELECT CAST(1 AS INTEGER) AS n, 'n_nationkey (INT) | n_name (VARCHAR(65535)) | half (DOUBLE PRECISION)' AS line
UNION ALL SELECT CAST(i + 1 AS INTEGER), 'Tuple ' || i || ': n_nationkey=' || n_nationkey || ' n_name=''' || n_name || ''' half=' || CASE n_regionkey WHEN 1 THEN '0.5' WHEN 2 THEN '1' WHEN 3 THEN '1.5' ELSE 'NULL' END FROM r"""


# ---- catalog and menu


def catalog_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second catalog object finds: databases, tables, columns, constraints, and what is refused."""
    root = _folder(spark, "catalog")
    catalog = Catalog(prepare(spark), root)
    for name in ("sales", "archive"):
        catalog.create_database(name)
    made = [catalog.create_table("sales", "t", Schema((Column("id", parse_type("bigint"), False, Constraints(not_null=True, unique=True)), Column("s", parse_type("char(4)"))))), catalog.create_table("sales", "t", Schema.of(("other", "INT"))), catalog.create_table("sales", "a", Schema.of(("x", "BIT(3)")))]
    again = Catalog(spark, root)
    out = [("databases", ",".join(again.show_databases())), ("tables", ",".join(again.show_tables("sales"))), ("none", ",".join(again.show_tables("archive"))), ("made", ",".join(map(str, made)))]
    out += [(f"column {c.name}", f"{c.type} {c.nullable} {c.constraints.not_null} {c.constraints.unique}") for c in again.schema("sales", "t").columns]
    for what, call in (("twice", lambda: again.create_database("sales")), ("empty", lambda: again.create_database("")), ("absent", lambda: again.show_tables("nowhere"))):
        try:
            call()
            out.append((what, "accepted"))
        except CatalogError:
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, found string")


_RELOADED = [("databases", "archive,sales"), ("tables", "a,t"), ("none", ""), ("made", "True,False,True"), ("column id", "BIGINT False True True"), ("column s", "CHAR(4) True False False"), ("twice", "refused"), ("empty", "refused"), ("absent", "refused")]


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of a table before and after rows come in."""
    catalog = Catalog(prepare(spark), _folder(spark, "catalog"))
    catalog.create_database("db")
    catalog.create_table("db", "t", Schema.of(("n_nationkey", "INT"), ("n_name", "VARCHAR(25)"), ("n_regionkey", "INT")))
    before = catalog.statistics("db", "t")
    catalog.append("db", "t", table(spark, sf_dir, "nation").coalesce(1))
    after = catalog.statistics("db", "t")
    return spark.createDataFrame([(after.files - before.files, after.bytes - before.bytes > 200)], "files int, grown boolean")


def menu_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the menu tells in a session, but for its own list: mistakes are told, and it goes on."""
    told: list[str] = []
    answers = iter(["4", "2", "shop", "2", "shop", "1", "3", "nowhere", "3", "shop", "5", "customer", "c_custkey:BIGINT", "broken", "c_name:VARCHAR(18)", "c_nationkey:INT", "", "4", "7", "customer", "SELECT * FROM customer WHERE c_custkey = 1", "x", "9"])
    Menu(Catalog(prepare(spark), _folder(spark, "catalog")), lambda question: next(answers), told.append).run()
    return _told(spark, [t for t in told if t[:2] not in {f"{i}." for i in range(1, 10)}])


_MENU = ["That failed: select a database first", "That failed: database 'shop' exists", "- shop", "That failed: there is no database 'nowhere'", "a column is written name:type", "The table is made.", "- customer", "c_custkey (BIGINT) | c_name (VARCHAR(18)) | c_nationkey (INT)", "Choose 1 to 9."]


# ---- functions on types that the tables lack


def fn_extract_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("d"), F.to_time(F.date_format("ts", "HH:mm:ss")).alias("t"))
    parts = {**{f"{p.lower()}_": S.extract(p, value(df, "d")) for p in S.PARTS["date"]}, **{f"{p.lower()}_": S.extract(p, value(df, "t")) for p in S.PARTS["time"]}}
    return df.select("event_id", *[x.alias(n) for n, x in parts.items()])


def fn_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,3)").alias("n"))
    n = value(df, "n")
    return df.select("c_custkey", S.abs_(n).alias("a"), S.round_(n, 1).alias("r"), S.round_(n).alias("r0"), S.floor(n).alias("f"), S.ceiling(n).alias("c"))


def fn_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 8).cast("float").alias("x"))
    x = value(df, "x")
    return df.select("p_partkey", S.abs_(x).alias("a"), S.round_(x, 1).alias("r"), S.floor(x).alias("f"), S.ceiling(x).alias("c"), S.abs_(typed(F.col("p_partkey").cast("smallint"), "SMALLINT")).alias("s"))


QUERIES: dict[str, tuple[Query, str]] = {
    "csv_rejects": (csv_rejects, f"""SELECT {_CSV_LINE} AS line, CASE WHEN c_custkey % 10 = 3 THEN '3 fields are expected; there are 4' ELSE 'c_custkey: not a BIGINT: ''x' || c_custkey || '''; c_nationkey: not a INT: ''1.5''' END AS reasons FROM customer WHERE NOT ({_CSV_GOOD})"""),
    "csv_load": (csv_load, f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE {_CSV_GOOD}"),
    "callback_filter": (callback_filter, "SELECT n_name, CAST(count(*) OVER () AS INTEGER) AS n FROM nation WHERE n_regionkey = 1 OR n_name LIKE '%A'"),
    "error_items": (error_items, "SELECT n_nationkey, n_regionkey = 0 AS failed FROM nation WHERE n_regionkey = 0 OR 10 // nullif(n_regionkey, 0) >= 5"),
    "error_column": (error_column, _ERRORS),
    "fallible_chain": (_evaluated(_CHAIN), "SELECT n_nationkey, " + " AND ".join(f"(CAST(trunc(100 / (n_nationkey - {i})) AS INTEGER) > -{200 + i} OR n_nationkey = {i + 1})" for i in range(30, 60)) + " AS truth FROM nation"),
    "qualified_ref": (lambda spark, sf_dir: selection.select(table(spark, sf_dir, "nation"), "nation.n_regionkey = 1 AND (shop.nation.\"n_name\" > 'B' OR t.`n_nationkey` < 2)"), "SELECT * FROM nation WHERE n_regionkey = 1 AND (n_name > 'B' OR n_nationkey < 2)"),
    "cmp_null_literal": (_evaluated("n_nationkey = NULL OR n_nationkey < 3"), "SELECT n_nationkey, n_nationkey = NULL OR n_nationkey < 3 AS truth FROM nation"),
    "in_null_not": (_evaluated("NOT (n_regionkey IN (1, NULL))"), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN false END AS truth FROM nation"),
    "is_null_never": (_evaluated("n_name IS NULL OR NULL IS NULL AND n_regionkey = 2"), "SELECT n_nationkey, n_regionkey = 2 AS truth FROM nation"),
    "bound_names": (bound_names, _values(_REFUSED, "predicate", "found")),
    "type_names": (type_names, _values(_TYPES, "spelling", "shown", "bytes", "align", "spark")),
    "row_round_trip": (row_round_trip, _values(_SHOWN, *_ALL.names)),
    "row_changes": (row_changes, "SELECT CAST(7 AS SMALLINT) AS a, b, h, CAST(NULL AS VARCHAR) AS k FROM (VALUES (2147483647, false), (2, true)) AS t(b, h)"),
    "append_refused": (append_refused, _values([("x int", "refused"), ("x int, t string", "refused"), ("x bigint, s string", "refused"), ("x int, s string, y int", "refused"), ("s string, x int", "appended")], "columns", "found")),
    "console_lines": (console_lines, _CONSOLE),
    "catalog_reload": (catalog_reload, _values(_RELOADED, "what", "found")),
    "table_statistics": (table_statistics, "SELECT CAST(1 AS INTEGER) AS files, true AS grown"),
    "menu_session": (menu_session, _values(list(enumerate(_MENU, 1)), "n", "line")),
    "fn_extract_parts": (fn_extract_parts, "SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS INTEGER) AS {p.lower()}_" for p in S.PARTS["timestamp"]) + " FROM events"),
    "fn_decimals": (fn_decimals, "SELECT c_custkey, abs(n) AS a, CAST(round(n, 1) AS DECIMAL(12,1)) AS r, CAST(round(n, 0) AS DECIMAL(10,0)) AS r0, CAST(floor(n) AS DECIMAL(10,0)) AS f, CAST(ceil(n) AS DECIMAL(10,0)) AS c FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,3)) AS n FROM customer)"),
    "fn_reals": (fn_reals, "SELECT p_partkey, abs(x) AS a, CAST(CASE WHEN x < 0 THEN -floor(-x * 10 + 0.5) ELSE floor(x * 10 + 0.5) END AS REAL) / 10::REAL AS r, floor(x) AS f, ceil(x) AS c, abs(CAST(p_partkey AS SMALLINT)) AS s FROM (SELECT p_partkey, CAST((p_size - 25) / 8 AS REAL) AS x FROM part)"),
} | {f"validate_{k.split('(')[0].lower().replace(' ', '_')}": _spelt(k) for k in _SPELLINGS}
