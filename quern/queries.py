"""The engine's operators as queries over the star schema, each with the SQL that gives the same rows.

Queries run over whole tables. A selection keeps all columns, as the engine has no projection; where a
table has no NULLs, some are derived with ``nullif`` on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.functions.strict import parse, validated
from quern.more_queries import QUERIES as MORE
from quern.operators import selection
from quern.plans.ast import Exists, col, lit
from quern.plans.lower import lower_expr
from quern.plans.typed import typed, value
from quern.session import prepare, shared_dir
from quern.sources.catalog import Catalog
from quern.sources.csv import read_csv
from quern.streaming.selection import append_to, table_stream
from quern.types import Schema, schema_of

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: name: (table, predicate, the same for the oracle where it is written otherwise there)
_WHERE: dict[str, tuple] = {
    "cmp_eq": ("lineitem", "l_linenumber = 3"),
    "cmp_ne": ("lineitem", "l_returnflag <> 'N'"),
    "cmp_lt": ("lineitem", "l_quantity < 5.0"),
    "cmp_le": ("lineitem", "l_linenumber <= 2"),
    "cmp_gt": ("lineitem", "l_extendedprice > 50000"),
    "cmp_ge": ("lineitem", "l_discount >= 0.05"),
    "cmp_lt_swapped": ("lineitem", "4 < l_linenumber"),
    "cmp_int_double": ("lineitem", "l_linenumber > 3.5"),
    "cmp_bigint_literal": ("orders", "o_orderkey < 9007199254740993 AND o_orderkey >= 7000"),
    "cmp_columns": ("lineitem", "l_quantity < l_linenumber"),
    "cmp_text_order": ("customer", "c_mktsegment >= 'FURNITURE'"),
    "cmp_constant": ("nation", "1 = 1"),
    "cmp_timestamp": ("orders", "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"),
    "cmp_timestamp_text": ("orders", "o_orderdate >= '1997-06-01 00:00:00'", "o_orderdate >= TIMESTAMP '1997-06-01 00:00:00'"),
    "and_or_not": ("lineitem", "(l_quantity > 40 OR l_linenumber = 1) AND NOT (l_returnflag = 'R')"),
    "or_chain": ("part", "p_size = 1 OR p_size = 7 OR p_size = 19 OR p_brand = 'Brand#3'"),
    "nested_parens": ("part", "((p_size > 10) AND ((p_size + 1) * 2 < 60))"),
    "between": ("lineitem", "l_quantity BETWEEN 1 + 1 AND 10 * 2"),
    "not_between": ("lineitem", "l_quantity NOT BETWEEN 5 AND 45"),
    "in_text": ("orders", "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "in_int": ("lineitem", "l_linenumber IN (1, 3, 5)"),
    "in_bigint": ("orders", "o_custkey IN (1, 2, 3, 500, 700)"),
    "in_expression": ("lineitem", "l_linenumber IN (l_linenumber - 1, 2 + 2)"),
    "not_in": ("orders", "o_orderstatus NOT IN ('F', 'P')"),
    "in_null": ("orders", "o_orderstatus IN ('F', NULL)"),
    "like_prefix": ("part", "p_name LIKE 'cold%'"),
    "like_suffix": ("part", "p_name LIKE '%widget'"),
    "like_contains": ("part", "p_type LIKE '%ON%'"),
    "like_pattern": ("part", "p_brand LIKE 'Brand#_3'"),
    "like_mixed": ("part", "p_name LIKE '%l_ w%g%'"),
    "like_exact": ("part", "p_type LIKE 'ECONOMY'"),
    "not_like": ("part", "p_name NOT LIKE 'cold%'"),
    "arith_add": ("lineitem", "l_linenumber + 3 = 8"),
    "arith_sub": ("lineitem", "l_linenumber - 10 < 0 - 5"),
    "arith_mul_float": ("lineitem", "l_extendedprice * l_discount > 5000.0"),
    "arith_intdiv": ("lineitem", "l_linenumber / 2 = 2", "l_linenumber // 2 = 2"),
    "arith_intdiv_bigint": ("orders", "o_custkey / 100 = 3", "o_custkey // 100 = 3"),
    "arith_div_float": ("lineitem", "l_extendedprice / l_quantity > 1500.0"),
    "arith_unary_minus": ("customer", "c_acctbal < -500"),
    "div_zero_literal": ("nation", "n_nationkey / 0 IS NULL", "true"),
    "div_zero_guarded": ("nation", "n_regionkey <> 0 AND 10 / n_regionkey >= 5", "n_regionkey <> 0 AND 10 // nullif(n_regionkey, 0) >= 5"),
    "div_zero_guarded_or": ("nation", "n_regionkey = 0 OR 10 / n_regionkey >= 5", "n_regionkey = 0 OR 10 // nullif(n_regionkey, 0) >= 5"),
    "boolean_literal": ("nation", "n_regionkey = TRUE", "n_regionkey = 1"),
}


def _select(name: str) -> Query:
    source, where = _WHERE[name][:2]
    return lambda spark, sf_dir: selection.select(table(spark, sf_dir, source), where)


#: ``orders`` with a status that is NULL for P.
_STATUS_SQL = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority FROM orders"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", S.nullif(value(df, "o_orderstatus"), typed(F.lit("P"), "VARCHAR(1)")).alias("status"), "o_orderpriority")


#: name: (predicate over the table with NULLs, the same for the oracle)
_NULLS: dict[str, tuple] = {
    "is_null": ("status IS NULL",),
    "is_not_null": ("status IS NOT NULL",),
    "null_compare": ("status <> 'F'",),
    "null_not": ("NOT (status = 'F')",),
    "null_and": ("status = 'F' AND o_orderpriority = '1-URGENT'",),
    "null_or": ("status = 'F' OR o_orderpriority = '1-URGENT'",),
    "null_like": ("NOT (status LIKE 'F%')",),
    "null_in": ("status IN ('F', 'O')",),
    "null_not_in": ("status NOT IN ('F')",),
}


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def extract_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.column_at(table(spark, sf_dir, "customer"), 4)


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.evaluate(_status(spark, sf_dir), "status = 'F'").select("o_orderkey", "truth")


def three_valued_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.bucketed(_status(spark, sf_dir), "status = 'F'").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = selection.buckets(_status(spark, sf_dir), "status = 'F' OR o_orderpriority = '5-LOW'")
    named = [p.select("o_orderkey", F.lit(n).alias("bucket")) for p, n in zip(parts, (selection.MATCHED, selection.REJECTED, selection.UNKNOWN), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def count_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.counting(table(spark, sf_dir, "lineitem"), "l_quantity > 25.0")


def ast_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (col("l_quantity") + 1).between(10, 20) & ~col("l_returnflag").eq("R") & (Exists(col("l_linenumber").is_in(1, 2)) | col("l_tax").eq(0.0))
    return selection.select(table(spark, sf_dir, "lineitem"), where)


def in_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.evaluate(_status(spark, sf_dir), col("status").is_in()).select("o_orderkey", "truth")


def _expressions(source: str, key: str, **made) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(key, *[lower_expr(e, df.schema).column.alias(n) for n, e in made.items()])

    return run


_BIG = (1 << 63) - 20
_SATURATED: dict[str, tuple[Query, str]] = {
    "sat_int": (
        _expressions("nation", "n_nationkey", added=col("n_nationkey") + 2147483640, taken=lit(0) - 2147483640 - col("n_nationkey"), times=(col("n_nationkey") + 1) * 200000000, cut=(lit(0) - col("n_nationkey")) / 2),
        """SELECT n_nationkey, CAST(least(CAST(n_nationkey AS BIGINT) + 2147483640, 2147483647) AS INTEGER) AS added,
                  CAST(greatest(-2147483640 - CAST(n_nationkey AS BIGINT), -2147483648) AS INTEGER) AS taken,
                  CAST(least((CAST(n_nationkey AS BIGINT) + 1) * 200000000, 2147483647) AS INTEGER) AS times,
                  CAST(-n_nationkey // 2 AS INTEGER) AS cut FROM nation""",
    ),
    "sat_bigint": (
        _expressions("supplier", "s_suppkey", added=col("s_suppkey") + _BIG, taken=lit(0) - _BIG - col("s_suppkey"), times=(col("s_suppkey") + 1) * 400000000000000000),
        f"""SELECT s_suppkey, CAST(least(CAST(s_suppkey AS HUGEINT) + {_BIG}, 9223372036854775807) AS BIGINT) AS added,
                  CAST(greatest(-{_BIG} - CAST(s_suppkey AS HUGEINT), CAST('-9223372036854775808' AS HUGEINT)) AS BIGINT) AS taken,
                  CAST(least((CAST(s_suppkey AS HUGEINT) + 1) * 400000000000000000, 9223372036854775807) AS BIGINT) AS times FROM supplier""",
    ),
    "arith_real": (
        _expressions("customer", "c_custkey", half=col("c_acctbal") / 2, more=col("c_acctbal") + 1, widened=col("c_nationkey") * 1.5),
        "SELECT c_custkey, c_acctbal / 2 AS half, c_acctbal + 1 AS more, CAST(c_nationkey AS DOUBLE) * 1.5::DOUBLE AS widened FROM customer",
    ),
}


def _functions(source: str, key: str, make) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(key, *[x.alias(n) for n, x in make(lambda name: value(df, name)).items()])

    return run


_PADDED = "concat(chr(9), '  ', p_name, ' ', chr(160))"


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    own = typed(F.concat(F.lit("\t  "), F.col("p_name"), F.lit(" \xa0")), "VARCHAR(100)")
    return df.select("p_partkey", S.trim(own).alias("both"), S.ltrim(own).alias("left_side"), S.rtrim(own).alias("right_side"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", S.length(value(df, "p_name")).alias("n"), S.length(typed(F.rpad("p_type", 25, " "), "CHAR(25)")).alias("n_char"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.col("o_orderdate").cast("string")
    texts = {"small": (F.col("o_custkey").cast("string"), "SMALLINT"), "number": (F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "NUMERIC(7,2)"), "moment": (moment, "TIMESTAMP"), "day": (F.substring(moment, 1, 10), "DATE"), "short": (F.col("o_orderpriority"), "VARCHAR(8)"), "flag": (F.col("o_orderstatus"), "BOOLEAN"), "bits": (F.conv(F.col("o_custkey").cast("string"), 10, 2), "BIT(9)")}
    df = validated(table(spark, sf_dir, "orders"), texts)
    return df.select("o_orderkey", *texts, parse(F.col("o_orderstatus"), "CHAR(3)").alias("padded"))


_FUNCTIONS: dict[str, tuple[Query, str]] = {
    "fn_length": (_lengths, "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, CAST(length(p_type) AS BIGINT) AS n_char FROM part"),
    "fn_substring": (
        _functions("part", "p_partkey", lambda c: {"a": S.substring(c("p_name"), 2, 3), "b": S.substring(c("p_name"), 5, 99), "c": S.substring(c("p_name"), 50, 2)}),
        "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 5, 99) AS b, substring(p_name, 50, 2) AS c FROM part",
    ),
    "fn_upper_lower": (
        _functions("part", "p_partkey", lambda c: {"u": S.upper(c("p_name")), "l": S.lower(c("p_type"))}),
        "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part",
    ),
    "fn_trims": (
        _padded,
        f"SELECT p_partkey, p_name AS both, concat(p_name, ' ', chr(160)) AS left_side, concat(chr(9), '  ', p_name) AS right_side FROM (SELECT *, {_PADDED} FROM part)",
    ),
    "fn_extract": (
        _functions("events", "event_id", lambda c: {p.lower() + "_": S.extract(p, c("ts")) for p in S.PARTS["timestamp"]}),
        "SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS INTEGER) AS {p.lower()}_" for p in S.PARTS["timestamp"]) + " FROM events",
    ),
    "fn_abs": (
        _functions("customer", "c_custkey", lambda c: {"a": S.abs_(c("c_acctbal"))}),
        "SELECT c_custkey, abs(c_acctbal) AS a FROM customer",
    ),
    "fn_round": (
        _functions("customer", "c_custkey", lambda c: {"a": S.round_(c("c_acctbal"), 1), "b": S.round_(c("c_acctbal")), "c": S.round_(c("c_nationkey"), 2)}),
        "SELECT c_custkey, round(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS a, round(c_acctbal) AS b, c_nationkey AS c FROM customer",
    ),
    "fn_floor_ceiling": (
        _functions("customer", "c_custkey", lambda c: {"f": S.floor(c("c_acctbal")), "c": S.ceiling(c("c_acctbal")), "n": S.floor(c("c_nationkey"))}),
        "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_nationkey AS n FROM customer",
    ),
    "fn_cast_decimal": (
        _functions("customer", "c_custkey", lambda c: {"d": S.cast_strict(c("c_acctbal"), "DECIMAL(12,2)")}),
        "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS d FROM customer",
    ),
    "fn_cast_text": (
        _functions("orders", "o_orderkey", lambda c: {"digit": S.cast_strict(S.substring(c("o_orderpriority"), 1, 1), "INT"), "named": S.cast_strict(c("o_custkey"), "VARCHAR(20)"), "wide": S.cast_strict(c("o_custkey"), "BIGINT"), "at": S.cast_strict(c("o_orderdate"), "VARCHAR(26)")}),
        "SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS digit, CAST(o_custkey AS VARCHAR) AS named, o_custkey AS wide, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS at FROM orders",
    ),
    "fn_coalesce_nullif": (
        _functions("orders", "o_orderkey", lambda c: {"status": S.coalesce(S.nullif(c("o_orderstatus"), typed(F.lit("P"), "VARCHAR(1)")), typed(F.lit("?"), "VARCHAR(1)"))}),
        "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS status FROM orders",
    ),
    "fn_clock": (
        lambda spark, sf_dir: prepare(spark).range(1).select((S.current_timestamp().column.cast("date") == S.current_date().column).alias("same_day"), (F.hour(S.current_time().column) == F.hour(S.current_timestamp().column)).alias("same_hour")),
        "SELECT true AS same_day, true AS same_hour",
    ),
    "validate_literals": (
        _validated,
        """SELECT o_orderkey, o_custkey <= 32767 AS small, o_totalprice < 100000 AS number, true AS moment, true AS day,
                  length(o_orderpriority) <= 8 AS short, o_orderstatus = 'F' AS flag, o_custkey BETWEEN 256 AND 511 AS bits, rpad(o_orderstatus, 3, ' ') AS padded FROM orders""",
    ),
    "compare_decimals": (
        lambda spark, sf_dir: (lambda df: selection.select(df.select("*", F.col("c_acctbal").cast("decimal(12,2)").alias("two"), F.round("c_acctbal", 1).cast("decimal(14,3)").alias("three")), "two = three").drop("two", "three"))(table(spark, sf_dir, "customer")),
        "SELECT * FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) = CAST(round(c_acctbal, 1) AS DECIMAL(14,3))",
    ),
    "compare_nan": (
        lambda spark, sf_dir: selection.evaluate(table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, F.lit(float("nan"))).otherwise(F.col("n_regionkey").cast("double")).alias("x")), "x > 3.0").select("n_nationkey", "truth"),
        "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'NaN'::DOUBLE ELSE CAST(n_regionkey AS DOUBLE) END > 3.0::DOUBLE AS truth FROM nation",
    ),
    "compare_char": (
        lambda spark, sf_dir: selection.select(table(spark, sf_dir, "orders").select("o_orderkey", F.rpad("o_orderstatus", 5, " ").alias("status", metadata={"sqlType": "CHAR(5)"})), "status = 'F' OR status IN ('P', 'X')"),
        "SELECT o_orderkey, rpad(o_orderstatus, 5, ' ') AS status FROM orders WHERE o_orderstatus IN ('F', 'P')",
    ),
}


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as text and loaded again; every tenth line has a field too many, every seventh a bad number."""
    df = table(spark, sf_dir, "customer")
    schema = schema_of(df.schema)
    line = F.concat_ws(", ", *[F.col(c).cast("string") for c in df.columns])
    spoilt = F.when(F.col("c_custkey") % 10 == 3, F.concat(line, F.lit(",more"))).when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("x"), line)).otherwise(line)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.select(spoilt.alias(",".join(df.columns))).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\x01").csv(path)
    return read_csv(spark, path, schema).rows


def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table, filled from parquet and selected from."""
    df = table(spark, sf_dir, "part")
    catalog = Catalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.create_database("shop")
    catalog.create_table("shop", "part", Schema.of(("p_partkey", "BIGINT"), ("p_name", "VARCHAR(60)"), ("p_brand", "VARCHAR(20)"), ("p_type", "VARCHAR(30)"), ("p_size", "INT"), ("p_retailprice", "DOUBLE PRECISION")))
    catalog.append("shop", "part", df)
    return catalog.select("shop", "part", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring'")


def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one type that pass a stream, appended to a table by it."""
    schema = table(spark, sf_dir, "events").schema
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = table_stream(spark, f"{sf_dir}/events.parquet", schema)
    query = append_to(stream, "event_type = 'error' AND value > 10", f"{folder}/rows", f"{folder}/state", available_now=True)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


_OTHERS: dict[str, tuple[Query, str]] = {
    "scan_all": (scan_all, "SELECT * FROM nation"),
    "extract_column": (extract_column, "SELECT c_mktsegment FROM customer"),
    "evaluate": (evaluate, f"SELECT o_orderkey, status = 'F' AS truth FROM ({_STATUS_SQL})"),
    "three_valued_buckets": (three_valued_buckets, f"SELECT CASE WHEN status = 'F' THEN 'MATCHED' WHEN NOT (status = 'F') THEN 'REJECTED' ELSE 'UNKNOWN' END AS bucket, count(*) AS n FROM ({_STATUS_SQL}) GROUP BY 1"),
    "bucket_union": (bucket_union, f"SELECT o_orderkey, CASE WHEN status = 'F' OR o_orderpriority = '5-LOW' THEN 'MATCHED' WHEN NOT (status = 'F' OR o_orderpriority = '5-LOW') THEN 'REJECTED' ELSE 'UNKNOWN' END AS bucket FROM ({_STATUS_SQL})"),
    "count_matching": (count_matching, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25.0"),
    "ast_api": (ast_api, "SELECT * FROM lineitem WHERE l_quantity + 1 BETWEEN 10 AND 20 AND NOT (l_returnflag = 'R') AND (l_linenumber IN (1, 2) OR l_tax = 0.0)"),
    "in_empty": (in_empty, f"SELECT o_orderkey, CASE WHEN status IS NOT NULL THEN false END AS truth FROM ({_STATUS_SQL})"),
    "csv_source": (csv_source, "SELECT * FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 7 <> 2"),
    "catalog_table": (catalog_table, "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%ring'"),
    "stream_select": (stream_select, "SELECT * FROM events WHERE event_type = 'error' AND value > 10"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``entry()`` shows: one predicate with folding, BETWEEN, AND and NOT, from SQL text."""
    return selection.select(table(spark, sf_dir, "lineitem"), "SELECT * FROM lineitem WHERE l_quantity BETWEEN 1 + 1 AND 10 * 2 AND NOT (l_returnflag = 'R')")


_OTHERS["flagship"] = (flagship, "SELECT * FROM lineitem WHERE l_quantity BETWEEN 1 + 1 AND 10 * 2 AND NOT (l_returnflag = 'R')")


def queries() -> dict[str, Query]:
    nulls = {n: (lambda where: lambda spark, sf_dir: selection.select(_status(spark, sf_dir), where))(w[0]) for n, w in _NULLS.items()}
    return {n: _select(n) for n in _WHERE} | nulls | {n: q for part in (_SATURATED, _FUNCTIONS, _OTHERS, MORE) for n, (q, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    where = {n: f"SELECT * FROM {w[0]} WHERE {w[-1]}" for n, w in _WHERE.items()}
    nulls = {n: f"SELECT * FROM ({_STATUS_SQL}) WHERE {w[-1]}" for n, w in _NULLS.items()}
    return where | nulls | {n: sql for part in (_SATURATED, _FUNCTIONS, _OTHERS, MORE) for n, (_, sql) in part.items()}
