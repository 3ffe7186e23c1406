"""Selection: a predicate applied to a table, in every form in which its result is wanted.

A predicate is SQL text, an AST or a lowered column. Each form is one narrow transformation or one
aggregate over the scan: no form shuffles rows, caches them or brings more than its result to the
driver. ``iterate`` and ``for_each`` hold one partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quern.plans import ast
from quern.plans.lower import FAILED, lower, lower_checked
from quern.plans.sql import parse_predicate, predicate_of
from quern.types import type_of

MATCHED, REJECTED, UNKNOWN = "MATCHED", "REJECTED", "UNKNOWN"


def plan(df: DataFrame, where: ast.Predicate | str | Column) -> Column:
    """The predicate checked against ``df`` and lowered; text is a SELECT statement or a bare predicate."""
    return where if isinstance(where, Column) else lower(_parsed(where), df.schema)


def _parsed(where: ast.Predicate | str) -> ast.Predicate:
    if isinstance(where, str):
        return predicate_of(where) if where.lstrip().upper().startswith("SELECT") else parse_predicate(where)
    return where


def evaluate(df: DataFrame, where: ast.Predicate | str | Column, name: str = "truth") -> DataFrame:
    """``df`` with the predicate's value for each row: true, false or NULL for unknown."""
    return df.withColumn(name, plan(df, where))


def checked(df: DataFrame, where: ast.Predicate | str, name: str = "truth", error: str = "error") -> DataFrame:
    """``df`` with the predicate's value and, where it fails on a row, the error's text: no row ends the query."""
    truth, wrong = lower_checked(_parsed(where), df.schema)
    return df.withColumns({name: truth, error: F.when(wrong, F.lit(FAILED))})


def select(df: DataFrame, where: ast.Predicate | str | Column) -> DataFrame:
    """The rows for which the predicate is true."""
    return df.where(plan(df, where))


def bucketed(df: DataFrame, where: ast.Predicate | str | Column, name: str = "bucket") -> DataFrame:
    """``df`` with MATCHED, REJECTED or UNKNOWN for each row, in one pass."""
    p = plan(df, where)
    return df.withColumn(name, F.when(p, F.lit(MATCHED)).when(~p, F.lit(REJECTED)).otherwise(F.lit(UNKNOWN)))


def buckets(df: DataFrame, where: ast.Predicate | str | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, rejected, unknown) as three lazy tables, each pushed into its own scan."""
    p = plan(df, where)
    return df.where(p), df.where(~p), df.where(p.isNull())


def counting(df: DataFrame, where: ast.Predicate | str | Column) -> DataFrame:
    """One row ``n``: how many rows match. Only the predicate's columns are read."""
    return df.where(plan(df, where)).agg(F.count(F.lit(1)).alias("n"))


def count(df: DataFrame, where: ast.Predicate | str | Column) -> int:
    return counting(df, where).first()["n"]


def iterate(df: DataFrame, where: ast.Predicate | str | Column) -> Iterator[Row]:
    """The matching rows, pulled lazily; a row on which the predicate fails ends the iteration with its error."""
    return select(df, where).toLocalIterator(prefetchPartitions=True)


@dataclass(frozen=True)
class Failed:
    """A row on which the predicate fails."""

    row: Row
    reason: str


def iterate_all(df: DataFrame, where: ast.Predicate | str) -> Iterator[Row | Failed]:
    """The matching rows, and in their places those on which the predicate fails, as items; nothing ends the iteration."""
    truth, wrong = lower_checked(_parsed(where), df.schema)
    for r in df.select(F.struct("*").alias("row"), wrong.alias("wrong"), truth.alias("truth")).where("wrong OR truth").toLocalIterator(prefetchPartitions=True):
        yield Failed(r["row"], FAILED) if r["wrong"] else r["row"]


def for_each(df: DataFrame, where: ast.Predicate | str | Column, callback: Callable[[Row], None]) -> int:
    """Calls back with each matching row, on the driver, and returns how many there were; an error ends it."""
    n = 0
    for row in iterate(df, where):
        callback(row)
        n += 1
    return n


def column_at(df: DataFrame, index: int) -> DataFrame:
    """One column by its place, from 0; no other is read."""
    if not 0 <= index < len(df.columns):
        raise IndexError(f"there is no column {index}; there are {len(df.columns)}")
    f = df.schema[index]
    return df.select(F.col(f"`{f.name.replace('`', '``')}`").alias(f.name, metadata=f.metadata or {} | ({"sqlType": str(k)} if (k := type_of(f)) else {})))
