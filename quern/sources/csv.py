"""CSV as a source of typed rows, with a report of the lines that are not.

The format is plain: a header line that is skipped, one row a line, fields divided by commas (there is no
quoting, so a comma always divides) and trimmed. A field is read strictly as its column's type. A line
with another number of fields, or with any field that isn't a value of its type, is rejected whole, with
the reasons; blank lines are skipped. There is no spelling of NULL unless ``null_value`` gives one.

Lines are split and read by Spark expressions in the scan's own tasks; both results are lazy views of
that one pass, and neither shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.strict import staged, trim
from quern.types import Schema

#: A character that divides nothing in text files.
_NO_SEPARATOR = "\x01"


@dataclass(frozen=True)
class CsvRows:
    """``rows`` has the schema's columns; ``rejects`` has ``line`` and ``reasons``."""

    rows: DataFrame
    rejects: DataFrame


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # a line that holds the separator all the same is kept whole in the second column
    raw = spark.read.schema("line string, whole string").option("columnNameOfCorruptRecord", "whole").option("header", True).option("sep", _NO_SEPARATOR).option("quote", "").option("escape", "").option("enforceSchema", True).csv(path)
    return raw.select(F.coalesce("whole", "line").alias("line")).where(F.length(trim(F.coalesce("line", F.lit("")))) > 0)


def _field(i: int, null_value: str | None) -> Column:
    own = trim(F.get("_fields", F.lit(i)))
    return own if null_value is None else F.when(own != null_value, own)


def read_csv(spark: SparkSession, path: str | list[str], schema: Schema, *, null_value: str | None = None) -> CsvRows:
    """The typed rows of CSV files, and the lines that were rejected."""
    if not schema.columns:
        raise ValueError("the table has no columns")
    n = len(schema.columns)
    lines = _lines(spark, path).withColumn("_fields", F.split("line", ",", -1))
    own = {c.name: _field(i, null_value) for i, c in enumerate(schema.columns)}
    rows, values = staged(lines, {c.name: (own[c.name], c.type) for c in schema.columns})
    found = F.size("_fields")
    fields = [v.alias(f"_value_{i}") for i, v in enumerate(values.values())]
    checked = rows.select("line", "_fields", *[f"_text_{i}" for i in range(n)], *fields)
    wrong = [F.when(found != n, F.concat(F.lit(f"{n} fields are expected; there are "), found.cast("string")))]
    for i, c in enumerate(schema.columns):
        field, value = F.col(f"_text_{i}"), F.col(f"_value_{i}")
        wrong.append(F.when((found == n) & field.isNotNull() & value.isNull(), F.concat(F.lit(f"{c.name}: not a {c.type}: '"), field, F.lit("'"))))
    # a line comes out of a generator, under which Spark puts no filter, so that no field is read again for one
    line = F.struct("line", F.array_compact(F.array(*wrong)).alias("reasons"), *[f"_value_{i}" for i in range(n)])
    checked = checked.select(F.inline(F.array(line)))
    rows = checked.where(F.size("reasons") == 0).select([F.col(f"_value_{i}").alias(c.name, metadata=c.struct_field.metadata) for i, c in enumerate(schema.columns)])
    return CsvRows(rows, checked.where(F.size("reasons") > 0).select("line", "reasons"))
