"""Databases of tables: declarations in one JSON file, rows as parquet in a folder for each table.

The declaration is the schema: rows are read with it, never by inference, and appended only if they fit
it. Constraints are kept and shown, not enforced. A file that can't be read as a catalog is an error,
and is never written over.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.selection import select
from quern.plans import ast
from quern.sources.csv import CsvRows, read_csv
from quern.sources.files import FolderSize, exists, folder_size, folders, make_folder, read_text, write_text
from quern.types import Column, Constraints, Schema, parse_type

FILE = "catalog.json"


class CatalogError(ValueError):
    pass


def _safe(name: str, what: str) -> str:
    if not name or name in (".", "..") or any(c in name for c in '/\\:*?"<>|') or name[0] in "_.":
        raise CatalogError(f"{name!r} can't be the name of a {what}")
    return name


@dataclass
class Catalog:
    """The catalog in the folder ``root``; made there if there is none."""

    spark: SparkSession
    root: str
    databases: dict[str, dict[str, Schema]] = field(default_factory=dict)

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        if exists(self.spark, f"{self.root}/{FILE}"):
            self.load()
        elif found := [x for x in folders(self.spark, self.root) if x[0] not in "_."]:
            raise CatalogError(f"{self.root} holds folders ({', '.join(found[:3])}) but no {FILE}: it is not a place for a new catalog")
        else:
            make_folder(self.spark, self.root)
            self.save()

    # declarations

    def load(self) -> Catalog:
        try:
            text = json.loads(read_text(self.spark, f"{self.root}/{FILE}"))
            self.databases = {db: {name: Schema(tuple(_column(c) for c in t["columns"])) for name, t in d["tables"].items()} for db, d in text["databases"].items()}
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CatalogError(f"{self.root}/{FILE} is not a catalog: {e}") from e
        return self

    def save(self) -> None:
        text = {"databases": {db: {"tables": {name: {"columns": [_described(c) for c in schema.columns]} for name, schema in tables.items()}} for db, tables in self.databases.items()}}
        write_text(self.spark, f"{self.root}/{FILE}", json.dumps(text, indent=2))

    def create_database(self, name: str) -> None:
        if _safe(name, "database") in self.databases:
            raise CatalogError(f"database {name!r} exists")
        self.databases[name] = {}
        make_folder(self.spark, f"{self.root}/{name}")
        self.save()

    def show_databases(self) -> list[str]:
        return sorted(self.databases)

    def create_table(self, db: str, name: str, schema: Schema) -> bool:
        """Whether the table was made; one that exists is left as it is."""
        tables = self._tables(db)
        if _safe(name, "table") in tables:
            return False
        tables[name] = schema
        self.save()
        self.spark.createDataFrame([], schema.struct).write.mode("ignore").parquet(self.path(db, name))
        return True

    def show_tables(self, db: str) -> list[str]:
        return sorted(self._tables(db))

    def schema(self, db: str, name: str) -> Schema:
        tables = self._tables(db)
        if name not in tables:
            raise CatalogError(f"there is no table {name!r} in {db!r}")
        return tables[name]

    def path(self, db: str, name: str) -> str:
        return f"{self.root}/{db}/{name}"

    def _tables(self, db: str) -> dict[str, Schema]:
        if db not in self.databases:
            raise CatalogError(f"there is no database {db!r}")
        return self.databases[db]

    # rows

    def table(self, db: str, name: str) -> DataFrame:
        """All rows, lazily: filters and columns reach the parquet scan."""
        schema = self.schema(db, name)
        return self.spark.read.schema(schema.struct).parquet(self.path(db, name))

    def select(self, db: str, name: str, where: ast.Predicate | str | SparkColumn) -> DataFrame:
        return select(self.table(db, name), where)

    def append(self, db: str, name: str, rows: DataFrame) -> None:
        """Adds rows; their columns and Spark types must be the table's, in any order."""
        schema = self.schema(db, name)
        found, wanted = {f.name: f.dataType for f in rows.schema}, {f.name: f.dataType for f in schema.struct}
        if found != wanted:
            raise CatalogError(f"the rows don't fit {name!r}: {rows.schema.simpleString()}; it has {schema.struct.simpleString()}")
        rows.select([F.col(f"`{n}`") for n in schema.names]).write.mode("append").parquet(self.path(db, name))

    def load_csv(self, db: str, name: str, path: str | list[str], *, null_value: str | None = None) -> CsvRows:
        """Appends a CSV file's good lines; what it returns tells them and the rejected ones."""
        found = read_csv(self.spark, path, self.schema(db, name), null_value=null_value)
        self.append(db, name, found.rows)
        return found

    def statistics(self, db: str, name: str) -> FolderSize:
        self.schema(db, name)
        return folder_size(self.spark, self.path(db, name))


def _described(c: Column) -> dict:
    return {"name": c.name, "data_type": str(c.type), "nullable": c.nullable, "constraints": vars(c.constraints)}


def _column(x: dict) -> Column:
    return Column(x["name"], parse_type(x["data_type"]), x.get("nullable", True), Constraints(**(x.get("constraints") or {})))
