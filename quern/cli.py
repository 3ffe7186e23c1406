"""A small menu over a catalog: ``python -m quern.cli FOLDER``.

A mistake in an answer is told and the menu goes on.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from quern.session import local
from quern.sources.catalog import Catalog
from quern.sources.console import show
from quern.types import Column, Schema, parse_type

CHOICES = (
    "Show databases", "Create a database", "Select a database", "Show tables", "Create a table",
    "Load a CSV file", "Show rows by an SQL query", "Show table statistics", "Leave",
)


class Menu:
    def __init__(self, catalog: Catalog, ask: Callable[[str], str] = input, tell: Callable[[str], None] = print):
        self.catalog, self.ask, self.tell = catalog, ask, tell
        self.db: str | None = None

    def run(self) -> None:
        steps = [self.databases, self.create_database, self.select_database, self.tables, self.create_table, self.load, self.query, self.statistics]
        while True:
            for i, choice in enumerate(CHOICES, 1):
                self.tell(f"{i}. {choice}")
            try:
                given = self.ask("Choice: ").strip()
            except EOFError:
                return
            if given == str(len(CHOICES)):
                return
            if not given.isdigit() or not 1 <= int(given) < len(CHOICES):
                self.tell(f"Choose 1 to {len(CHOICES)}.")
                continue
            try:
                steps[int(given) - 1]()
            except Exception as e:
                self.tell(f"That failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}")

    def _current(self) -> str:
        if self.db is None:
            raise ValueError("select a database first")
        return self.db

    def databases(self) -> None:
        for name in self.catalog.show_databases() or ["no databases"]:
            self.tell(f"- {name}")

    def create_database(self) -> None:
        self.catalog.create_database(self.ask("Name: ").strip())

    def select_database(self) -> None:
        name = self.ask("Name: ").strip()
        self.catalog.show_tables(name)
        self.db = name

    def tables(self) -> None:
        for name in self.catalog.show_tables(self._current()) or ["no tables"]:
            self.tell(f"- {name}")

    def create_table(self) -> None:
        db, name, columns = self._current(), self.ask("Table: ").strip(), []
        while given := self.ask("Column (name:type, empty to end): ").strip():
            own, sign, kind = given.partition(":")
            try:
                if not sign or not own.strip():
                    raise ValueError("a column is written name:type")
                columns.append(Column(own.strip(), parse_type(kind)))
            except ValueError as e:
                self.tell(str(e))
        made = self.catalog.create_table(db, name, Schema(tuple(columns)))
        self.tell("The table is made." if made else "The table exists; it is left as it is.")

    def load(self) -> None:
        db, name = self._current(), self.ask("Table: ").strip()
        found = self.catalog.load_csv(db, name, self.ask("CSV file: ").strip())
        for row in found.rejects.toLocalIterator():
            self.tell(f"Rejected: {row['line']} ({'; '.join(row['reasons'])})")
        self.tell(f"{self.catalog.table(db, name).count()} rows are in the table.")

    def query(self) -> None:
        db, name = self._current(), self.ask("Table: ").strip()
        show(self.catalog.select(db, name, self.ask("SELECT ... WHERE ...: ")), self.tell)

    def statistics(self) -> None:
        found = self.catalog.statistics(self._current(), self.ask("Table: ").strip())
        self.tell(f"{found.files} files, {found.bytes} bytes")


if __name__ == "__main__":
    Menu(Catalog(local(), sys.argv[1])).run()
