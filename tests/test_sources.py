"""CSV, catalog, console, menu and streams."""

import json
from datetime import date, datetime, time
from decimal import Decimal

import pytest

from quern.cli import Menu
from quern.operators import selection
from quern.sources.catalog import Catalog, CatalogError
from quern.sources.console import lines
from quern.sources.csv import read_csv
from quern.streaming.selection import append_to, for_each_batch, table_stream
from quern.types import Column, Constraints, Schema, parse_type

PEOPLE = Schema.of(("id", "INT"), ("name", "VARCHAR(10)"), ("ok", "BOOLEAN"))


def written(tmp_path, text, name="in.csv"):
    (tmp_path / name).write_text(text, newline="")
    return str(tmp_path / name)


def test_csv_rows_and_rejects(spark, tmp_path):
    path = written(tmp_path, "id,name,ok\n1,Ann,true\n\n   \n 2 , 'Bob' ,f\nx,Cid,1\n3,,0\n,Dan,t\n4,\"q,r\",t\n5,Eve\n6,elevenchars,t\n7,a\x01b,t\r\n8,last,F")
    found = read_csv(spark, path, PEOPLE)
    assert sorted(map(tuple, found.rows.collect())) == [(1, "Ann", True), (2, "Bob", False), (3, "", False), (7, "a\x01b", True), (8, "last", False)]
    bad = {r["line"]: r["reasons"] for r in found.rejects.collect()}
    assert set(bad) == {"x,Cid,1", ",Dan,t", '4,"q,r",t', "5,Eve", "6,elevenchars,t"}
    assert bad["x,Cid,1"] == ["id: not a INT: 'x'"] and bad["5,Eve"] == ["3 fields are expected; there are 2"]
    assert found.rows.schema["name"].metadata == {"sqlType": "VARCHAR(10)"}


def test_csv_null_spelling_and_edges(spark, tmp_path):
    path = written(tmp_path, "id,name,ok\n\\N,\\N,t\n")
    assert read_csv(spark, path, PEOPLE, null_value="\\N").rows.collect() == [(None, None, True)]
    assert read_csv(spark, written(tmp_path, "id,name,ok\n", "empty.csv"), PEOPLE).rows.count() == 0
    assert read_csv(spark, written(tmp_path, "", "nothing.csv"), PEOPLE).rows.count() == 0
    with pytest.raises(ValueError):
        read_csv(spark, path, Schema(()))


ALL = Schema.of(*{"a": "SMALLINT", "b": "INT", "c": "BIGINT", "d": "REAL", "e": "DOUBLE PRECISION", "f": "NUMERIC(10,2)", "g": "DECIMAL(8,3)", "h": "BOOL", "i": "CHAR(5)", "j": "CHARACTER(5)", "k": "VARCHAR(20)", "l": "DATE", "m": "TIME", "n": "BIT(6)", "o": "TIMESTAMP"}.items())


def test_every_type_through_a_table(spark, tmp_path):
    line = "-12,42,-9000000000,3.25,2.5,1234.56,12.34,true,ab,xy,text,2026-03-26,13:14:15.1,B'101011',2026-03-26 13:14:15.123456"
    catalog = Catalog(spark, str(tmp_path / "db"))
    catalog.create_database("shop")
    catalog.create_table("shop", "all", ALL)
    found = catalog.load_csv("shop", "all", written(tmp_path, "h\n" + line + "\n" + line.replace("42", "forty") + "\n"))
    assert found.rejects.count() == 1
    row = catalog.table("shop", "all").first()
    assert tuple(row) == (-12, 42, -9000000000, 3.25, 2.5, Decimal("1234.56"), Decimal("12.340"), True, "ab   ", "xy   ", "text", date(2026, 3, 26), time(13, 14, 15, 100000), "101011", datetime(2026, 3, 26, 13, 14, 15, 123456))
    shown = list(lines(catalog.table("shop", "all")))
    assert shown[0].startswith("a (SMALLINT) | b (INT) | c (BIGINT) | d (REAL) | e (DOUBLE PRECISION) | f (NUMERIC(10,2)) | g (DECIMAL(8,3)) | h (BOOLEAN) | i (CHAR(5))")
    assert shown[1] == "Tuple 1: a=-12 b=42 c=-9000000000 d=3.25 e=2.5 f=1234.56 g=12.340 h=true i='ab' j='xy' k='text' l=2026-03-26 m=13:14:15.100000 n=B'101011' o=2026-03-26 13:14:15.123456"
    for where in ("m > TIME '13:00:00'", "n = B'101011'", "o < '2026-03-27 00:00:00'", "i = 'ab'", "f = 1234.56", "l = '2026-03-26'", "h = TRUE", "d = 3.25"):
        assert catalog.select("shop", "all", where).count() == 1, where


def test_catalog_round_trip(spark, tmp_path):
    root = str(tmp_path / "db")
    catalog = Catalog(spark, root)
    catalog.create_database("shop")
    schema = Schema((Column("id", parse_type("INT"), False, Constraints(not_null=True, unique=True, check="id > 0", default="1")), Column("name", parse_type("VARCHAR(10)"))))
    assert catalog.create_table("shop", "users", schema) and not catalog.create_table("shop", "users", PEOPLE)
    again = Catalog(spark, root)
    assert again.show_databases() == ["shop"] and again.show_tables("shop") == ["users"] and again.schema("shop", "users") == schema
    assert again.table("shop", "users").count() == 0
    again.append("shop", "users", spark.createDataFrame([("a", 1), (None, None)], "name string, id int"))
    assert again.table("shop", "users").count() == 2 and again.statistics("shop", "users").bytes > 0
    with pytest.raises(CatalogError):
        again.append("shop", "users", spark.createDataFrame([("a",)], "name string"))
    for bad in (lambda: again.create_database("shop"), lambda: again.create_database(""), lambda: again.create_database("a/b"), lambda: again.create_table("none", "t", PEOPLE), lambda: again.table("shop", "none"), lambda: again.show_tables("none")):
        with pytest.raises(CatalogError):
            bad()


def test_a_broken_catalog_is_an_error(spark, tmp_path):
    root = tmp_path / "db"
    Catalog(spark, str(root))
    for text in ("{", "[]", json.dumps({"databases": {"a": {}}})):
        (root / ".catalog.json.crc").unlink(missing_ok=True)
        (root / "catalog.json").write_text(text)
        with pytest.raises(CatalogError):
            Catalog(spark, str(root))
        assert (root / "catalog.json").read_text() == text


def test_menu(spark, tmp_path):
    path = written(tmp_path, "id,name,ok\n1,Ann,true\n2,Bob,false\nx,Cid,true\n")
    answers = iter(["4", "2", "shop", "1", "3", "none", "3", "shop", "5", "people", "id:INT", "name", "name:TEXT", "name:VARCHAR(10)", "ok:BOOLEAN", "", "4", "6", "people", path, "7", "people", "SELECT * FROM people WHERE ok = TRUE", "7", "people", "SELECT * FROM people", "8", "people", "x", "9"])
    told = []
    Menu(Catalog(spark, str(tmp_path / "db")), lambda _: next(answers), told.append).run()
    assert "That failed: select a database first" in told and "- shop" in told and "- people" in told
    assert "Tuple 1: id=1 name='Ann' ok=true" in told and not any(t.startswith("Tuple 2") for t in told)
    assert "Rejected: x,Cid,true (id: not a INT: 'x')" in told and "2 rows are in the table." in told
    assert any("no WHERE" in t for t in told) and any(t.endswith(" bytes") for t in told)


def test_streams_select_what_batches_do(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(1000).selectExpr("cast(id as int) as v", "if(id % 3 = 0, null, cast(id % 5 as string)) as s").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    where = "v > 100 AND s IN ('1', '2')"
    expected = sorted(r["v"] for r in selection.select(df, where).collect())
    append_to(table_stream(spark, path, df.schema, files_per_trigger=1), where, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expected
    got = []
    for_each_batch(table_stream(spark, path, df.schema), where, lambda batch, n: got.extend(r["v"] for r in batch.collect()), str(tmp_path / "state2"), available_now=True).awaitTermination()
    assert sorted(got) == expected
    assert sorted(r["v"] for r in selection.iterate(df, where)) == expected


def test_a_save_that_is_cut_off(spark, tmp_path, monkeypatch):
    """The file is replaced in one step: a crash before it leaves the old catalog, and none is made over its folders."""
    from quern.sources import files

    root = str(tmp_path / "c")
    catalog = Catalog(spark, root)
    catalog.create_database("one")

    def crash(*_):
        raise OSError("power cut")

    monkeypatch.setattr(files, "rename_over", crash)
    with pytest.raises(OSError, match="power cut"):
        catalog.create_database("two")
    monkeypatch.undo()
    assert Catalog(spark, root).show_databases() == ["one"]
    Catalog(spark, root).create_database("three")
    assert Catalog(spark, root).show_databases() == ["one", "three"]
    (tmp_path / "c" / "catalog.json").unlink()
    with pytest.raises(CatalogError, match="not a place"):
        Catalog(spark, root)
