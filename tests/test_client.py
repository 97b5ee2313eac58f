import io

import pytest

from larkspur.client.api import connect
from larkspur.client.cli import run
from larkspur.client.network import Server
from larkspur.errors import BindError, ClosedError, EngineError, TransportError
from larkspur.sources.engine import Engine
from tests.fixtures import fill


@pytest.fixture
def folder(spark, tmp_path):
    fill(Engine(spark, str(tmp_path / "db")))
    return str(tmp_path / "db")


def used(connection):
    statement = connection.create_statement()
    result = statement.execute_query("select SName, GradYear from student where majorid = 10")
    meta = result.metadata()
    assert [(meta.column_name(i), meta.column_type(i), meta.column_display_size(i)) for i in (1, 2)] == [("sname", "varchar", 11), ("gradyear", "int", 9)]
    assert meta.column_count() == 2
    found = []
    while result.next():
        found.append((result.get_string("SNAME"), result.get_int("gradyear")))
    assert not result.next()
    assert sorted(found) == [("joe", 2021), ("lee", 2021), ("max", 2022)]
    result.close()
    assert statement.execute_update("update student set gradyear = 1 where majorid = 20") == 4
    assert statement.execute_update("create table x (a int)") == 0
    with pytest.raises(EngineError):
        statement.execute_query("select nope from student")
    with pytest.raises(EngineError):
        statement.execute_update("insert into")
    assert statement.execute_update("delete from student where majorid = 30") == 2
    connection.commit()
    connection.rollback()


def test_embedded(spark, folder):
    with connect(f"larkspur:{folder}", spark) as connection:
        used(connection)
        result = connection.create_statement().execute_query("select sid from student")
        with pytest.raises(ClosedError):
            result.get_int("sid")
        result.next()
        with pytest.raises(BindError):
            result.get_string("sid")
    with pytest.raises(ClosedError):
        connection.create_statement()


def test_network(spark, folder):
    server = Server(Engine(spark, folder), port=0).start()
    with connect(f"larkspur://localhost:{server.port}") as one, connect(f"larkspur://localhost:{server.port}") as two:
        used(one)
        a = two.create_statement().execute_query("select sid from student")
        b = two.create_statement().execute_query("select did from dept")
        assert a.next() and b.next()
        a.close()
        c = two.create_statement().execute_query("select did from dept")
        assert c.next() and b.next()
    server.close()
    with pytest.raises(TransportError):
        connect(f"larkspur://localhost:{server.port}")


def test_command_line(spark, folder):
    out = io.StringIO()
    lines = io.StringIO("SELECT sname, gradyear from student where sid = 1\nselect nope from student\nupdate student set gradyear = 5 where sid = 1\n\nexit\nnot reached\n")
    run(connect(f"larkspur:{folder}", spark), lines, out)
    text = out.getvalue()
    assert "      sname gradyear\n--------------------\n        joe     2021\n" in text
    assert "error: unknown column nope" in text and "1 records processed" in text and "reached" not in text


def test_values_of_all_types(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.sql("select 9007199254740993L as l, 1.5D as d, timestamp'2020-01-02 03:04:05' as t, date'2020-01-02' as day, cast(null as string) as s, 12.30BD as n, true as b, x'00ff' as raw").write.parquet(path)
    engine = Engine(spark, str(tmp_path / "db"))
    engine.attach("x", path)
    expected = {"l": 9007199254740993, "d": 1.5, "t": "2020-01-02 03:04:05", "day": "2020-01-02", "s": None, "n": "12.30", "b": True, "raw": "00ff"}
    query = "select l, d, t, day, s, n, b, raw from x"
    server = Server(engine, port=0).start()
    for url in (f"larkspur:{tmp_path / 'db'}", f"larkspur://localhost:{server.port}"):
        with connect(url, spark) as connection:
            result = connection.create_statement().execute_query(query)
            assert result.next() and {n: result.get(n) for n in expected} == expected
            with pytest.raises(BindError):
                result.get_int("d")
            with pytest.raises(BindError):
                result.get_string("s")
            result.close()
            out = io.StringIO()
            run(connection, io.StringIO(query + "\nexit\n"), out)
            line = out.getvalue().splitlines()[2]
            assert line.split() == ["9007199254740993", "1.5", "2020-01-02", "03:04:05", "2020-01-02", "null", "12.30", "True", "00ff"]
    server.close()
