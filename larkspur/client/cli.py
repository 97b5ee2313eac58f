"""Command line: `python -m larkspur.client.cli URL` reads statements, `exit` leaves; `--serve FOLDER` serves one."""

from __future__ import annotations

import sys
from typing import TextIO

from larkspur.client.api import PORT, Connection, connect
from larkspur.errors import EngineError


def show(connection: Connection, sql: str, out: TextIO) -> None:
    """Print the rows of a query as a table."""
    result = connection.create_statement().execute_query(sql)
    meta = result.metadata()
    columns = range(1, meta.column_count() + 1)
    names, widths = ([f(i) for i in columns] for f in (meta.column_name, meta.column_display_size))
    out.write("".join(n.rjust(w) for n, w in zip(names, widths)) + "\n")
    out.write("-" * sum(widths) + "\n")
    while result.next():
        values = (result.get(n) for n in names)
        out.write("".join(("null" if v is None else str(v)).rjust(w) for v, w in zip(values, widths)) + "\n")
    result.close()


def run(connection: Connection, lines: TextIO, out: TextIO) -> None:
    """Statements line by line; errors are printed and do not end the session."""
    out.write("SQL> ")
    out.flush()
    for line in lines:
        sql = line.strip()
        word = sql.partition(" ")[0].lower()
        if word == "exit":
            break
        try:
            if word == "select":
                show(connection, sql, out)
            elif sql:
                out.write(f"{connection.create_statement().execute_update(sql)} records processed\n")
        except EngineError as e:
            out.write(f"error: {e}\n")
        out.write("SQL> ")
        out.flush()
    out.write("\n")


def main(args: list[str]) -> None:
    if args[:1] == ["--serve"]:
        from pyspark.sql import SparkSession

        from larkspur.client.network import Server
        from larkspur.sources.engine import Engine

        folder, port = args[1] if len(args) > 1 else "larkspur-data", int(args[2]) if len(args) > 2 else PORT
        Server(Engine(SparkSession.builder.getOrCreate(), folder), port=port).start().wait()
    else:
        with connect(args[0] if args else input("Connect> ")) as connection:
            run(connection, sys.stdin, sys.stdout)


if __name__ == "__main__":
    main(sys.argv[1:])
