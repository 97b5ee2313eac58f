"""Server and client over TCP: one JSON object per line and call. Every client has a session of its own."""

from __future__ import annotations

import itertools
import json
import socket
import socketserver
import threading

from larkspur import errors
from larkspur.client.api import PORT, Connection, EmbeddedConnection, EmbeddedResultSet, EmbeddedStatement, MetaData, ResultSet, Statement
from larkspur.errors import EngineError, TransportError
from larkspur.sources.engine import Engine


class _Session:
    """One client's connection with its statements and result sets, under numbers that are never reused."""

    def __init__(self, engine: Engine) -> None:
        self.connection = EmbeddedConnection(engine)
        self.numbers = itertools.count(1)
        self.statements: dict[int, EmbeddedStatement] = {}
        self.results: dict[int, EmbeddedResultSet] = {}

    def call(self, name: str, of: int | None, args: list):
        match name:
            case "connection.close":
                return self.connection.close()
            case "connection.commit":
                return self.connection.commit()
            case "connection.rollback":
                return self.connection.rollback()
            case "connection.create_statement":
                return self._keep(self.statements, self.connection.create_statement())
            case "statement.execute_query":
                return self._keep(self.results, self.statements[of].execute_query(*args))
            case "statement.execute_update":
                return self.statements[of].execute_update(*args)
            case "result.next" | "result.get_int" | "result.get_string" | "result.get":
                return getattr(self.results[of], name.partition(".")[2])(*args)
            case "result.close":
                return self.results.pop(of).close()
            case "metadata.column_count" | "metadata.column_name" | "metadata.column_type" | "metadata.column_display_size":
                return getattr(self.results[of].metadata(), name.partition(".")[2])(*args)
        raise TransportError(f"unknown call {name}")

    def _keep(self, where: dict, what) -> int:
        number = next(self.numbers)
        where[number] = what
        return number


class Server:
    """Serves one database folder until it is closed."""

    def __init__(self, engine: Engine, host: str = "localhost", port: int = PORT) -> None:
        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                session = _Session(engine)
                try:
                    for line in self.rfile:
                        self.wfile.write(_answer(session, line) + b"\n")
                finally:
                    if not session.connection.tx.over:
                        session.connection.tx.rollback()

        class Threads(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self._server = Threads((host, port), Handler)
        self.port = self._server.server_address[1]
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def start(self) -> Server:
        self._thread.start()
        return self

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()

    def wait(self) -> None:
        self._thread.join()


def _answer(session: _Session, line: bytes) -> bytes:
    try:
        x = json.loads(line)
        return json.dumps({"value": session.call(x["call"], x.get("of"), x.get("args", []))}).encode()
    except EngineError as e:
        return json.dumps({"error": type(e).__name__, "message": str(e)}).encode()
    except Exception as e:  # the session outlives a failed statement
        return json.dumps({"error": "EngineError", "message": f"{type(e).__name__}: {str(e)[:500]}"}).encode()


class NetworkMetaData(MetaData):
    def __init__(self, connection: NetworkConnection, number: int) -> None:
        self._call = lambda name, *args: connection.call(f"metadata.{name}", number, *args)

    def column_count(self) -> int:
        return self._call("column_count")

    def column_name(self, i: int) -> str:
        return self._call("column_name", i)

    def column_type(self, i: int) -> str:
        return self._call("column_type", i)

    def column_display_size(self, i: int) -> int:
        return self._call("column_display_size", i)


class NetworkResultSet(ResultSet):
    def __init__(self, connection: NetworkConnection, number: int) -> None:
        self._connection, self._number = connection, number

    def next(self) -> bool:
        return self._connection.call("result.next", self._number)

    def get_int(self, name: str) -> int:
        return self._connection.call("result.get_int", self._number, name)

    def get_string(self, name: str) -> str:
        return self._connection.call("result.get_string", self._number, name)

    def get(self, name: str) -> None | bool | int | float | str:
        return self._connection.call("result.get", self._number, name)

    def metadata(self) -> NetworkMetaData:
        return NetworkMetaData(self._connection, self._number)

    def close(self) -> None:
        self._connection.call("result.close", self._number)


class NetworkStatement(Statement):
    def __init__(self, connection: NetworkConnection, number: int) -> None:
        self._connection, self._number = connection, number

    def execute_query(self, sql: str) -> NetworkResultSet:
        return NetworkResultSet(self._connection, self._connection.call("statement.execute_query", self._number, sql))

    def execute_update(self, sql: str) -> int:
        return self._connection.call("statement.execute_update", self._number, sql)


class NetworkConnection(Connection):
    def __init__(self, host: str, port: int = PORT) -> None:
        try:
            self._socket = socket.create_connection((host, port))
        except OSError as e:
            raise TransportError(f"cannot connect to {host}:{port}: {e}") from e
        self._lines = self._socket.makefile("rwb")

    def call(self, name: str, of: int | None = None, *args):
        try:
            self._lines.write(json.dumps({"call": name, "of": of, "args": args}).encode() + b"\n")
            self._lines.flush()
            answer = json.loads(self._lines.readline())
        except (OSError, ValueError) as e:
            raise TransportError(f"the server does not answer: {e}") from e
        if "error" in answer:
            kind = getattr(errors, answer["error"], EngineError)
            raise (EngineError if kind is errors.SyntaxProblem else kind)(answer["message"])
        return answer["value"]

    def create_statement(self) -> NetworkStatement:
        return NetworkStatement(self, self.call("connection.create_statement"))

    def commit(self) -> None:
        self.call("connection.commit")

    def rollback(self) -> None:
        self.call("connection.rollback")

    def close(self) -> None:
        self.call("connection.close")
        self._lines.close()
        self._socket.close()
