"""The connection API: connect, statements, result sets with a cursor, and their metadata."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.errors import BindError, ClosedError, EngineError
from larkspur.sources.engine import Engine, Transaction

PORT = 1099
#: Characters that values of a type take at most, but for an int's, where the usual ones count.
_WIDTHS = {"integer": 6, "boolean": 5, "byte": 4, "short": 6, "long": 20, "float": 15, "double": 24, "date": 10, "timestamp": 26, "timestamp_ntz": 26}


class MetaData(ABC):
    """Columns are numbered from 1."""

    @abstractmethod
    def column_count(self) -> int: ...

    @abstractmethod
    def column_name(self, i: int) -> str: ...

    @abstractmethod
    def column_type(self, i: int) -> str: ...

    @abstractmethod
    def column_display_size(self, i: int) -> int: ...


class ResultSet(ABC):
    @abstractmethod
    def next(self) -> bool: ...

    @abstractmethod
    def get_int(self, name: str) -> int: ...

    @abstractmethod
    def get_string(self, name: str) -> str: ...

    @abstractmethod
    def get(self, name: str) -> None | bool | int | float | str:
        """A value of any type: numbers, strings and null as they are, any other as text."""

    @abstractmethod
    def metadata(self) -> MetaData: ...

    @abstractmethod
    def close(self) -> None: ...


class Statement(ABC):
    @abstractmethod
    def execute_query(self, sql: str) -> ResultSet: ...

    @abstractmethod
    def execute_update(self, sql: str) -> int: ...


class Connection(ABC):
    @abstractmethod
    def create_statement(self) -> Statement: ...

    @abstractmethod
    def commit(self) -> None: ...

    @abstractmethod
    def rollback(self) -> None: ...

    @abstractmethod
    def close(self) -> None: ...

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class EmbeddedMetaData(MetaData):
    def __init__(self, df: DataFrame, lengths: dict[str, int]) -> None:
        self._fields, self._lengths = df.schema.fields, lengths

    def _field(self, i: int) -> T.StructField:
        if not 1 <= i <= len(self._fields):
            raise BindError(f"no column {i}")
        return self._fields[i - 1]

    def column_count(self) -> int:
        return len(self._fields)

    def column_name(self, i: int) -> str:
        return self._field(i).name

    def column_type(self, i: int) -> str:
        kind = self._field(i).dataType
        return "int" if isinstance(kind, T.IntegerType) else "varchar" if isinstance(kind, T.StringType) else kind.simpleString()

    def column_display_size(self, i: int) -> int:
        """One more than the wider of the name and the values."""
        f = self._field(i)
        width = _WIDTHS.get(f.dataType.typeName()) or self._lengths.get(f.name, 20)
        return max(len(f.name), width) + 1


class EmbeddedResultSet(ResultSet):
    """A cursor over the rows as Spark's partitions deliver them; the driver holds a partition at most."""

    def __init__(self, connection: EmbeddedConnection, df: DataFrame) -> None:
        self._connection, self._df = connection, df
        self._rows, self._row, self._closed = df.toLocalIterator(prefetchPartitions=True), None, False
        self._at = {}
        for i, name in enumerate(df.columns):
            self._at.setdefault(name.lower(), i)

    def next(self) -> bool:
        if self._closed:
            raise ClosedError("the result set is closed")
        self._row = next(self._rows, None)
        return self._row is not None

    def _value(self, name: str):
        if self._closed or self._row is None:
            raise ClosedError("no current row")
        if name.lower() not in self._at:
            raise BindError(f"unknown column {name}")
        return self._row[self._at[name.lower()]]

    def get_int(self, name: str) -> int:
        value = self._value(name)
        if isinstance(value, bool) or not isinstance(value, int):
            raise BindError(f"{name} is not an int")
        return value

    def get_string(self, name: str) -> str:
        value = self._value(name)
        if not isinstance(value, str):
            raise BindError(f"{name} is not a string")
        return value

    def get(self, name: str) -> None | bool | int | float | str:
        value = self._value(name)
        if value is None or isinstance(value, (bool, int, float, str)):
            return value
        return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)

    def metadata(self) -> EmbeddedMetaData:
        lengths: dict[str, int] = {}
        for t in self._connection.tx.state.tables.values():
            for name, n in t.lengths.items():
                lengths[name] = max(n, lengths.get(name, 0))
        return EmbeddedMetaData(self._df, lengths)

    def close(self) -> None:
        """Also commits, as statements autocommit."""
        if not self._closed:
            self._closed = True
            self._connection.commit()


class EmbeddedStatement(Statement):
    def __init__(self, connection: EmbeddedConnection) -> None:
        self._connection = connection

    def query_df(self, sql: str) -> DataFrame:
        """The query as a DataFrame, for use in Spark programs."""
        return self._connection.transaction().query(sql)

    def execute_query(self, sql: str) -> EmbeddedResultSet:
        try:
            return EmbeddedResultSet(self._connection, self.query_df(sql))
        except EngineError:
            self._connection.rollback()
            raise

    def execute_update(self, sql: str) -> int:
        """Commits at once; an error rolls back."""
        try:
            changed = self._connection.transaction().execute(sql)
        except Exception:
            self._connection.rollback()
            raise
        self._connection.commit()
        return changed


class EmbeddedConnection(Connection):
    def __init__(self, engine: Engine) -> None:
        self.engine, self._closed = engine, False
        self.tx: Transaction = engine.begin()

    def transaction(self) -> Transaction:
        if self._closed:
            raise ClosedError("the connection is closed")
        if self.tx.over:
            self.tx = self.engine.begin()
        return self.tx

    def create_statement(self) -> EmbeddedStatement:
        self.transaction()
        return EmbeddedStatement(self)

    def commit(self) -> None:
        if not self.tx.over:
            self.tx.commit()
        if not self._closed:
            self.tx = self.engine.begin()

    def rollback(self) -> None:
        if not self.tx.over:
            self.tx.rollback()
        if not self._closed:
            self.tx = self.engine.begin()

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self.commit()


def connect(url: str, spark: SparkSession | None = None) -> Connection:
    """`...//host[:port]` connects to a server; else the part behind the last colon names a database folder."""
    if "//" in url:
        from larkspur.client.network import NetworkConnection

        host, _, port = url.rpartition("//")[2].rstrip("/").partition(":")
        return NetworkConnection(host or "localhost", int(port or PORT))
    return EmbeddedConnection(Engine(spark or SparkSession.builder.getOrCreate(), url.rpartition(":")[2]))
