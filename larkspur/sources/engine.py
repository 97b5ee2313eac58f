"""The engine: transactions over a database folder.

Reads bind to the files of the snapshot that the transaction began with. Writes are copy-on-write per
data file: a delete or update finds the files that hold matching rows (the predicate is pushed to the
scan), rewrites only those into new files, and leaves the rest. Inserts are buffered and flushed as
one file. Nothing of this is seen by others until commit replaces the manifest.

One transaction writes at a time, under a lock file; it fails if somebody committed since it began. The lock is
a lease that its writer renews, so a writer that dies holds it for `lease_seconds` at most; what it has left is
neither in the manifest nor in anybody's way, and `sweep` deletes it. The lock and the manifest need a file system whose
create and rename are atomic (local, NFS, HDFS); on an object store use one writer.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
import weakref
from dataclasses import replace
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import BindError, CatalogError, ClosedError, TransactionError
from larkspur.operators.relation import Relation
from larkspur.plans.binder import Scope, bind, estimated_bytes, fields_of
from larkspur.plans.cost import Estimate
from larkspur.plans.parser import parse_command, parse_query
from larkspur.plans.syntax import Command, Const, CreateIndex, CreateTable, CreateView, Delete, Field, Insert, Select, Update
from larkspur.sources.catalog import SYSTEM, IndexDef, Manifest, TableDef, schema_of
from larkspur.sources.files import Files

MANIFEST, LOCK = "manifest.json", "writer.lock"
#: A table of more small insert files than this has them rewritten at commit, into files of about FILE_BYTES.
MOST_INSERT_FILES = 32
FILE_BYTES = 128 << 20


class Engine:
    """A database folder on a file system that Spark reads and whose renames are atomic."""

    _in_process = threading.Lock()

    def __init__(self, spark: SparkSession, folder: str, lock_seconds: float = 10.0, lease_seconds: float = 60.0, file_bytes: int = FILE_BYTES) -> None:
        self.spark, self.lock_seconds, self.lease_seconds, self.file_bytes = spark, lock_seconds, lease_seconds, file_bytes
        self.files = Files(spark, folder)
        self.files.make_folder()
        with Engine._in_process:
            if not self.files.exists(MANIFEST):
                self.files.replace(MANIFEST, Manifest().to_json())

    def manifest(self) -> Manifest:
        return Manifest.from_json(self.files.read(MANIFEST))

    def begin(self) -> Transaction:
        return Transaction(self)

    def attach(self, name: str, path: str) -> None:
        """Add existing Parquet data as a table; its files are read, never changed or deleted."""
        with self.begin() as tx:
            tx.attach(name, path)

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of a SELECT over the last committed state."""
        return self.begin().query(sql)

    def execute(self, sql: str) -> int:
        """Run one command in a transaction of its own; the number of rows that it changed."""
        with self.begin() as tx:
            return tx.execute(sql)

    def scan(self, name: str) -> Relation:
        return self.begin().scan(name)

    def load(self, name: str, df: DataFrame) -> None:
        """Append the rows of a DataFrame to a table."""
        with self.begin() as tx:
            tx.load(name, df)

    def sweep(self) -> list[str]:
        """Delete data folders that no table refers to (left by crashes); not while others write or read old states."""
        used = {f.rpartition("/")[0].rpartition("/")[2] for t in self.manifest().tables.values() for f in t.files}
        orphans = [d for d in self.files.children("data") if d not in used]
        for d in orphans:
            self.files.delete(f"data/{d}")
        return orphans

    def lock(self) -> str:
        """The owner's name in the lock file; waits up to `lock_seconds`, and takes over a lease that has run out."""
        owner, until = uuid.uuid4().hex, time.monotonic() + self.lock_seconds
        while True:
            with Engine._in_process:
                if self.files.create(LOCK, self._lease(owner)):
                    return owner
                held = self._held()
                if held is not None and held["until"] < time.time():
                    # Only one of several that see it moves the file away.
                    stale = f"{LOCK}.{owner}"
                    if self.files.move(LOCK, stale):
                        self.files.delete(stale)
                    continue
            if time.monotonic() >= until:
                raise TransactionError("another transaction is writing")
            time.sleep(0.05)

    def _lease(self, owner: str) -> str:
        return json.dumps({"owner": owner, "until": time.time() + self.lease_seconds})

    def _held(self) -> dict | None:
        """Owner and end of the lease, if there is a lock; one that is being written has not run out."""
        try:
            return json.loads(self.files.read(LOCK)) if self.files.exists(LOCK) else None
        except (ValueError, Py4JError):
            return None

    def holds(self, owner: str) -> bool:
        held = self._held()
        return held is not None and held["owner"] == owner

    def renew(self, owner: str) -> bool:
        with Engine._in_process:
            if not self.holds(owner):
                return False
            self.files.replace(LOCK, self._lease(owner))
            return True

    def unlock(self, owner: str) -> None:
        """Give up a lock, if it still is the owner's."""
        with Engine._in_process:
            if self.holds(owner):
                self.files.delete(LOCK)


def _renewing(engine: Engine, owner: str, over: threading.Event, transaction: weakref.ref) -> None:
    """Keeps a lease alive while its transaction lives."""
    while not over.wait(engine.lease_seconds / 3):
        if transaction() is None or not engine.renew(owner):
            return


class Transaction:
    """Use as a context manager: commits at the end, rolls back on an error."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.spark = engine, engine.spark
        self.state = self.base = engine.manifest()
        self.pending: dict[str, list[tuple]] = {}
        self.inserted: dict[str, int] = {}
        self.written: list[str] = []
        self.owner: str | None = None
        self.over, self._done = False, threading.Event()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self.over:
            self.rollback() if kind else self.commit()

    # Reading

    def _parquet(self, definition: TableDef) -> DataFrame:
        if not definition.files:
            return self.spark.createDataFrame([], definition.struct)
        return self.spark.read.schema(definition.struct).parquet(*definition.files)

    def table(self, name: str) -> DataFrame | None:
        self._alive()
        if name in SYSTEM:
            return self.spark.createDataFrame(self.state.system_rows(name), schema_of(SYSTEM[name]))
        if name not in self.state.tables:
            return None
        self._flush(name)
        return self._parquet(self.state.tables[name])

    def view(self, name: str) -> Select | None:
        return parse_query(self.state.views[name]) if name in self.state.views else None

    def bound(self, query: Select) -> DataFrame:
        return bind(query, self.table, self.view)

    def query(self, sql: str) -> DataFrame:
        return self.bound(parse_query(sql))

    def scan(self, name: str) -> Relation:
        """A table or view as the start of an operator chain."""
        df = self.table(name)
        if df is None:
            definition = self.view(name)
            if definition is None:
                raise BindError(f"unknown table {name}")
            df = bind(definition, self.table, self.view, (name,))
        return Relation(df)

    def estimate(self, name: str) -> Estimate:
        """Cost report of a stored table; records are counted from the Parquet footers."""
        if name in SYSTEM:
            lengths, records = {c.name: c.length for c in SYSTEM[name]}, len(self.state.system_rows(name))
        else:
            definition = self._known(name)
            lengths = {f.name: None if isinstance(f.dataType, T.IntegerType) else definition.lengths.get(f.name, 4) for f in definition.struct.fields}
            records = self.table(name).count()
        return Estimate.table(records, lengths)

    def indexes_of(self, name: str) -> dict[str, str]:
        """field -> index name"""
        return {i.field: n for n, i in self.state.indexes.items() if i.table == name}

    # Writing

    def execute(self, sql: str) -> int:
        return self.apply(parse_command(sql))

    def apply(self, c: Command) -> int:
        self._alive()
        self._write_lock()
        match c:
            case Insert():
                return self._insert(c)
            case Delete():
                return self._rewrite(c.table, c.terms, None)
            case Update():
                return self._rewrite(c.table, c.terms, c)
            case CreateTable():
                self._fresh(c.table)
                names = [x.name for x in c.columns]
                if len(set(names)) < len(names):
                    raise CatalogError(f"table {c.table} has a column twice")
                self.state = self.state.with_table(c.table, TableDef(schema_of(list(c.columns)).json(), {x.name: x.length for x in c.columns if x.length is not None}))
            case CreateView():
                self._fresh(c.view)
                if c.view in c.query.tables:
                    raise CatalogError(f"view {c.view} refers to itself")
                self.bound(c.query)  # its tables and columns must exist
                self.state = replace(self.state, views={**self.state.views, c.view: str(c.query)})
            case CreateIndex():
                if c.index in self.state.indexes:
                    raise CatalogError(f"index {c.index} exists")
                Scope.of(self.spark.createDataFrame([], self._known(c.table).struct)).lookup(c.field)
                self.state = replace(self.state, indexes={**self.state.indexes, c.index: IndexDef(c.table, c.field)})
                self._flush(c.table)
                own = self._owned(c.table)
                if own:  # rows that are there already get the index's layout; results stay the same
                    rest = tuple(f for f in self.state.tables[c.table].files if f not in own)
                    self._put(c.table, self._parquet(replace(self.state.tables[c.table], files=tuple(own))), rest)
        return 0

    def attach(self, name: str, path: str) -> None:
        self._alive()
        self._write_lock()
        self._fresh(name)
        df = self.spark.read.parquet(path)
        files = tuple(self.engine.files.listed(path))
        if not files:
            raise CatalogError(f"{path} has no Parquet files of its own")
        self.state = self.state.with_table(name, TableDef(df.schema.json(), {}, files))

    def commit(self) -> None:
        self._alive()
        try:
            for name in list(self.pending):
                self._flush(name)
            if self.state is not self.base:
                for name in self.state.tables:
                    small = [f for f in self.state.tables[name].files if "/insert-" in f]
                    if len(small) > MOST_INSERT_FILES:
                        rest = tuple(f for f in self.state.tables[name].files if f not in small)
                        inserted = self._parquet(replace(self.state.tables[name], files=tuple(small)))
                        self._put(name, inserted.coalesce(self._files_for(inserted)), rest)
                if self.owner is not None and not self.engine.holds(self.owner):
                    raise TransactionError("the lease of this transaction has run out and another one has taken over")
                self.engine.files.replace(MANIFEST, replace(self.state, version=self.base.version + 1).to_json())
                self.written = []
        finally:
            self._end()

    def rollback(self) -> None:
        self._alive()
        self._end()

    def _end(self) -> None:
        self.over = True
        self._done.set()
        for folder in self.written:
            self.engine.files.delete(folder)
        if self.owner is not None:
            self.engine.unlock(self.owner)
            self.owner = None

    def _alive(self) -> None:
        if self.over:
            raise ClosedError("the transaction is over")

    def _write_lock(self) -> None:
        if self.owner is not None:
            return
        self.owner = self.engine.lock()
        threading.Thread(target=_renewing, args=(self.engine, self.owner, self._done, weakref.ref(self)), daemon=True).start()
        if self.engine.manifest().version != self.base.version:
            self._end()
            raise TransactionError("another transaction has committed since this one began")

    def _known(self, name: str) -> TableDef:
        if name in SYSTEM:
            raise BindError(f"{name} is a catalog table")
        if name not in self.state.tables:
            raise BindError(f"unknown table {name}")
        return self.state.tables[name]

    def _fresh(self, name: str) -> None:
        if name in self.state.tables or name in self.state.views or name in SYSTEM:
            raise CatalogError(f"{name} exists")

    def _checked(self, definition: TableDef, field: str, value: int | str) -> int | str:
        kind = Scope.of(self.spark.createDataFrame([], definition.struct)).lookup(field)[1]
        if isinstance(value, int) != isinstance(kind, T.NumericType):
            raise BindError(f"{value!r} does not fit column {field}")
        length = definition.lengths.get(field)
        if length is not None and len(value.encode()) > length:
            raise BindError(f"value for {field} is longer than varchar({length})")
        return float(value) if isinstance(kind, T.FractionalType) else value

    def _insert(self, c: Insert) -> int:
        definition = self._known(c.table)
        if len(c.fields) != len(c.values):
            raise BindError(f"{len(c.fields)} columns but {len(c.values)} values")
        if len(set(c.fields)) < len(c.fields):
            raise BindError("a column is listed twice")
        given = {f: self._checked(definition, f, v.value) for f, v in zip(c.fields, c.values)}
        row = tuple(given.get(f.name, "" if isinstance(f.dataType, T.StringType) else 0 if isinstance(f.dataType, T.NumericType) else None) for f in definition.struct.fields)
        self.pending.setdefault(c.table, []).append(row)
        return 1

    def _flush(self, name: str) -> None:
        rows = self.pending.pop(name, None)
        if rows:
            definition = self.state.tables[name]
            self._put(name, self.spark.createDataFrame(rows, definition.struct).coalesce(1), definition.files, "insert")

    def load(self, name: str, df: DataFrame) -> None:
        """Append the rows of a DataFrame that has the table's columns; lengths of varchars are enforced."""
        self._alive()
        self._write_lock()
        definition = self._known(name)
        self._flush(name)
        columns = []
        for f in definition.struct.fields:
            value, length = F.col(f"`{Scope.of(df).lookup(f.name)[0]}`").cast(f.dataType), definition.lengths.get(f.name)
            if length is not None:
                value = F.when(F.octet_length(value) > length, F.raise_error(F.lit(f"value for {f.name} is longer than varchar({length})"))).otherwise(value)
            columns.append(value.alias(f.name))
        self._put(name, df.select(*columns), definition.files)

    def _files_for(self, df: DataFrame) -> int:
        return max(1, math.ceil(estimated_bytes(df) / self.engine.file_bytes))

    def _put(self, name: str, df: DataFrame, rest: tuple[str, ...], kind: str = "write") -> None:
        """Write rows into new files of the table, beside the files `rest`.

        Where the table has indexes, files are ranges of the first one's field and sorted by all, so that a lookup
        skips whole files and row groups by their statistics and bloom filters.
        """
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        self.written.append(folder)
        indexed = sorted(self.indexes_of(name))
        if indexed and kind != "insert":
            df = df.repartitionByRange(self._files_for(df), indexed[0])
        writer = (df.sortWithinPartitions(*indexed) if indexed else df).write
        for f in indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
        path = self.engine.files.at(folder)
        writer.parquet(path)
        self.state = self.state.with_table(name, replace(self.state.tables[name], files=(*rest, *self.engine.files.listed(path))))

    def _owned(self, name: str) -> list[str]:
        return [f for f in self.state.tables[name].files if f.startswith(self.engine.files.root)]

    def _rewrite(self, name: str, terms: tuple, update: Update | None) -> int:
        self._flush(name) if name in self.state.tables else None
        definition = self._known(name)
        df = self._parquet(definition)
        scope = Scope.of(df)
        for f in fields_of(terms):
            scope.lookup(f)
        matches = F.coalesce(scope.predicate(terms), F.lit(False))
        if update is not None:
            target = scope.lookup(update.field)[0]
            if isinstance(update.value, Const):
                value = F.lit(self._checked(definition, target, update.value.value))
            else:
                self._same_kind(scope, update.value, target)
                value = scope.column(update.value.name)
        if not definition.files:
            return 0
        # The counting pass reads the predicate's columns only; one row per touched file comes back.
        touched = {r[0]: r[1] for r in df.filter(matches).groupBy(F.col("_metadata.file_path")).count().collect()}
        if not touched:
            return 0
        # Paths in the metadata column are percent-encoded, names of files are not.
        by_path = {f.partition(":")[2].lstrip("/"): f for f in definition.files}
        hit = tuple(by_path[unquote(p.partition(":")[2].lstrip("/"))] for p in touched)
        rest = tuple(f for f in definition.files if f not in set(hit))
        old = self._parquet(replace(definition, files=hit))
        if update is None:
            new = old.filter(~matches)
        else:
            cast = value.cast(definition.struct[target].dataType)
            length = definition.lengths.get(target)
            if length is not None and isinstance(update.value, Field):
                cast = F.when(F.octet_length(cast) <= length, cast).otherwise(F.raise_error(F.lit(f"value for {target} is longer than varchar({length})")))
            new = old.withColumn(target, F.when(matches, cast).otherwise(F.col(f"`{target}`")))
        self._put(name, new, rest)
        return sum(touched.values())

    @staticmethod
    def _same_kind(scope: Scope, value: Field, target: str) -> None:
        if scope.operand(value)[1] != scope.operand(Field(target))[1]:
            raise BindError(f"{value} does not fit column {target}")


def database(spark: SparkSession, folder: str, tables: dict[str, str] | None = None) -> Engine:
    """An engine over `folder`, with Parquet paths attached under the given names."""
    engine = Engine(spark, folder)
    known = engine.manifest().tables
    for name, path in (tables or {}).items():
        if name not in known:
            engine.attach(name, path)
    return engine


