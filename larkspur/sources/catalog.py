"""The catalog: one immutable manifest per committed state.

A manifest lists tables with their schema and data files, views and indexes. Committing is replacing
the manifest file; data files are never changed, so a reader keeps the state it began with.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from larkspur.plans.cost import slot_bytes
from larkspur.plans.syntax import ColumnDef

#: Type codes in the catalog tables (fixed values; the usual SQL type numbers).
INT, VARCHAR = 4, 12
OTHER_CODES = {"bigint": -5, "double": 8, "float": 6, "boolean": 16, "date": 91, "timestamp": 93, "timestamp_ntz": 93, "binary": -2, "smallint": 5, "tinyint": -6}
NAME, DEFINITION = 16, 100
#: The catalog's own tables, which are tables like any other.
SYSTEM: dict[str, list[ColumnDef]] = {
    "tblcat": [ColumnDef("tblname", NAME), ColumnDef("slotsize")],
    "fldcat": [ColumnDef("tblname", NAME), ColumnDef("fldname", NAME), ColumnDef("type"), ColumnDef("length"), ColumnDef("offset")],
    "viewcat": [ColumnDef("viewname", NAME), ColumnDef("viewdef", DEFINITION)],
    "idxcat": [ColumnDef("indexname", NAME), ColumnDef("tablename", NAME), ColumnDef("fieldname", NAME)],
}


def spark_type(c: ColumnDef) -> T.DataType:
    return T.IntegerType() if c.length is None else T.StringType()


def schema_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c)) for c in columns])


@dataclass(frozen=True)
class TableDef:
    """`lengths` has an entry for each declared varchar; attached tables declare none."""

    schema: str
    lengths: dict[str, int]
    files: tuple[str, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def layout(self) -> list[tuple[str, int, int, int]]:
        """(field, type code, length, offset in a classical record) of each column."""
        found, at = [], 4
        for f in self.struct.fields:
            code = INT if isinstance(f.dataType, T.IntegerType) else VARCHAR if isinstance(f.dataType, T.StringType) else OTHER_CODES.get(f.dataType.simpleString(), 2000)
            length = self.lengths.get(f.name, 0)
            found.append((f.name, code, length, at))
            at += 4 + length if code == VARCHAR else 4 if code == INT else 8
        return found

    def slot(self) -> int:
        layout = self.layout()
        if all(code in (INT, VARCHAR) for _, code, _, _ in layout):
            return slot_bytes([None if code == INT else length for _, code, length, _ in layout])
        name, code, length, at = layout[-1]
        return at + (4 + length if code == VARCHAR else 4 if code == INT else 8)


@dataclass(frozen=True)
class IndexDef:
    table: str
    field: str


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    tables: dict[str, TableDef] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, IndexDef] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        x = json.loads(text)
        tables = {k: TableDef(v["schema"], v["lengths"], tuple(v["files"])) for k, v in x["tables"].items()}
        return cls(x["version"], tables, x["views"], {k: IndexDef(**v) for k, v in x["indexes"].items()})

    def with_table(self, name: str, definition: TableDef) -> Manifest:
        return replace(self, tables={**self.tables, name: definition})

    def system_rows(self, name: str) -> list[tuple]:
        """Rows of a catalog table; the catalog's tables list themselves."""
        own = {n: TableDef(schema_of(c).json(), {x.name: x.length for x in c if x.length is not None}) for n, c in SYSTEM.items()}
        tables = {**own, **self.tables}
        if name == "tblcat":
            return [(n, t.slot()) for n, t in tables.items()]
        if name == "fldcat":
            return [(n, *row) for n, t in tables.items() for row in t.layout()]
        if name == "viewcat":
            return list(self.views.items())
        return [(n, i.table, i.field) for n, i in self.indexes.items()]
