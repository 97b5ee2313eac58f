"""Syntax tree of the dialect. Every node prints itself as text that parses to the same node."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Const:
    value: int | str

    def __str__(self) -> str:
        if isinstance(self.value, int):
            return str(self.value)
        quote = '"' if "'" in self.value else "'"  # a literal never holds its own delimiter
        return f"{quote}{self.value}{quote}"


@dataclass(frozen=True)
class Field:
    name: str

    def __str__(self) -> str:
        return self.name


Operand = Const | Field


@dataclass(frozen=True)
class Term:
    left: Operand
    right: Operand

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


def where_text(terms: tuple[Term, ...]) -> str:
    return " where " + " and ".join(map(str, terms)) if terms else ""


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]
    tables: tuple[str, ...]
    terms: tuple[Term, ...] = ()

    def __str__(self) -> str:
        return f"select {', '.join(self.fields)} from {', '.join(self.tables)}{where_text(self.terms)}"


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[Const, ...]

    def __str__(self) -> str:
        return f"insert into {self.table} ({', '.join(self.fields)}) values ({', '.join(map(str, self.values))})"


@dataclass(frozen=True)
class Delete:
    table: str
    terms: tuple[Term, ...] = ()

    def __str__(self) -> str:
        return f"delete from {self.table}{where_text(self.terms)}"


@dataclass(frozen=True)
class Update:
    table: str
    field: str
    value: Operand
    terms: tuple[Term, ...] = ()

    def __str__(self) -> str:
        return f"update {self.table} set {self.field} = {self.value}{where_text(self.terms)}"


@dataclass(frozen=True)
class ColumnDef:
    """`length` is None for int, the declared length for varchar."""

    name: str
    length: int | None = None

    def __str__(self) -> str:
        return f"{self.name} int" if self.length is None else f"{self.name} varchar({self.length})"


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]

    def __str__(self) -> str:
        return f"create table {self.table} ({', '.join(map(str, self.columns))})"


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Select

    def __str__(self) -> str:
        return f"create view {self.view} as {self.query}"


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    field: str

    def __str__(self) -> str:
        return f"create index {self.index} on {self.table} ({self.field})"


Command = Insert | Delete | Update | CreateTable | CreateView | CreateIndex
