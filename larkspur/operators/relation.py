"""A fluent operator layer: each method is one relational operator and returns a new lazy relation.

The physical operators that classical engines offer by name are reached by hints, so a plan can be
pinned; without a hint Catalyst and adaptive execution choose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.errors import BindError
from larkspur.functions.aggregates import AggregateFn
from larkspur.plans.binder import Scope, estimated_bytes
from larkspur.plans.syntax import Const, Field, Term

#: A join side is broadcast only if the optimiser's size estimate of it is at most this.
BROADCAST_BYTES = 64 << 20


class Relation:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def _name(self, field: str) -> str:
        return Scope.of(self.df).lookup(field)[0]

    def where(self, *terms: Term) -> Relation:
        """Rows that satisfy every equality."""
        return Relation(self.df.filter(Scope.of(self.df).predicate(terms)))

    def where_equal(self, field: str, value: int | str) -> Relation:
        return self.where(Term(Field(field), Const(value)))

    def project(self, *fields: str) -> Relation:
        """The listed columns; duplicates of rows stay."""
        return Relation(self.df.select(*[self._name(f) for f in fields]))

    def _without(self, other: Relation) -> DataFrame:
        """This side without the columns that `other` hides."""
        hidden = {f.lower() for f in other.fields}
        return self.df.select(*[f for f in self.fields if f.lower() not in hidden])

    def product(self, other: Relation) -> Relation:
        """All pairs; of equal names the left one is visible."""
        return Relation(self.df.crossJoin(other._without(self)))

    def optimized_product(self, other: Relation) -> Relation:
        """As `product`, with the smaller side as the one that is replicated."""
        small = estimated_bytes(self.df) < estimated_bytes(other.df)
        found = other._without(self).crossJoin(self.df) if small else self.df.crossJoin(other._without(self))
        return Relation(found.select(*self.fields, *[f for f in other.fields if f.lower() not in {x.lower() for x in self.fields}]))

    def block_product(self, other: Relation) -> Relation:
        """Block nested loops over partitions on both sides: no side has to fit anywhere."""
        return Relation(self.df.hint("shuffle_replicate_nl").crossJoin(other._without(self)))

    def _equi(self, other: Relation, left: str, right: str, hint: str | None, right_first: bool) -> Relation:
        a, b = self._name(left), other._name(right)
        ours = self.df.select(*[F.col(f).alias(f"l__{f}") for f in self.fields])
        theirs = other.df.select(*[F.col(f).alias(f"r__{f}") for f in other.fields])
        scope = Scope({**Scope.of(ours).columns, **Scope.of(theirs).columns})
        condition = scope.term(Term(Field(f"l__{a}"), Field(f"r__{b}")))
        if hint:
            theirs = theirs.hint(hint)
        mine, yours = {f.lower() for f in self.fields}, {f.lower() for f in other.fields}
        shown = [F.col(f"l__{f}").alias(f) for f in self.fields if not (right_first and f.lower() in yours)]
        shown += [F.col(f"r__{f}").alias(f) for f in other.fields if right_first or f.lower() not in mine]
        return Relation(ours.join(theirs, condition, "inner").select(*shown))

    def join(self, other: Relation, left: str, right: str) -> Relation:
        """Equi-join by whatever strategy Catalyst and adaptive execution pick."""
        return self._equi(other, left, right, None, False)

    def merge_join(self, other: Relation, left: str, right: str) -> Relation:
        """Sort-merge equi-join, with all pairs of equal keys on both sides."""
        return self._equi(other, left, right, "merge", False)

    def index_join(self, other: Relation, left: str, right: str) -> Relation:
        """Probe the right side by key: broadcast hash join while that side is small, shuffled hash join beyond.

        Of equal names the right one is visible.
        """
        small = estimated_bytes(other.df) <= BROADCAST_BYTES
        return self._equi(other, left, right, "broadcast" if small else "shuffle_hash", True)

    def index_select(self, field: str, value: int | str) -> Relation:
        """Equality lookup; it reaches the scan, where row groups are skipped by their statistics and bloom filters."""
        return self.where_equal(field, value)

    def sort(self, *fields: str) -> Relation:
        """Ascending by the fields."""
        if not fields:
            raise BindError("sort needs a field")
        return Relation(self.df.orderBy(*[F.col(self._name(f)).asc() for f in fields]))

    def group_by(self, fields: Sequence[str], aggregates: Sequence[AggregateFn]) -> Relation:
        """One row per group; no fields make one global group, even over no rows."""
        checked = [type(a)(self._name(a.field)) for a in aggregates]
        return Relation(self.df.groupBy(*[self._name(f) for f in fields]).agg(*[a.column() for a in checked]))

    def materialize(self) -> Relation:
        """Compute once, spill to disk as needed, read often."""
        return Relation(self.df.persist(StorageLevel.MEMORY_AND_DISK))
