"""The aggregates of group-by, as built-in Spark expressions with the dialect's column names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MaxFn:
    """Largest value of a field of any type, as `maxof<field>`."""

    field: str

    @property
    def name(self) -> str:
        return f"maxof{self.field}"

    def column(self) -> Column:
        return F.max(F.col(self.field)).alias(self.name)


@dataclass(frozen=True)
class CountFn:
    """Number of rows as a 32-bit int, as `countof<field>`; it counts rows, whatever the field holds."""

    field: str

    @property
    def name(self) -> str:
        return f"countof{self.field}"

    def column(self) -> Column:
        return F.count(F.lit(1)).cast("int").alias(self.name)


AggregateFn = MaxFn | CountFn
