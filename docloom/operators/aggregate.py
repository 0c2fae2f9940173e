"""Aggregation: count, sum, avg, min, max and distinct, ungrouped or by one field.

Result columns are named ``function_field``, or ``count`` without a field.
Sums and averages skip what isn't a number and are 0 over nothing; minimum
and maximum follow the total order, skip nulls and are null over nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.exprs import Field, compare, order_key, resolve
from ..values import NUMBER

FUNCTIONS = ("count", "sum", "avg", "min", "max", "distinct", "values")


@dataclass(frozen=True)
class Aggregation:
    """An immutable list of aggregates and at most one grouping field."""

    specs: tuple[tuple[str, str | None], ...] = ()
    group_field: str | None = None

    def _with(self, function: str, field: str | None) -> Aggregation:
        kept = tuple(s for s in self.specs if s != (function, field))
        return replace(self, specs=(*kept, (function, field)))

    def count(self, field: str | None = None) -> Aggregation:
        return self._with("count", field)

    def sum(self, field: str) -> Aggregation:
        return self._with("sum", field)

    def avg(self, field: str) -> Aggregation:
        return self._with("avg", field)

    def min(self, field: str) -> Aggregation:
        return self._with("min", field)

    def max(self, field: str) -> Aggregation:
        return self._with("max", field)

    def distinct(self, field: str) -> Aggregation:
        return self._with("distinct", field)

    def values(self, field: str) -> Aggregation:
        """The distinct values themselves, as a sorted list; those of a dynamic field as JSON text."""
        return self._with("values", field)

    def group_by(self, field: str) -> Aggregation:
        return replace(self, group_field=field)

    def apply(self, df: DataFrame, variant: str | None = None, documents: bool = False, ids: Sequence[str] = ()) -> DataFrame:
        """One row, or one per group; ``documents`` adds each group's documents as a list.

        With ``ids``, groups come in the order in which their first documents,
        by these columns, are met.
        """
        columns = [aggregate(resolve(df, field, variant) if field else None, function).alias(name_of(function, field)) for function, field in self.specs]
        if documents:
            columns.append(F.collect_list(F.struct("*")).alias("documents"))
        if not columns:
            raise QueryError("nothing to aggregate")
        if self.group_field is None:
            return df.agg(*columns)
        field = resolve(df, self.group_field, variant)
        if ids:
            columns.append(F.min(F.struct(*ids)).alias("_first"))
        if not field.dynamic:
            out = df.groupBy(field.column.alias(self.group_field)).agg(*columns)
        else:
            shown = F.min_by(field.column, F.to_json(field.column)).alias(self.group_field)
            out = df.groupBy(order_key(field).alias("_key")).agg(shown, *columns).drop("_key")
        return out.orderBy("_first").drop("_first") if ids else out


def name_of(function: str, field: str | None) -> str:
    return f"{function}_{field}" if field else function


def aggregate(field: Field | None, function: str) -> Column:
    """One aggregate as a column."""
    if function not in FUNCTIONS:
        raise QueryError(f"unknown aggregate {function}")
    if field is None:
        return F.count(F.lit(1))
    c = field.column
    present = ~compare(field, "eq", None)
    if function == "count":
        return F.count(F.when(present, F.lit(1)))
    if function in ("sum", "avg"):
        number = _number(field)
        if number is None:
            return F.lit(0) if function == "sum" else F.lit(0.0)
        return F.coalesce(F.sum(number), F.lit(0)) if function == "sum" else F.coalesce(F.avg(number), F.lit(0.0))
    if function == "values":
        return F.array_sort(F.collect_set(F.when(present, F.to_json(c) if field.dynamic else c)))
    if function == "distinct":
        key = order_key(field) if field.dynamic else c
        return F.count_distinct(F.when(present, key))
    if not field.dynamic:
        return F.min(c) if function == "min" else F.max(c)
    key = F.when(present, order_key(field))
    return F.min_by(c, key) if function == "min" else F.max_by(c, key)


def _number(field: Field) -> Column | None:
    """The field where it is a number, for sums; None for other typed fields."""
    if field.dynamic:
        return F.try_variant_get(F.when(order_key(field, nested=False)["cls"] == NUMBER, field.column), "$", "double")
    if not isinstance(field.kind, T.NumericType):
        return None
    return field.column


def distinct_values(df: DataFrame, field: Field, name: str, ids: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values under the total order, by ``ids`` in the order in which they are met first."""
    present = df.where(~compare(field, "eq", None))
    first = [F.min(F.struct(*ids)).alias("_first")] if ids else []
    if not field.dynamic:
        key = field.column.alias(name)
        return present.groupBy(key).agg(*first).orderBy("_first").drop("_first") if ids else present.select(key).distinct()
    grouped = present.groupBy(order_key(field).alias("_key"))
    out = grouped.agg(F.min_by(field.column, F.to_json(field.column)).alias(name), *first).drop("_key")
    return out.orderBy("_first").drop("_first") if ids else out
