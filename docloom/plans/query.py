"""The fluent query: an immutable description compiled to one DataFrame.

Order of application: conditions, sort, offset and limit, joins.  Aggregation
and distinct see the result of that.  Without a sort, offset and limit follow
the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import exprs
from ..operators.aggregate import Aggregation, distinct_values
from ..operators.index import IndexDefinition, plan
from ..operators.join import nested_join

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "between", "in", "contains", "search")


@dataclass(frozen=True)
class Collection:
    """Rows with an id: typed columns, or one VARIANT column named ``variant``."""

    name: str
    df: DataFrame
    ids: tuple[str, ...] = ("_id",)
    variant: str | None = None
    #: Index definitions with their posting tables, in order of creation.
    indexes: tuple[tuple[IndexDefinition, DataFrame], ...] = ()
    #: Called with (updates or None, matched rows) by update and delete.
    writer: Callable[[dict[str, Any] | None, DataFrame], int] | None = None

    def query(self) -> DocQuery:
        return DocQuery(self)


def typed(name: str, df: DataFrame, *ids: str) -> Collection:
    """A typed collection over any DataFrame; ``ids`` break ties of sorts."""
    return Collection(name, df, ids or ("_id",))


@dataclass(frozen=True)
class DocQuery:
    """A query on one collection.  Each method returns a new query."""

    collection: Collection
    conditions: tuple[tuple[str, str, Any], ...] = ()
    extra: tuple[Column, ...] = ()
    sort: tuple[str, bool, bool] | None = None
    taken: int | None = None
    skipped: int = 0
    joins: tuple[tuple[Collection, str, str], ...] = ()
    aggregation: Aggregation | None = field(default=None)

    # -- conditions, all of which must hold

    def where(self, path: str, op: str, value: Any = None) -> DocQuery:
        if op not in OPERATORS:
            raise QueryError(f"unknown operator {op}")
        return replace(self, conditions=(*self.conditions, (path, op, value)))

    def where_equals(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "eq", value)

    def where_not_equals(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "ne", value)

    def where_greater_than(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "gt", value)

    def where_greater_than_or_equal(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "gte", value)

    def where_less_than(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "lt", value)

    def where_less_than_or_equal(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "lte", value)

    def where_between(self, path: str, low: Any, high: Any) -> DocQuery:
        return self.where(path, "between", (low, high))

    def where_in(self, path: str, values: Sequence[Any]) -> DocQuery:
        return self.where(path, "in", values)

    def where_contains(self, path: str, value: Any) -> DocQuery:
        return self.where(path, "contains", value)

    def search(self, text: str, path: str | None = None) -> DocQuery:
        """Case-insensitive text in one field, or in any string."""
        return self.where(path or "", "search", text)

    def where_any(self, *groups: Callable[[DocQuery], DocQuery]) -> DocQuery:
        """Extension: rows for which at least one group of conditions holds."""
        blank = DocQuery(self.collection)
        out = F.lit(False)
        for g in groups:
            out = out | g(blank).predicate()
        return replace(self, extra=(*self.extra, out))

    # -- order and window

    def order_by(self, path: str, descending: bool = False, nulls_last: bool = False) -> DocQuery:
        """Sort by one field; nulls come first, or last, in either direction.  The last call wins."""
        return replace(self, sort=(path, descending, nulls_last))

    def limit(self, n: int) -> DocQuery:
        if n < 0:
            raise QueryError("limit can't be negative")
        return replace(self, taken=n)

    def offset(self, n: int) -> DocQuery:
        if n < 0:
            raise QueryError("offset can't be negative")
        return replace(self, skipped=n)

    def join(self, other: Collection, local_field: str, foreign_field: str) -> DocQuery:
        """Attach matching documents of ``other`` as the list ``_joined_<name>``."""
        return replace(self, joins=(*self.joins, (other, local_field, foreign_field)))

    def aggregate(self, build: Callable[[Aggregation], Aggregation]) -> DocQuery:
        return replace(self, aggregation=build(self.aggregation or Aggregation()))

    # -- compilation

    def predicate(self) -> Column:
        """All conditions as one column, never null."""
        df, variant = self.collection.df, self.collection.variant
        out = F.lit(True)
        for path, op, value in self.conditions:
            out = out & _condition(df, variant, path, op, value)
        for column in self.extra:
            out = out & column
        return out

    def matched(self, use_indexes: bool = True) -> DataFrame:
        """Rows that meet the conditions, through the best index if there is one.

        Conditions are checked again on the rows that an index finds.
        """
        df = self.collection.df
        if use_indexes and self.collection.indexes:
            best = plan([d for d, _ in self.collection.indexes], self.collection.name, self.conditions)
            if best is not None:
                table = dict(self.collection.indexes)[best.definition]
                hits = table.where(best.predicate)
                if set(df.columns) <= set(table.columns):  # the postings cover the documents
                    df = hits.select(*df.columns)
                else:
                    df = df.join(hits.select(F.col("_id").alias(self.collection.ids[0])), self.collection.ids[0], "left_semi")
        if not self.conditions and not self.extra:
            return df
        return df.where(replace(self, collection=replace(self.collection, df=df)).predicate())

    def window(self, use_indexes: bool = True) -> DataFrame:
        """Matched rows, sorted, after offset and limit; ids still present."""
        df, ids = self.matched(use_indexes), [F.col(c) for c in self.collection.ids]
        if self.sort:
            path, descending, nulls_last = self.sort
            f = exprs.resolve(df, path, self.collection.variant)
            key = f.column if not f.dynamic else exprs.order_key(f)
            if f.dynamic:
                # A dynamic null has a key of its own: place it by hand.
                df = df.orderBy(*[_placed(exprs.compare(f, "eq", None), nulls_last), key.desc() if descending else key.asc(), *ids])
            else:
                way = {(0, 0): key.asc_nulls_first, (0, 1): key.asc_nulls_last, (1, 0): key.desc_nulls_first, (1, 1): key.desc_nulls_last}
                df = df.orderBy(way[int(descending), int(nulls_last)](), *ids)
        elif self.taken is not None or self.skipped:
            df = df.orderBy(*ids)
        if self.skipped:
            df = df.offset(self.skipped)
        return df if self.taken is None else df.limit(self.taken)

    def to_df(self, use_indexes: bool = True) -> DataFrame:
        """Documents with their ids and joined lists."""
        df = self.window(use_indexes)
        for other, local, foreign in self.joins:
            df = nested_join(df, other.df, local, foreign, f"_joined_{other.name}", self.collection.variant, other.variant, other.ids[0])
        return df

    # -- terminals

    def find(self) -> DataFrame:
        """Documents; a generated ``_id`` isn't part of them."""
        df = self.to_df()
        return df.drop("_id") if "_id" in self.collection.ids else df

    def find_one(self) -> Any | None:
        """The first document, by the sort or else by the id."""
        return replace(self, taken=1 if self.taken is None else min(self.taken, 1)).find().first()

    def count(self) -> int:
        """Number of documents within the window; joins don't matter."""
        return int(self.count_df().first().n)

    def count_df(self) -> DataFrame:
        """The same as a one-row DataFrame, computed from one plain count."""
        n = F.greatest(F.count(F.lit(1)) - F.lit(self.skipped), F.lit(0))
        return self.matched().agg((n if self.taken is None else F.least(n, F.lit(self.taken))).cast("long").alias("n"))

    def distinct(self, path: str) -> DataFrame:
        """Distinct non-null values of a field within the window, in the order in which ids meet them."""
        df = self.window()
        return distinct_values(df, exprs.resolve(df, path, self.collection.variant), path, self.collection.ids)

    def execute_aggregation(self, documents: bool = False) -> DataFrame:
        if self.aggregation is None:
            raise QueryError("aggregate() wasn't called")
        windowed = self.taken is not None or self.skipped or self.joins
        df = self.to_df() if windowed else self.matched()
        return self.aggregation.apply(df, self.collection.variant, documents, self.collection.ids)

    def update(self, changes: dict[str, Any]) -> int:
        """Merge ``changes`` into the documents of the window, as one commit; how many."""
        return self._write(changes)

    def delete(self) -> int:
        """Delete the documents of the window, as one commit; how many."""
        return self._write(None)

    def _write(self, changes: dict[str, Any] | None) -> int:
        if self.collection.writer is None:
            raise QueryError(f"collection {self.collection.name} is read-only")
        return self.collection.writer(changes, self.window())

    def updated_df(self, changes: dict[str, Any]) -> DataFrame:
        """A typed collection's state after an update of the window's rows, as a DataFrame."""
        df, hit = self._marked()
        kinds = dict(df.dtypes)
        new = {k: F.when(hit, F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v)).otherwise(F.col(k) if k in kinds else F.lit(None)) for k, v in changes.items()}
        return df.withColumns(new).drop("_hit")

    def deleted_df(self) -> DataFrame:
        """A collection's state after a delete of the window's rows, as a DataFrame."""
        df, hit = self._marked()
        return df.where(~hit).drop("_hit")

    def _marked(self) -> tuple[DataFrame, Column]:
        """The collection's rows, and whether each is in the window; the ids tell rows apart."""
        df = self.collection.df
        if self.taken is None and not self.skipped:
            return df, self.predicate()
        ids = list(self.collection.ids)
        hit = self.window().select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(ids)]).distinct().withColumn("_hit", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(ids)]
        marked = df.join(hit, same, "left").select(*df.columns, F.col("_hit"))
        return marked, F.coalesce("_hit", F.lit(False))


def _placed(is_null: Column, nulls_last: bool) -> Column:
    return is_null.asc() if nulls_last else is_null.desc()


def _condition(df: DataFrame, variant: str | None, path: str, op: str, value: Any) -> Column:
    if op == "search":
        if not path:
            return exprs.search_anywhere(df, value, variant)
        return exprs.search_field(exprs.resolve(df, path, variant), value)
    f = exprs.resolve(df, path, variant)
    if op == "between":
        return exprs.between(f, value)
    if op == "in":
        return exprs.is_in(f, value)
    if op == "contains":
        return exprs.contains(f, value)
    return exprs.compare(f, op, value)
