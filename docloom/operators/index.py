"""Secondary indexes: posting tables and the planner that picks one.

A posting table holds the order keys of one or more fields, the document's id
and the document itself, sorted by key, so that a query reads nothing else.  It
is derived data, stamped with the version it was built from.  Equality on
leading fields plus one range or list condition on the next is served by an
index.  A filter compares keys, which are structs, and also their class and
number or string, which are leaves of the Parquet file, so that row-group
statistics prune the read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import key_literal, order_key, resolve
from ..values import LIST, MAP, NUMBER, OTHER, STRING, rank

RANGES = ("gt", "gte", "lt", "lte", "between")


@dataclass(frozen=True)
class IndexDefinition:
    """A single or compound index on dotted field paths of a collection."""

    collection: str
    fields: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.collection}.{'+'.join(self.fields)}"


def postings(df: DataFrame, fields: Sequence[str], variant: str | None = None, id_column: str = "_id", keep: Sequence[str] = ()) -> DataFrame:
    """(k0, k1, ..., _id) and the columns in ``keep``: every document, null and missing fields included."""
    keys = [order_key(resolve(df, f, variant)).alias(f"k{i}") for i, f in enumerate(fields)]
    return df.select(*keys, F.col(id_column).alias("_id"), *keep)


def _compared(key: Column, op: str, value: object) -> Column:
    """``key op value``, in terms of the key's leaves as far as they tell.

    Equality is told by the leaves alone: beside an equality of the whole
    struct, the optimizer would fold conditions on its leaves away.
    """
    kind, right = rank(value), key_literal(value)
    if op == "eq":
        leaf = {NUMBER: "num", STRING: "str", OTHER: "str", LIST: "bin", MAP: "bin"}.get(kind)
        return (key["cls"] == kind) & (key[leaf] == right[leaf]) if leaf else key["cls"] == kind
    above = op in ("gt", "gte")
    whole = {"gt": key > right, "gte": key >= right, "lt": key < right, "lte": key <= right}[op]
    implied = key["cls"] >= kind if above else key["cls"] <= kind
    if kind == NUMBER:
        bound = key["num"] >= float(value) if above else key["num"] <= float(value)
        implied &= key["num"].isNull() | bound
    return whole & implied


@dataclass(frozen=True)
class IndexPlan:
    """An index, how many conditions it serves, and the posting filter."""

    definition: IndexDefinition
    consumed: int
    predicate: Column


def plan(definitions: Sequence[IndexDefinition], collection: str, conditions: Sequence[tuple[str, str, object]]) -> IndexPlan | None:
    """The index that serves most conditions, the first of equals; None if none does."""
    best = None
    for definition in definitions:
        if definition.collection != collection:
            continue
        found = _plan_one(definition, conditions)
        if found and (best is None or found.consumed > best.consumed):
            best = found
    return best


def _plan_one(definition: IndexDefinition, conditions: Sequence[tuple[str, str, object]]) -> IndexPlan | None:
    predicate, consumed = F.lit(True), 0
    for i, field in enumerate(definition.fields):
        key, own = F.col(f"k{i}"), [c for c in conditions if c[0] == field]
        equal = [c for c in own if c[1] == "eq"]
        if equal:
            predicate &= _compared(key, "eq", equal[0][2])
            consumed += 1
            continue
        several = [c for c in own if c[1] == "in" and isinstance(c[2], (list, tuple))]
        if several:
            values = list(several[0][2])
            any_ = F.lit(False)
            for v in values:
                any_ |= _compared(key, "eq", v)
            predicate &= any_
            return IndexPlan(definition, consumed + 1, predicate)
        ranges = [c for c in own if c[1] in RANGES and (c[1] != "between" or isinstance(c[2], (list, tuple)) and len(c[2]) == 2)]
        for _, op, value in ranges:  # all ranges on the field tighten one interval
            for way, bound in (("gte", value[0]), ("lte", value[1])) if op == "between" else ((op, value),):
                predicate &= _compared(key, way, bound)
        if ranges:
            return IndexPlan(definition, consumed + len(ranges), predicate)
        break
    return IndexPlan(definition, consumed, predicate) if consumed else None
