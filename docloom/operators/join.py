"""Nested left-outer equi-join: matches become a list of documents.

Null keys never match.  A row without a match has a null list.  Keys compare
by the total order, so an integer meets an equal double and a string never
meets a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import Field, compare, order_key, resolve


def _keys(left: Field, right: Field) -> tuple[Column, Column] | None:
    """Comparable key columns; None when typed classes can't meet."""
    if left.dynamic or right.dynamic:
        return order_key(left), order_key(right)
    if left.rank != right.rank:
        return None
    return left.column, right.column


def nested_join(
    df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, name: str,
    variant: str | None = None, foreign_variant: str | None = None, order: str = "_id",
) -> DataFrame:
    """Add ``name``: the list of foreign documents whose field equals the local one, by their order column.

    The foreign side is grouped once by key, so the join adds no rows.  A hot
    foreign key gives one long list, which is what was asked for; counts and
    flat forms should use ``flat_join``.
    """
    local, other = resolve(df, local_field, variant), resolve(foreign, foreign_field, foreign_variant)
    keys = _keys(local, other)
    documents = F.array_sort(F.collect_list(F.struct(order, *[c for c in foreign.columns if c != order])))
    if any(t == "variant" for _, t in foreign.dtypes):
        # A VARIANT can't be ordered: sort by the id alone.
        documents = F.array_sort(
            F.collect_list(F.struct("*")),
            lambda a, b: F.when(a[order] < b[order], F.lit(-1)).when(a[order] > b[order], F.lit(1)).otherwise(F.lit(0)),
        )
    if keys is None:
        kind = foreign.groupBy(F.lit(1)).agg(documents.alias("x")).schema["x"].dataType
        return df.withColumn(name, F.lit(None).cast(kind))
    grouped = foreign.where(~compare(other, "eq", None)).groupBy(keys[1].alias("_foreign_key")).agg(documents.alias(name))
    keyed = df.withColumn("_local_key", F.when(~compare(local, "eq", None), keys[0]))
    if name in df.columns:
        keyed = keyed.drop(name)
    return keyed.join(grouped, keyed["_local_key"] == grouped["_foreign_key"], "left").drop("_local_key", "_foreign_key")


def flat_join(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, how: str = "inner") -> DataFrame:
    """The same equi-join with a row per match; ``how`` is inner or left."""
    local, other = resolve(df, local_field), resolve(foreign, foreign_field)
    keys = _keys(local, other)
    condition = keys[0] == keys[1] if keys else F.lit(False)
    return df.join(foreign, condition, how)
