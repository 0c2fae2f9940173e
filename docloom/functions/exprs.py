"""Predicates, keys and text search as Spark columns.

Fields are typed (a column or nested struct field) or dynamic (a path into a
VARIANT).  Typed comparisons with a literal of the same class become plain
comparisons, which reach the Parquet scan; those with a literal of another
class are constants, decided by the class order and never by coercion.
"""

from __future__ import annotations

import json
import math
import re
import sys
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values as _values
from ..errors import QueryError
from ..values import FALSE, LIST, MAP, NUMBER, OTHER, STRING, TRUE, encode, rank

# The few functions that run in Python workers go there by value, so workers needn't have this package.
cloudpickle.register_pickle_by_value(_values)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_EXACT = 1 << 53


@dataclass(frozen=True)
class Field:
    """A resolved field: its column and type; a VARIANT type is dynamic."""

    column: Column
    kind: T.DataType

    @property
    def dynamic(self) -> bool:
        return isinstance(self.kind, T.VariantType)

    @property
    def rank(self) -> int:
        """Class rank of a typed field's values that aren't null (true stands for both booleans)."""
        kind = self.kind
        if isinstance(kind, T.BooleanType):
            return TRUE
        if isinstance(kind, T.NumericType):
            return NUMBER
        if isinstance(kind, T.StringType):
            return STRING
        if isinstance(kind, T.ArrayType):
            return LIST
        if isinstance(kind, (T.StructType, T.MapType)):
            return MAP
        return OTHER


def resolve(df: DataFrame, path: str, variant: str | None = None) -> Field:
    """The field at a dotted path; a path that leads nowhere is a null field.

    ``variant`` names the VARIANT column of a dynamic collection.
    """
    parts = path.split(".")
    if variant is not None:
        steps = "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)
        return Field(F.try_variant_get(F.col(variant), "$" + steps, "variant"), T.VariantType())
    if parts[0] not in df.columns:
        return Field(F.lit(None).cast("string"), T.StringType())
    column, kind = df[parts[0]], df.schema[parts[0]].dataType
    for i, part in enumerate(parts[1:], 1):
        if isinstance(kind, T.StructType) and part in kind.names:
            column, kind = column.getField(part), kind[part].dataType
        elif isinstance(kind, T.VariantType):
            steps = "".join(f"['{p}']" for p in parts[i:])
            return Field(F.try_variant_get(column, "$" + steps, "variant"), T.VariantType())
        else:
            return Field(F.lit(None).cast("string"), T.StringType())
    return Field(column, kind)


# ---- dynamic values -------------------------------------------------------


def variant_class(v: Column) -> Column:
    """Class rank of a VARIANT value, null included."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(0))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(TRUE)).otherwise(F.lit(FALSE)))
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(NUMBER))
        .when(kind == "STRING", F.lit(STRING))
        .when(kind.startswith("ARRAY"), F.lit(LIST))
        .when(kind.startswith("OBJECT"), F.lit(MAP))
        .otherwise(F.lit(OTHER))
        .cast("byte")
    )


def _nested_key() -> Any:
    @F.pandas_udf("binary")
    def nested(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts.notna()  # scalars come as nulls: most often there is nothing to do
        if some.any():
            out[some] = texts[some].map(lambda t: encode(json.loads(t)))
        return out

    return nested


def order_key(field: Field, nested: bool = True) -> Column:
    """A struct that sorts, groups and compares by the total order.

    ``nested`` adds the encoding of lists and maps, which needs an Arrow UDF;
    scalars stay within generated code.
    """
    v = field.column
    if not field.dynamic:
        return _typed_key(field, nested)
    cls = variant_class(v)
    number = F.when(cls == NUMBER, F.try_variant_get(v, "$", "double"))
    text = F.when(cls == STRING, F.try_variant_get(v, "$", "string")).when(cls == OTHER, F.to_json(v))
    parts = [cls.alias("cls"), number.alias("num"), text.alias("str")]
    if nested:
        parts.append(_nested_key()(F.when(cls.isin(LIST, MAP), F.to_json(v))).alias("bin"))
    return F.struct(*parts)


def _typed_key(field: Field, nested: bool) -> Column:
    """The key of a typed field, of the same shape as a dynamic one's."""
    c, r = field.column, field.rank
    own = F.when(c, F.lit(TRUE)).otherwise(F.lit(FALSE)) if r == TRUE else F.lit(r)
    cls = F.when(c.isNull(), F.lit(0)).otherwise(own).cast("byte")
    number = c.cast("double") if r == NUMBER else F.lit(None).cast("double")
    text = c.cast("string") if r in (STRING, OTHER) else F.lit(None).cast("string")
    parts = [cls.alias("cls"), number.alias("num"), text.alias("str")]
    if nested:
        raw = _nested_key()(F.to_json(c)) if r in (LIST, MAP) else F.lit(None).cast("binary")
        parts.append(raw.alias("bin"))
    return F.struct(*parts)


def key_literal(value: Any, nested: bool = True) -> Column:
    """The key of a Python value."""
    r = rank(value)
    number = F.lit(float(value)) if r == NUMBER else F.lit(None).cast("double")
    text = F.lit(value if r == STRING else str(value)) if r in (STRING, OTHER) else F.lit(None).cast("string")
    parts = [F.lit(r).cast("byte").alias("cls"), number.alias("num"), text.alias("str")]
    if nested:
        raw = F.lit(bytearray(encode(value))) if r in (LIST, MAP) else F.lit(None).cast("binary")
        parts.append(raw.alias("bin"))
    return F.struct(*parts)


# ---- predicates -----------------------------------------------------------

_FLIPS = {
    "eq": lambda a, b: a.eqNullSafe(b),
    "ne": lambda a, b: ~a.eqNullSafe(b),
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def compare(field: Field, op: str, value: Any) -> Column:
    """``field op value`` under the total order; never null."""
    c = field.column
    if op not in _FLIPS:
        raise QueryError(f"unknown comparison {op}")
    if value is None:
        missing = c.isNull() if not field.dynamic else c.isNull() | F.is_variant_null(c)
        return {
            "eq": missing, "ne": ~missing, "gt": ~missing, "gte": F.lit(True), "lt": F.lit(False), "lte": missing,
        }[op]
    if field.dynamic:
        return _compare_dynamic(field, op, value)
    own, other = field.rank, rank(value)
    own_class = TRUE if other in (FALSE, TRUE) else other
    if own != own_class:
        if op in ("eq", "ne"):
            return F.lit(op == "ne")
        above = own > own_class
        if op in ("gt", "gte"):
            return c.isNotNull() if above else F.lit(False)
        return c.isNull() if above else F.lit(True)
    if own == NUMBER:
        return _compare_number(field, op, value)
    if own == MAP or own == LIST and not _plain_list(field.kind, value):
        return _FLIPS[op](order_key(field), key_literal(value))
    right = F.lit(value) if own != LIST else F.array(*[F.lit(v) for v in value]).cast(field.kind)
    return _null_aware(c, op, right)


def _null_aware(c: Column, op: str, right: Column) -> Column:
    if op in ("eq", "ne"):
        return _FLIPS[op](c, right)
    if op in ("lt", "lte"):
        return c.isNull() | _FLIPS[op](c, right)
    return c.isNotNull() & _FLIPS[op](c, right)  # never null, and pushed down whole


def _plain_list(kind: T.ArrayType, value: list) -> bool:
    element = Field(F.lit(None), kind.elementType).rank
    return element in (NUMBER, STRING, TRUE) and len(value) > 0 and all(
        v is not None and (TRUE if rank(v) == FALSE else rank(v)) == element for v in value
    )


def _compare_number(field: Field, op: str, value: Any) -> Column:
    """Numbers compare as doubles, but an integer column isn't cast where that gives the same."""
    c = field.column
    if isinstance(field.kind, _INTEGRAL) and isinstance(value, (int, float, Decimal)) and math.isfinite(value) and abs(value) < _EXACT:
        if value == int(value):
            return _null_aware(c, op, F.lit(int(value)))
        if op in ("eq", "ne"):
            return F.lit(op == "ne")
        bound = math.ceil(value) if op in ("gt", "gte") else math.floor(value)
        return _null_aware(c, "gte" if op in ("gt", "gte") else "lte", F.lit(bound))
    if not isinstance(field.kind, T.DoubleType):
        c = c.cast("double")
    return _null_aware(c, op, F.lit(float(value)))


def _compare_dynamic(field: Field, op: str, value: Any) -> Column:
    r = rank(value)
    if r in (LIST, MAP):
        return _FLIPS[op](order_key(field), key_literal(value))
    if r not in (NUMBER, STRING):
        return _FLIPS[op](order_key(field, nested=False), key_literal(value, nested=False))
    # One look at the class, and one at the value where it is of the literal's class.
    v = field.column
    kind = F.schema_of_variant(v)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    below = kind.isin("VOID", "BOOLEAN")
    if r == NUMBER:
        own, got, right = number, F.try_variant_get(v, "$", "double"), F.lit(float(value))
    else:
        own, got, right = kind == "STRING", F.try_variant_get(v, "$", "string"), F.lit(value)
        below = below | number
    below = F.coalesce(below, F.lit(True))  # a missing field is below all
    other = {"eq": F.lit(False), "ne": F.lit(True), "gt": ~below, "gte": ~below, "lt": below, "lte": below}[op]
    return F.when(own, F.coalesce(_FLIPS[op](got, right), F.lit(False))).otherwise(other)


def between(field: Field, bounds: Any) -> Column:
    if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
        raise QueryError("between takes a pair of bounds")
    return compare(field, "gte", bounds[0]) & compare(field, "lte", bounds[1])


def is_in(field: Field, values: Any) -> Column:
    if not isinstance(values, (list, tuple, set, frozenset)):
        raise QueryError("in takes a list of values")
    values = list(values)
    present = [v for v in values if v is not None]
    out = compare(field, "eq", None) if len(present) < len(values) else F.lit(False)
    if not field.dynamic and field.rank in (NUMBER, STRING) and not isinstance(field.kind, T.DecimalType):
        same = [v for v in present if rank(v) == field.rank]
        if isinstance(field.kind, _INTEGRAL):
            same = [int(v) for v in same if math.isfinite(v) and v == int(v) and abs(v) < _EXACT]
        elif field.rank == NUMBER:
            same = [float(v) for v in same]
        if not same:
            return out
        found = field.column.isNotNull() & field.column.isin(same)
        return found if len(present) == len(values) else out | found
    for v in present:
        out = out | compare(field, "eq", v)
    return out


def contains(field: Field, value: Any) -> Column:
    """Substring of a string, case-sensitive, or membership of a list."""
    c = field.column
    if field.dynamic:
        cls = variant_class(c)
        text = F.lit(False)
        if isinstance(value, str):
            text = (cls == STRING) & F.contains(F.try_variant_get(c, "$", "string"), F.lit(value))
        items = F.try_variant_get(c, "$", "array<variant>")
        element = lambda e: compare(Field(e, T.VariantType()), "eq", value)
        if rank(value) in (LIST, MAP):
            # No UDF inside a lambda: compare the canonical JSON of elements.
            want = json.dumps(value, separators=(",", ":"), sort_keys=True)
            element = lambda e: F.to_json(e) == want
        return F.coalesce(text, F.lit(False)) | F.coalesce((cls == LIST) & F.exists(items, element), F.lit(False))
    if isinstance(field.kind, T.StringType):
        return c.isNotNull() & F.contains(c, F.lit(value)) if isinstance(value, str) else F.lit(False)
    if isinstance(field.kind, T.ArrayType):
        inner = field.kind.elementType
        return F.coalesce(F.exists(c, lambda e: compare(Field(e, inner), "eq", value)), F.lit(False))
    return F.lit(False)


def search_field(field: Field, text: str) -> Column:
    """Case-insensitive substring of any value's text form."""
    shown = F.when(~compare(field, "eq", None), _shown(field))
    return F.coalesce(F.contains(F.lower(shown), F.lit(text.lower())), F.lit(False))


def _shown(field: Field) -> Column:
    if field.dynamic:
        return F.coalesce(F.try_variant_get(field.column, "$", "string"), F.to_json(field.column))
    return F.to_json(field.column) if field.rank in (LIST, MAP) else field.column.cast("string")


def search_anywhere(df: DataFrame, text: str, variant: str | None = None) -> Column:
    """Case-insensitive substring of any string value, in maps at any depth but not in lists."""
    want = text.lower()
    if variant is not None:
        # A document's string leaves outside lists, found in its JSON by an Arrow UDF.
        return _search_documents()(F.to_json(F.col(variant)), F.lit(want))
    out = F.lit(False)
    for leaf in _string_leaves(df.schema, None):
        out = out | F.coalesce(F.contains(F.lower(leaf), F.lit(want)), F.lit(False))
    return out


def _search_documents() -> Any:
    def found(value: Any, want: str) -> bool:
        if isinstance(value, str):
            return want in value.lower()
        return isinstance(value, dict) and any(found(v, want) for v in value.values())

    @F.pandas_udf("boolean")
    def search(texts: pd.Series, want: pd.Series) -> pd.Series:
        return pd.Series([t is not None and found(json.loads(t), w) for t, w in zip(texts, want, strict=True)])

    return search


def _string_leaves(schema: T.StructType, parent: Column | None) -> list[Column]:
    leaves = []
    for f in schema.fields:
        column = F.col(f"`{f.name}`") if parent is None else parent.getField(f.name)
        if isinstance(f.dataType, T.StringType):
            leaves.append(column)
        elif isinstance(f.dataType, T.StructType):
            leaves += _string_leaves(f.dataType, column)
    return leaves


# ---- keys and patterns ----------------------------------------------------


def glob(column: Column, pattern: str, question_is_star: bool = False) -> Column:
    """Match with ``*`` for any run of characters, also ``?`` if asked for.

    ``*`` alone matches all, ``prefix*`` a prefix, no wildcard equality.
    """
    wild = "[*?]" if question_is_star else "[*]"
    if pattern == "*":
        return F.lit(True)
    if not re.search(wild, pattern):
        return column == pattern
    if re.search(wild, pattern[:-1]) is None and pattern.endswith("*"):
        return column.startswith(pattern[:-1])
    body = ".*".join(_quoted(p) for p in re.split(wild, pattern))
    return column.rlike(f"(?s)^{body}$")


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def live(expires_at: Column, now: Any) -> Column:
    """Not expired at ``now``; a row expires at its instant."""
    return expires_at.isNull() | (expires_at > F.lit(now))
