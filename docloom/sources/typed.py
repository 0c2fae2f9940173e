"""A typed view of a collection: documents with a schema, as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Collection, DocQuery
from .store import Store

R = TypeVar("R")


class TypedCollection(Generic[R]):
    """Documents ``name:<id>`` as objects, or as a DataFrame with ``schema``.

    ``from_doc`` and ``to_doc`` map between documents and objects at the edge;
    queries run on columns.
    """

    def __init__(self, store: Store, name: str, schema: T.StructType | str, from_doc: Callable[[dict], R] = dict, to_doc: Callable[[R], dict] = dict) -> None:
        self.store, self.name, self.from_doc, self.to_doc = store, name, from_doc, to_doc
        self.schema = schema if isinstance(schema, str) else schema.simpleString()[len("struct<") : -1]

    def df(self) -> DataFrame:
        """(_id, fields...) with the schema's types, from one pass over the JSON."""
        docs = self.store.collection(self.name).df
        return docs.select("_id", F.from_json(F.to_json("doc"), self.schema).alias("d")).select("_id", "d.*")

    def query(self) -> DocQuery:
        base = self.store.collection(self.name)
        return DocQuery(Collection(self.name, self.df(), ("_id",), writer=self._writer(base)))

    def _writer(self, base: Collection) -> Callable[[dict[str, Any] | None, DataFrame], int]:
        return lambda changes, hit: base.writer(changes, base.df.join(hit.select("_id"), "_id", "left_semi"))

    def where(self, field: str, op: str, value: Any) -> DocQuery:
        return self.query().where(field, op, value)

    def get(self, identity: str) -> R | None:
        doc = self.store.document(self.name, identity)
        return None if doc is None else self.from_doc(doc)

    def exists(self, identity: str) -> bool:
        return self.store.exists(f"{self.name}:{identity}")

    def all(self) -> list[R]:
        """Every object, in id order."""
        import json

        rows = self.store.collection(self.name).df.orderBy("_id").select(F.to_json("doc").alias("d")).collect()
        return [self.from_doc(json.loads(r.d)) for r in rows]

    def count(self) -> int:
        return self.store.collection(self.name).df.count()

    def put(self, identity: str, item: R, ttl: float | None = None) -> int:
        return self.put_all({identity: item}, ttl)

    def put_all(self, items: Mapping[str, R], ttl: float | None = None) -> int:
        return self.store.put_batch({f"{self.name}:{k}": self.to_doc(v) for k, v in items.items()}, ttl)

    def delete(self, identity: str) -> int:
        return self.store.delete(f"{self.name}:{identity}")

    def create_index(self, *fields: str):
        return self.store.create_index(self.name, list(fields))

    def changes(self, identity: str | None = None, after: int = -1) -> DataFrame:
        """(type, id, value, ts) of this collection's commits."""
        events = self.store.changes(after).where(F.col("key").startswith(f"{self.name}:"))
        events = events.withColumn("id", F.expr(f"substring(key, {len(self.name) + 2})"))
        return events.where(F.col("id") == identity).drop("key") if identity is not None else events.drop("key")
