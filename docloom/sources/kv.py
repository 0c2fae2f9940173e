"""Ordered key/value views over a DataFrame (key, value, expires_at).

Keys are strings ordered by their UTF-8 bytes.  Each read takes one ``now``;
a row is gone from its expiry instant on.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidKeyError
from ..functions.exprs import glob, live

#: Keys that begin with this are the engine's own.
RESERVED = "\x00"


def check_key(key: str) -> str:
    if not isinstance(key, str) or not key or key.startswith(RESERVED):
        raise InvalidKeyError("a key is a string that isn't empty and doesn't begin with NUL")
    return key


def split_address(key: str) -> tuple[str, str] | None:
    """(collection, id) of a document's key, cut at the first colon; None if it isn't one."""
    collection, colon, identity = key.partition(":")
    return (collection, identity) if colon and collection and identity else None


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def visible(kv: DataFrame, now: datetime | None = None) -> DataFrame:
    """Rows that are live and not the engine's own."""
    return kv.where((F.col("key") >= "\x01") & live(F.col("expires_at"), now or utc_now()))


def lookup(kv: DataFrame, key: str, now: datetime | None = None) -> DataFrame:
    """The live row of one key, or none."""
    return visible(kv, now).where(F.col("key") == check_key(key))


def get_batch(kv: DataFrame, keys: Sequence[str], now: datetime | None = None) -> DataFrame:
    """(key, value) for each requested key; null where there is no live row."""
    wanted = kv.sparkSession.createDataFrame([(check_key(k),) for k in dict.fromkeys(keys)], "key string")
    found = visible(kv, now).where(F.col("key").isin(list(keys))).select("key", "value")
    return wanted.join(found, "key", "left")


def exists(kv: DataFrame, key: str, now: datetime | None = None) -> bool:
    return not lookup(kv, key, now).isEmpty()


def _ordered(df: DataFrame, limit: int | None, reverse: bool) -> DataFrame:
    df = df.orderBy(F.desc("key") if reverse else F.asc("key"))
    return df if limit is None else df.limit(limit)


def scan(
    kv: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, reverse: bool = False, now: datetime | None = None
) -> DataFrame:
    """Live rows with start <= key < end, in key order."""
    df = visible(kv, now)
    if start is not None:
        df = df.where(F.col("key") >= start)
    if end is not None:
        df = df.where(F.col("key") < end)
    return _ordered(df, limit, reverse)


def scan_prefix(kv: DataFrame, prefix: str, limit: int | None = None, reverse: bool = False, now: datetime | None = None) -> DataFrame:
    """Live rows whose key starts with ``prefix``, in key order."""
    return _ordered(visible(kv, now).where(F.col("key").startswith(prefix)), limit, reverse)


def keys(kv: DataFrame, prefix: str | None = None, limit: int | None = None, reverse: bool = False, now: datetime | None = None) -> DataFrame:
    """Live keys, in order; values aren't read."""
    df = visible(kv, now)
    if prefix:
        df = df.where(F.col("key").startswith(prefix))
    return _ordered(df.select("key"), limit, reverse)


def match(kv: DataFrame, pattern: str, now: datetime | None = None) -> DataFrame:
    """Live rows whose key matches: ``*`` all, ``p*`` a prefix, and both ``*`` and ``?`` any run."""
    return visible(kv, now).where(glob(F.col("key"), pattern, question_is_star=True))


def latest(log: DataFrame, values: Sequence[str], key: str = "key", seq: str = "seq") -> DataFrame:
    """The newest entry of each key of a change log, without keys it deletes.

    A grouped maximum with partial aggregation: a hot key's entries are
    reduced before the shuffle.
    """
    newest = F.max_by(F.struct("tombstone", *values), F.col(seq)).alias("_newest")
    out = log.groupBy(key).agg(newest).where(~F.col("_newest.tombstone"))
    return out.select(key, *[F.col(f"_newest.{v}").alias(v) for v in values])


def purge(kv: DataFrame, now: datetime | None = None) -> DataFrame:
    """Keys of rows that have expired."""
    return kv.where(~live(F.col("expires_at"), now or utc_now())).select("key")


def put_row(key: str, value: Any, expires_at: datetime | None = None) -> tuple[str, Any, datetime | None]:
    return check_key(key), value, expires_at
