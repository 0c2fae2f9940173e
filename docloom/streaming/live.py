"""Change-stream operators as Structured Streaming.

Stateful operators run per subscription key, with state in Spark's state
store, so a restarted query goes on where its checkpoint stands.  They handle
the events of a micro-batch in the order of ``order``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import ClosedError
from ..functions.exprs import glob


def watch(store: Any, pattern: str = "*") -> DataFrame:
    """A streaming DataFrame (seq, type, key, value, ts) of a store's commits.

    It follows the store's log, to which a segment is moved once its manifest
    is there; what was staged and never committed isn't seen.  ``pattern`` is an exact key, ``prefix*``, ``*``, or has ``*`` anywhere.
    """
    from ..sources.store import LOG_SCHEMA

    spark: SparkSession = store.spark
    stream = store.plain(spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{store.path}/log"))
    kind = F.when(F.col("tombstone"), F.lit("delete")).otherwise(F.lit("put"))
    events = stream.select("seq", kind.alias("type"), "key", "value", "ts")
    return events.where(glob(F.col("key"), pattern))


def watch_key(store: Any, key: str) -> DataFrame:
    return watch(store).where(F.col("key") == key)


def watch_prefix(store: Any, prefix: str) -> DataFrame:
    return watch(store).where(F.col("key").startswith(prefix))


def watch_collection(store: Any, name: str, identity: str | None = None) -> DataFrame:
    return watch_key(store, f"{name}:{identity}") if identity is not None else watch_prefix(store, f"{name}:")


def _stateful(df: DataFrame, by: Sequence[str], order: str, state: str, step, timeout: str = GroupStateTimeout.NoTimeout, on_timeout=None) -> DataFrame:
    """Fold each subscription's events in order.

    ``step(state, frame) -> (state, frame)`` sees a micro-batch's events of
    one subscription, sorted.
    """
    columns, schema = df.columns, df.schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        current = group.get if group.exists else None
        if group.hasTimedOut:
            out = on_timeout(current)
            group.remove()
            if out is not None:
                yield pd.DataFrame([dict(zip(columns, out, strict=True))])
            return
        frame = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        current, out, wait = step(current, frame)
        group.update(current)
        if wait is not None:
            group.setTimeoutDuration(wait)
        yield out[columns]

    return df.groupBy(*by).applyInPandasWithState(run, schema, state, "append", timeout)


def throttle(df: DataFrame, seconds: float, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Emit an event, then drop the subscription's others until ``seconds`` have passed."""
    span = int(seconds * 1_000_000)

    def step(state, frame):
        last = state[0] if state else None
        keep = []
        for us in pd.to_datetime(frame[order]).astype("datetime64[us]").astype("int64").tolist():
            fresh = last is None or us - last >= span
            last = us if fresh else last
            keep.append(fresh)
        return (last,), frame[keep], None

    return _stateful(df, by, order, "last long", step)


def distinct(df: DataFrame, key: str, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Drop events whose key equals the subscription's one just before."""

    text = f"_text_of_{key}"
    # JSON tells null, text and numbers apart, and equal values have equal JSON.
    told = df.withColumn(text, F.to_json(F.struct(F.col(key).alias("k")), {"ignoreNullFields": "false"}))

    def step(state, frame):
        last, keep = state[0] if state else None, []
        for value in frame[text].tolist():
            keep.append(value != last)
            last = value
        return (last,), frame[keep], None

    return _stateful(told, by, order, "last string", step).drop(text)


def take(df: DataFrame, n: int, by: Sequence[str], order: str = "ts") -> DataFrame:
    """The first ``n`` events of each subscription."""

    def step(state, frame):
        seen = state[0] if state else 0
        return (seen + len(frame),), frame.iloc[: max(0, n - seen)], None

    return _stateful(df, by, order, "seen long", step)


def skip(df: DataFrame, n: int, by: Sequence[str], order: str = "ts") -> DataFrame:
    """All but the first ``n`` events of each subscription."""

    def step(state, frame):
        seen = state[0] if state else 0
        return (seen + len(frame),), frame.iloc[max(0, n - seen) :], None

    return _stateful(df, by, order, "seen long", step)


def buffer(df: DataFrame, n: int, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Add ``batch``: the number, from 0, of the subscription's buffer of ``n``."""
    numbered = df.withColumn("batch", F.lit(0).cast("long"))

    def step(state, frame):
        seen = state[0] if state else 0
        return (seen + len(frame),), frame.assign(batch=[(seen + i) // n for i in range(len(frame))]), None

    return _stateful(numbered, by, order, "seen long", step)


def buffer_time(df: DataFrame, seconds: float, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Add ``batch_start``: a subscription's batches last ``seconds`` from their first event."""
    span = pd.Timedelta(seconds=seconds)
    marked = df.withColumn("batch_start", F.col(order))

    def step(state, frame):
        start, starts = (pd.Timestamp(state[0], unit="us") if state else None), []
        for at in pd.to_datetime(frame[order]):
            start = at if start is None or at - start >= span else start
            starts.append(start)
        return (start.value // 1000,), frame.assign(batch_start=starts), None

    return _stateful(marked, by, order, "start long", step)


def debounce(df: DataFrame, seconds: float, by: Sequence[str], order: str = "ts") -> DataFrame:
    """Emit a subscription's event after which nothing comes for ``seconds``.

    A later event decides by the events' own times; the newest one is held as
    JSON in the state, and a timer of processing time flushes it.
    """
    wait, span = max(1, int(seconds * 1000)), int(seconds * 1_000_000)
    packed = df.select(*by, order, F.to_json(F.struct(*df.columns)).alias("held"))
    columns = packed.columns

    def step(state, frame):
        times = pd.to_datetime(frame[order]).astype("datetime64[us]").astype("int64").tolist()
        held = frame["held"].tolist()
        if state:
            held, times = [state[0], *held], [state[1], *times]
        quiet = [held[i] for i in range(len(held) - 1) if times[i + 1] - times[i] >= span]
        out = frame.iloc[[0] * len(quiet)].assign(held=quiet)
        return (held[-1], times[-1]), out, wait

    def on_timeout(state):
        return tuple(state[0] if c == "held" else None for c in columns)

    out = _stateful(packed, by, order, "held string, us long", step, GroupStateTimeout.ProcessingTimeTimeout, on_timeout)
    return out.select(F.from_json("held", df.schema).alias("e")).select("e.*")


class Hub:
    """Running subscriptions, stopped together."""

    def __init__(self) -> None:
        self.queries: list[StreamingQuery] = []
        self.closed = False

    def listen(self, stream: DataFrame, handle, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        """Give each micro-batch DataFrame to ``handle(df, epoch)``."""
        if self.closed:
            raise ClosedError("the hub is closed")
        writer = stream.writeStream.foreachBatch(handle).outputMode("append")
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
        self.queries.append(query)
        return query

    def close(self) -> None:
        self.closed = True
        for query in self.queries:
            query.stop()


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def mapped(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns)


__all__ = ["Hub", "buffer", "buffer_time", "debounce", "distinct", "mapped", "skip", "take", "throttle", "watch", "watch_collection", "watch_key", "watch_prefix", "where"]
