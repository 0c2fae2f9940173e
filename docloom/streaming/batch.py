"""Change-stream operators over an ordered table, in batch form.

``order`` is a column that orders events totally.  ``by`` names the columns
that make a subscription; without it all rows are one subscription, as in a
single listener, and pass through one task.  ``distinct`` and ``debounce``
look at neighbours only; ``throttle`` and ``buffer_time`` depend on what was
emitted before, and scan each subscription in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _window(order: str, by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def _parts(df: DataFrame, order: str) -> DataFrame:
    """Add ``_part``: which of several ranges of ``order`` an event is in.

    The ranges are cut at quantiles that are found once and stand in the plan
    as literals, so every evaluation deals events alike.  An order that has no
    quantiles (a string) is one range.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(F.col(order).cast("timestamp"))
    elif isinstance(kind, T.NumericType):
        value = F.col(order)
    else:
        return df.withColumn("_part", F.lit(0))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000).alias("cuts")).first().cuts if n > 1 else None
    if not cuts:
        return df.withColumn("_part", F.lit(0))
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return df.withColumn("_part", F.size(F.filter(bounds, lambda c: c < value)))


def _local(per_range: DataFrame) -> DataFrame:
    """A row per range, of which there are at most as many as shuffle partitions, as local data."""
    return per_range.sparkSession.createDataFrame(per_range.collect(), per_range.schema)


def _beside(own: DataFrame, per_range: DataFrame) -> DataFrame:
    """Each row with its range's row.

    The key is cast: from two equal columns Spark would infer a filter on the
    ranges' side that reads the event's own columns.
    """
    right = F.broadcast(per_range.withColumnRenamed("_part", "_range"))
    return own.join(right, F.col("_part").cast("long") == F.col("_range")).drop("_range")


def _neighbour(df: DataFrame, value: Column, name: str, order: str, by: Sequence[str], ahead: bool) -> DataFrame:
    """Add ``name``: the previous (or next) event's ``value``, and ``<name>_is``: whether there is one.

    One subscription over all rows is cut into ranges of its order; only each
    range's edge event, one row, crosses to its neighbour.
    """
    shift, there = (F.lead if ahead else F.lag), f"{name}_is"
    some = lambda c: F.coalesce(c, F.lit(False))
    if by:
        window = _window(order, by)
        return df.withColumns({name: shift(value).over(window), there: some(shift(F.lit(True)).over(window))})
    ranged = _parts(df, order).withColumn("_value", value)
    edge = (F.min_by if ahead else F.max_by)("_value", order)
    edges = _local(ranged.groupBy("_part").agg(edge.alias("_last")))
    places = Window.orderBy("_part")
    edges = edges.select("_part", shift("_last").over(places).alias("_edge"), some(shift(F.lit(True)).over(places)).alias("_edge_is"))
    window = Window.partitionBy("_part").orderBy(order)
    own = ranged.withColumns({name: shift("_value").over(window), there: some(shift(F.lit(True)).over(window))})
    met = _beside(own, edges)
    met = met.withColumns({name: F.when(F.col(there), F.col(name)).otherwise(F.col("_edge")), there: F.col(there) | F.col("_edge_is")})
    return met.select(*df.columns, name, there)


def distinct(df: DataFrame, key: str | Column, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Drop events whose key equals the one just before."""
    key = F.col(key) if isinstance(key, str) else key
    marked = _neighbour(df, key, "_before", order, by, False)
    return marked.where(~F.col("_before_is") | ~F.col("_before").eqNullSafe(key)).select(*df.columns)


def debounce(df: DataFrame, silence: Column, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Keep events after which nothing comes for ``silence``; the last one is flushed."""
    marked = _neighbour(df, F.col(order), "_next", order, by, True)
    return marked.where(F.col("_next").isNull() | (F.col("_next") >= F.col(order) + silence)).select(*df.columns)


def take(df: DataFrame, n: int, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` events of each subscription."""
    if not by:
        return df.orderBy(order).limit(max(n, 0))
    return df.withColumn("_nth", F.row_number().over(_window(order, by))).where(F.col("_nth") <= n).drop("_nth")


def skip(df: DataFrame, n: int, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """All but the first ``n`` events of each subscription."""
    if not by:
        return df.orderBy(order).offset(max(n, 0))
    return df.withColumn("_nth", F.row_number().over(_window(order, by))).where(F.col("_nth") > n).drop("_nth")


def positions(df: DataFrame, order: str, name: str) -> DataFrame:
    """Number all events from 0 in order, without one task that sees them all.

    Events are dealt to ranges of their order; a task numbers its own, and the
    sizes of the ranges before it, one row each, are added.
    """
    ranged = _parts(df, order)
    counted = _local(ranged.groupBy("_part").agg(F.count("*").alias("_n")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    met = _beside(own, bases)
    return met.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).select(*df.columns, name)


def numbered(df: DataFrame, n: int, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Add ``batch``: the number, from 0, of the event's buffer of ``n``."""
    if n < 1:
        raise ValueError("a buffer holds at least one event")
    if not by:
        return positions(df, order, "_nth").withColumn("batch", F.floor(F.col("_nth") / n).cast("long")).drop("_nth")
    nth = F.row_number().over(_window(order, by))
    return df.withColumn("batch", F.floor((nth - 1) / n).cast("long"))


def buffer(df: DataFrame, n: int, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Lists of ``n`` events in order; the last one may be shorter."""
    events = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias("events")
    return numbered(df, n, order, by).groupBy(*by, "batch").agg(events)


def _scan(df: DataFrame, seconds: float, order: str, by: Sequence[str], buffered: bool) -> DataFrame:
    """Mark each event with the emission at or before it.

    Groups are sorted and streamed batch by batch, and the place reached is
    carried on, so a long subscription isn't held in memory.
    """
    # Spark says where a subscription begins, so keys of any kind, null included, compare as in a group.
    head = F.row_number().over(_window(order, by)) == 1
    keyed = df.withColumns({"_us": F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(1 << 62))), "_head": head})
    span = int(seconds * 1_000_000)
    schema = T.StructType([*df.schema.fields, T.StructField("_start", T.LongType()), T.StructField("_emitted", T.BooleanType())])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = None
        for batch in batches:
            us = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)).tolist()
            starts, emitted = np.zeros(len(us), np.int64), np.zeros(len(us), bool)
            cuts = sorted({0, *heads, len(us)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = us[a:b]
                if start is None or heads and a == heads[0] or a:
                    at = 0
                else:  # the subscription goes on from the batch before
                    at = int(np.searchsorted(own, start + span))
                    starts[a : a + at] = start
                while at < len(own):
                    start = int(own[at])
                    to = max(at + 1, int(np.searchsorted(own, start + span)))
                    starts[a + at : a + to] = start
                    emitted[a + at] = True
                    at = to
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(starts), pa.array(emitted)], names=schema.names)

    return keyed.mapInArrow(run, schema)


def throttle(df: DataFrame, seconds: float, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Emit an event, then drop others until ``seconds`` have passed."""
    return _scan(df, seconds, order, by, False).where("_emitted").drop("_start", "_emitted")


def buffer_time(df: DataFrame, seconds: float, order: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Add ``batch_start``: batches last ``seconds`` from their first event."""
    kind = df.schema[order].dataType
    marked = _scan(df, seconds, order, by, True)
    start = F.timestamp_micros("_start")
    start = start.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else start
    return marked.withColumn("batch_start", start).drop("_start", "_emitted")


def with_snapshot(snapshot: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The initial state followed by live events, without those it already holds."""
    return snapshot.unionByName(live, allowMissingColumns=True).dropDuplicates(list(keys))
