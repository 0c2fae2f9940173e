import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.streaming import batch, live

T0 = datetime(2024, 1, 1)


def events(spark, pairs):
    rows = [(k, T0 + timedelta(milliseconds=ms), ms) for k, ms in pairs]
    return spark.createDataFrame(rows, "key string, ts timestamp, ms long")


def keys(df):
    return [r.key for r in df.orderBy("ms").collect()]


def test_debounce_throttle_take_skip(spark):
    df = events(spark, [("a", 0), ("b", 5), ("c", 10)])
    quiet = F.expr("INTERVAL '0.030' SECOND")
    assert keys(batch.debounce(df, quiet)) == ["c"]
    df = events(spark, [("a", 0), ("b", 10), ("c", 90)])
    assert keys(batch.throttle(df, 0.05)) == ["a", "c"] and keys(batch.debounce(df, quiet)) == ["b", "c"]
    df = events(spark, [(k, i) for i, k in enumerate("abcd")])
    assert keys(batch.skip(df, 2)) == ["c", "d"] and keys(batch.take(df, 2)) == ["a", "b"] and keys(batch.take(df, 0)) == []


def test_distinct_is_consecutive(spark):
    df = events(spark, [(k, i) for i, k in enumerate("aabba")])
    assert keys(batch.distinct(df, "key")) == ["a", "b", "a"]
    many = events(spark, [("xy"[i // 3 % 2], i) for i in range(600)])
    assert len(keys(batch.distinct(many, "key"))) == 200


def test_buffers(spark):
    df = events(spark, [(k, i) for i, k in enumerate("abc")])
    assert [[e.key for e in r.events] for r in batch.buffer(df, 2).orderBy("batch").collect()] == [["a", "b"], ["c"]]
    timed = batch.buffer_time(events(spark, [("a", 0), ("b", 5), ("c", 30), ("d", 59)]), 0.03)
    sizes = [r.n for r in timed.groupBy("batch_start").agg(F.count("*").alias("n")).orderBy("batch_start").collect()]
    assert sizes == [2, 2]
    many = batch.positions(events(spark, [("k", i) for i in range(999)]), "ts", "n")
    assert [r.n for r in many.orderBy("ms").collect()] == list(range(999))


@pytest.mark.parametrize("kind", ["throttle", "take", "skip", "distinct", "buffer", "buffer_time"])
def test_streaming_agrees_with_batch(spark, tmp_path, kind):
    pairs = [(f"k{i % 3}", i * 7) for i in range(60)]
    df = events(spark, pairs).withColumn("type", F.when(F.col("ms") % 4 == 0, "x").otherwise("y"))
    for n in range(2):  # two micro-batches, in order
        df.where(F.col("ms") < 200 if n == 0 else F.col("ms") >= 200).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    schema = df.schema
    forms = {
        "throttle": (lambda d: live.throttle(d, 0.05, ["key"]), lambda d: batch.throttle(d, 0.05, by=["key"])),
        "take": (lambda d: live.take(d, 4, ["key"]), lambda d: batch.take(d, 4, by=["key"])),
        "skip": (lambda d: live.skip(d, 4, ["key"]), lambda d: batch.skip(d, 4, by=["key"])),
        "distinct": (lambda d: live.distinct(d, "type", ["key"]), lambda d: batch.distinct(d, "type", by=["key"])),
        "buffer": (lambda d: live.buffer(d, 4, ["key"]), lambda d: batch.numbered(d, 4, by=["key"])),
        "buffer_time": (lambda d: live.buffer_time(d, 0.05, ["key"]), lambda d: batch.buffer_time(d, 0.05, by=["key"])),
    }
    got = []
    hub = live.Hub()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = forms[kind][0](stream)
    hub.listen(made, lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "ck")).awaitTermination()
    assert sorted(got) == sorted(map(tuple, forms[kind][1](df).select(*made.columns).collect()))
    hub.close()


def test_null_keys_are_one_subscription(spark):
    rows = [(None, T0 + timedelta(seconds=i), i) for i in range(4)] + [(2**53 + 1, T0, 10), (2**53 + 2, T0, 11)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, ms long")
    assert sorted(r.ms for r in batch.throttle(df, 10, by=["key"]).collect()) == [0, 10, 11]
    assert sorted((r.ms, r.batch_start.second) for r in batch.buffer_time(df, 2, by=["key"]).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (10, 0), (11, 0)]


@pytest.mark.parametrize("n", [1, 7, 10_000])
def test_throttle_against_a_loop(spark, n):
    import random

    random.seed(n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    try:
        pairs = [(random.choice("abc"), ms) for ms in random.sample(range(4000), 300)]
        last, want = {}, []
        for k, ms in sorted(pairs, key=lambda p: p[1]):
            if k not in last or ms - last[k] >= 100:
                last[k] = ms
                want.append(ms)
        got = batch.throttle(events(spark, pairs), 0.1, by=["key"])
        assert [r.ms for r in got.orderBy("ms").collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_live_distinct_tells_null_from_text_and_debounce_looks_at_times(spark, tmp_path):
    values = ["None", None, None, "a", "a", None]
    df = spark.createDataFrame([("k", T0 + timedelta(seconds=i), i, v) for i, v in enumerate(values)], "key string, ts timestamp, ms long, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    pairs = [("a", 0), ("a", 10), ("a", 500), ("b", 0), ("b", 600), ("b", 620), ("b", 1500)]
    events(spark, pairs).coalesce(1).write.parquet(str(tmp_path / "in2"))
    read = lambda name, d: spark.readStream.schema(d.schema).parquet(str(tmp_path / name))
    hub, got, quiet = live.Hub(), [], []
    hub.listen(live.distinct(read("in", df), "v", ["key"]), lambda b, _: got.extend(r.ms for r in b.collect())).awaitTermination()
    assert sorted(got) == [0, 1, 3, 5]
    # Timers run as long as the query does, so it is stopped once the last event has been flushed.
    want = {(r.key, r.ms) for r in batch.debounce(events(spark, pairs), F.expr("INTERVAL '0.3' SECOND"), by=["key"]).collect()}
    stream = live.debounce(read("in2", events(spark, pairs)), 0.3, ["key"])
    query = hub.listen(stream, lambda b, _: quiet.extend((r.key, r.ms) for r in b.collect()), trigger={"processingTime": "300 milliseconds"})
    for _ in range(120):
        if set(quiet) >= want or not query.isActive:
            break
        time.sleep(0.5)
    hub.close()
    assert sorted(quiet) == sorted(want) and want == {("a", 10), ("a", 500), ("b", 0), ("b", 620), ("b", 1500)}
