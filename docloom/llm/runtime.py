"""Shared plumbing: scratch tables, batch slicing, connected components.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which a
cluster shares between the driver and all executors.  Reading one back cuts
the lineage, and it survives the loss of any executor.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode, where none is configured."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="docloom-"))
    return f"{base.rstrip('/')}/docloom-{app}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark's own file server hands the archive to each executor.  Workers then
    import modules, so that what they cache lasts for more than one task.
    Arrow batches of whole texts are large, so a session that has Spark's
    default for their rows gets fewer.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "4000")
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in stored:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted: Spark does that once the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results read after this fail."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give a worker's freed memory back: workers are kept, and one stage's peak would stay beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes each.

    A single longer text comes alone.  This bounds a worker's memory by the
    longest text and not by the number of rows in a batch.
    """
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        data = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch, data, offsets
        trim()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Distributed union-find: (node, component), the smallest node reachable.

    ``edges`` has columns a and b of one orderable type.  Large-star and
    small-star rounds alternate until all edges are stars; each round is a
    grouped minimum and a join over the edges, so no group of neighbours is
    ever collected.  Nodes without edges don't appear.  Null ends are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stored = False
    while True:
        # Large star: larger neighbours of x go to x's smallest neighbour, or to x itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours of x, and x itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        if stored:
            discard(old)
        stored = True
        # Stars: a node points to one smaller node at most, and nothing points to a node that does.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        if ends.groupBy("x").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 or o > 0 and i > 0").isEmpty():
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def components_within(edges: DataFrame, name: str = "components", most: int = 500_000) -> DataFrame:
    """The same for stored edges (a, b) of longs: by one task's union-find if there are at most ``most``.

    The bound is checked by a count; more edges go the distributed way.  Both
    give the same result.
    """
    if edges.count() > most:
        return connected_components(edges, name)
    ship(edges.sparkSession)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        columns = [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    one = edges.where("a <> b").select("a", "b").coalesce(1)
    return materialize(one.mapInArrow(unite, "node long, component long"), name)
