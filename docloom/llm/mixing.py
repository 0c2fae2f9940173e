"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1.  Its integral is
the source's weight, which sets its target; its running integral is the
source's cumulative demand, and inverting that gives each document its
training position.  Documents are then range-sorted by position.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; documents of size 0 are taken 0 words; rows with equal ids
are mixed each on its own, and so are those without an id; an empty table
gives no rows; more than ``MOST_SOURCES`` sources are an error.  Reruns agree: the order within a source is a hash of the id,
and of the text where ids are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, partitions

#: Weight over time as knots (time, weight), linear between them, from 0 to 1.
Schedule = Sequence[tuple[float, float]]

#: Sources that a mix takes at most; each has a row on the driver.
MOST_SOURCES = 100_000

WORDS = r"[^\x20\x09-\x0D]+"

#: Schedules of the default curriculum, whose integrals are 1, 2 and 3.
DEFAULT_SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
    ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)),
)


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: float) -> list[float]:
    """Share all sizes by weight; a target stops at ``repeats`` times its size.

    What is above the stop is shared again by weight among the others, until
    none is above.
    """
    out = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if weights[i] > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
        left -= sum(out[i] for i in over)
    return out


def mix(
    docs: DataFrame,
    schedule_of: Callable[[int], Schedule] | None = None,
    repeats: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: its source's target and the words the mix takes.

    Columns: doc_id, source, size, source_size, target, copies (whole
    repeats), taken, position (of its first copy, null if none), and those in
    ``keep``.  ``schedule_of`` maps a source's number, by code point order, to
    its schedule.  A source is taken in whole passes and a last partial one,
    which stops at the document nearest to its target.
    """
    schedule_of = schedule_of or (lambda n: DEFAULT_SCHEDULES[n % 3])
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_column).alias("text_hash"),
        *keep,
    )
    rows = materialize(rows, "mix-sizes")
    spark = docs.sparkSession
    total = rows.count()
    buckets = max(64, -(-total // 20_000))
    rows = rows.withColumn("u", F.xxhash64("doc_id", "text_hash", F.lit(17))).withColumn("bucket", F.pmod("u", F.lit(buckets)))
    counted = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    # One row per source on the driver: schedules are given per source there.
    found = counted.groupBy("source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"there are over {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    schedules = [schedule_of(i) for i in range(len(found))]
    goal = targets([int(r.words) for r in found], [integral(s) for s in schedules], repeats)
    table = [
        (r.source, int(r.words), float(g), [float(t) for t, _ in s], [float(w) for _, w in s])
        for r, g, s in zip(found, goal, schedules, strict=True)
    ]
    sources = spark.createDataFrame(
        table, "source string, source_size long, target double, knots array<double>, heights array<double>"
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    bases = bases.join(sources, bases.source.eqNullSafe(sources.source)).drop(sources.source)
    within = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size", "text_hash", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    b = bases.alias("b")
    placed = placed.join(
        b, F.expr("r.source <=> b.source and r.bucket = b.bucket")
    ).selectExpr("r.doc_id", "r.source", "r.size", "b.source_size", "b.target", "r.inner + b.base as begins", "b.knots", "b.heights", *[f"r.`{c}`" for c in keep])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("begins") + F.col("size") / 2 <= rest)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + extra.cast("long")).otherwise(F.lit(0)).cast("int"))
    placed = placed.withColumn("taken", F.col("size") * F.col("copies"))
    placed = placed.withColumn("position", F.when(F.col("copies") > 0, _position(F.lit(0))))
    return placed


def _position(copy):
    """Training time at which the source's cumulative demand reaches a copy.

    The schedule's running integral is quadratic between knots; the segment is
    found in the array of its values at the knots and solved in closed form.
    """
    copy = copy.cast("double")
    share = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("begins")) / F.greatest(F.col("target"), F.lit(1.0)))
    areas = F.expr(
        "transform(sequence(0, size(knots) - 1), k -> aggregate(sequence(0, k), 0.0D, (a, j) -> a + "
        "if(j = 0, 0.0D, (knots[j] - knots[j - 1]) * (heights[j] + heights[j - 1]) / 2)))"
    )
    packed = F.struct(share.alias("share"), areas.alias("areas"), F.col("knots").alias("knots"), F.col("heights").alias("heights"))
    solved = F.transform(
        F.array(packed),
        lambda p: _solve(p),
    )
    return solved[0]


def _solve(p):
    demand = p["share"] * F.element_at(p["areas"], -1)
    # The last knot whose area isn't above the demand, but not the very last knot.
    at = F.least(F.size(F.filter(p["areas"], lambda a: a <= demand)), F.size(p["areas"]) - 1) - 1
    t0, t1 = F.get(p["knots"], at), F.get(p["knots"], at + 1)
    w0, w1 = F.get(p["heights"], at), F.get(p["heights"], at + 1)
    above = F.greatest(demand - F.get(p["areas"], at), F.lit(0.0))
    slope = (w1 - w0) / (t1 - t0)
    root = F.sqrt(F.greatest(w0 * w0 + F.lit(2.0) * slope * above, F.lit(0.0)))
    return F.least(F.when(above > 0, t0 + F.lit(2.0) * above / (w0 + root)).otherwise(t0), F.lit(1.0))


def schedule_copies(plan: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per copy taken, with its position: (doc_id, copy, position, size), and those in ``keep``."""
    each = plan.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    return each.withColumn("position", _position(F.col("copy"))).select("doc_id", "copy", "position", "size", *keep)


def range_sorted(rows: DataFrame, *columns: str) -> DataFrame:
    """Globally sort by range partitions, without one task that sees all rows."""
    return rows.repartitionByRange(partitions(rows.sparkSession), *columns).sortWithinPartitions(*columns)


def mixed_documents(docs: DataFrame, schedule_of: Callable[[int], Schedule] | None = None, repeats: int = 3) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it, sorted by training position."""
    # Ids may be null or repeated, so rows are known by a key that is stored with them.
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct("*").alias("document"))
    keyed = materialize(keyed, "mix-documents")
    plan = mix(keyed.select("row_key", "document.doc_id", "document.text", "document.source"), schedule_of, repeats, keep=["row_key"])
    copies = schedule_copies(plan, keep=["row_key"]).select("row_key", "doc_id", "copy", "position")
    met = keyed.join(copies, "row_key")
    return range_sorted(met, "position", "doc_id", "copy", "row_key").select("document.*")
