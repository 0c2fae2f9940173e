"""Links between items that share MinHash buckets, verified on full sets.

Items are rows (rep, payload): a payload is whatever a worker makes an item's
shingle set from, such as the set's bytes or a text.  Bucket keys come as rows
(rep, key).

1. Keys of one item only go.
2. In a bucket, edges form a star around one centre: the member with the most
   bucket mates over all its keys, an original rather than an edited copy.
3. Edges are verified on full sets, and connected components follow.
4. What a star can miss is a link between members of different components.
   Buckets of two members can't miss any.  In larger ones the members outside
   the bucket's largest component are compared with all its members, in blocks
   of bounded rows and bytes; a block returns links between components only.

So no pair of a bucket that isn't in one component already stays unverified,
no pair is a row, and no group is collected: the largest thing in a task is a
block, or one item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import connected_components, discard, materialize, ship, trim

#: Rows, and bytes of payload, of either side of a block, about.
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Pairs of a block up to which sets are met one by one.
PAIRS = 256
#: Columns of the shingle matrices that are multiplied at once.
WIDTH = 4096

#: Sorted distinct hashes of each payload, and each one's range in them.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Components = Callable[[DataFrame, str], DataFrame]


def bucket_members(keys: DataFrame, name: str) -> DataFrame:
    """(key, rep) of keys that more than one item has, stored; rows may repeat.

    One shuffle, and one sort by a single number.  A bucket is streamed, never
    collected: what is known of it is its key, its first item, and whether
    there has been another.  So a hot bucket costs its task time but no memory.
    """
    ship(keys.sparkSession)

    def beside(x: np.ndarray) -> np.ndarray:
        """Whether a value equals its neighbour."""
        out = np.zeros(len(x), bool)
        same = x[1:] == x[:-1]
        out[1:] |= same
        out[:-1] |= same
        return out

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The bucket that the last batch ended in: key, first item, whether it is out already.
        last: tuple[int, int, bool] | None = None
        for batch in batches:
            key, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            goes_on = last is not None and key[0] == last[0]
            if goes_on and not last[2]:
                key, rep = np.append(last[0], key), np.append(last[1], rep)
            some = beside(key)
            if goes_on and last[2]:
                some |= key == last[0]
            # Few rows are left: those of keys that stand twice.
            at = np.flatnonzero(some)
            at = at[np.lexsort((rep[at], key[at]))]
            k, r = key[at], rep[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            k, r = k[fresh], r[fresh]
            keep = beside(k)
            if goes_on and last[2]:
                keep |= k == last[0]
            end = int(key[-1])
            out = bool(len(k) and k[keep].size and k[keep][-1] == end) or goes_on and last[2] and end == last[0]
            last = (end, int(rep[-1]), out)
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(r[keep])], names=["key", "rep"])
        trim()

    dealt = keys.select("key", "rep").repartition("key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(shared, "key long, rep long"), name)


def popularity(members: DataFrame) -> DataFrame:
    """(rep, popularity): the number of bucket mates over all keys."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    return members.join(sizes, "key").groupBy("rep").agg(F.sum("n").alias("popularity"))


def star_pairs(members: DataFrame, popular: DataFrame) -> DataFrame:
    """Distinct (rep, centre): each member with the most popular one of its bucket, the smallest if tied."""
    weighed = members.join(popular, "rep")
    centre = weighed.groupBy("key").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("least"))).alias("c"))
    met = members.join(centre.select("key", (-F.col("c.least")).alias("centre")), "key")
    return met.where("rep <> centre").select("rep", "centre").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def verified(pairs: DataFrame, items: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """(a, b) of those pairs (rep, centre) whose sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch, ("x", "y")):
                xs, xr = sets_of(part.column(2))
                # A centre often stands in many rows that follow each other.
                centres = part.column(3).dictionary_encode()
                ys, yr = sets_of(centres.dictionary)
                keep = np.zeros(part.num_rows, bool)
                for i, c in enumerate(centres.indices.to_numpy()):
                    x, y = xs[xr[i] : xr[i + 1]], ys[yr[c] : yr[c + 1]]
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    if not small or 100 * small < percent * large:
                        continue
                    both = _common(x, y)
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select(["rep", "centre"]).filter(pa.array(keep))

    mine = items.select("rep", F.col("payload").alias("x"))
    theirs = items.select(F.col("rep").alias("centre"), F.col("payload").alias("y"))
    met = pairs.join(mine, "rep").join(theirs, "centre").select("rep", "centre", "x", "y")
    return met.mapInArrow(compare, "rep long, centre long").select(F.col("rep").alias("a"), F.col("centre").alias("b"))


def _bounded(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the columns hold about 512 kB, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    total = sum(pc.binary_length(batch.column(batch.schema.get_field_index(c))).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(total)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), side="right")))
        yield batch.slice(at, to - at)
        at = to
    del batch, total
    trim()


def unresolved(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(rep, key, component, main, n): members of buckets of three or more with more than one component."""
    known = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    weights = known.groupBy("key", "component").agg(F.count("*").alias("w"))
    main = weights.groupBy("key").agg(F.max(F.struct("w", "component")).alias("m"), F.sum("w").alias("n"), F.count("*").alias("parts"))
    main = main.where("parts > 1 and n > 2").select("key", F.col("m.component").alias("main"), "n")
    return known.join(main, "key")


def _similar_across(values: np.ndarray, ranges: np.ndarray, own: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in ``own`` and ``other``, numbers of sets, of similar sets."""
    size = np.diff(ranges)
    x, y = size[own], size[other]
    if len(own) * len(other) <= PAIRS:
        left, right = np.nonzero((100 * np.minimum.outer(x, y) >= percent * np.maximum.outer(x, y)) & (np.minimum.outer(x, y) > 0))
        good = np.zeros(len(left), bool)
        for n, (i, j) in enumerate(zip(left, right, strict=True)):
            a, b = own[i], other[j]
            both = _common(values[ranges[a] : ranges[a + 1]], values[ranges[b] : ranges[b + 1]])
            good[n] = 100 * both >= percent * (x[i] + y[j] - both)
        return left[good], right[good]
    number = np.concatenate([own, other])
    flat = np.concatenate([values[ranges[n] : ranges[n + 1]] for n in number])
    row = np.repeat(np.arange(len(number)), size[number])
    # Only shingles that both sides have count.
    _, column = np.unique(flat, return_inverse=True)
    left = row < len(own)
    seen = np.zeros((2, int(column.max(initial=-1)) + 1), bool)
    seen[0, column[left]] = True
    seen[1, column[~left]] = True
    shared = seen[0] & seen[1]
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = min(WIDTH, int(shared.sum()))
    both = np.zeros((len(own), len(other)), np.float32)
    for begin in range(0, int(shared.sum()), max(width, 1)):
        a, b = np.searchsorted(column, (begin, begin + width))
        matrix = np.zeros((len(number), width), np.float32)
        matrix[row[a:b], column[a:b] - begin] = 1
        both += matrix[: len(own)] @ matrix[len(own) :].T
    return np.nonzero((100 * both >= percent * (x[:, None] + y[None, :] - both)) & (both > 0))


def across(left: DataFrame, items: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """(a, b): components that hold similar members of one bucket.

    Members outside their bucket's largest component meet all members.  Both
    sides are dealt to blocks, and each pair of blocks is a group of its own.
    """
    met = left.join(items, "rep").withColumn("bytes", F.octet_length("payload").cast("long"))
    asks = F.col("component") != F.col("main")
    sizes = met.groupBy("key").agg(
        F.sum("bytes").alias("bx"), F.sum(F.when(asks, F.col("bytes")).otherwise(0)).alias("by"), F.sum(asks.cast("long")).alias("others")
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    met = met.join(sizes, "key").withColumns({"x": blocks("n", "bx"), "y": blocks("others", "by")})
    place, every = F.xxhash64("rep"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    common = ["component", "payload"]
    all_ = met.select("key", F.pmod(place, "x").cast("int").alias("i"), F.explode(every("y")).alias("j"), F.lit(False).alias("asks"), *common)
    some = met.where(asks).select("key", F.explode(every("x")).alias("i"), F.pmod(place, "y").cast("int").alias("j"), F.lit(True).alias("asks"), *common)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, 3):
            asking = block.column(3).to_numpy(zero_copy_only=False)
            component = block.column(4).to_numpy()
            keys = np.stack([block.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))).tolist() + [block.num_rows]
            values, ranges = sets_of(block.column(5))
            found = [np.zeros((0, 2), np.int64)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, other = a + np.flatnonzero(asking[a:b]), a + np.flatnonzero(~asking[a:b])
                if len(own) and len(other):
                    i, j = _similar_across(values, ranges, own, other, percent)
                    ends = np.stack([component[own[i]], component[other[j]]], 1)
                    found.append(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1))
            ends = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    every_block = all_.unionByName(some).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return every_block.mapInArrow(compare, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], n: int, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that agree in the first ``n`` columns and follow each other, several in one batch of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < limit:
            continue
        whole = joined()
        keys = np.stack([whole.column(i).to_numpy() for i in range(n)])
        begins = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if len(begins):
            yield whole.slice(0, int(begins[-1]))
            held = [whole.slice(int(begins[-1]))]
        else:
            held = [whole]
    if held:
        yield joined()
    del held
    trim()


def linked(
    keys: DataFrame,
    items_of: Callable[[DataFrame], DataFrame],
    sets_of: Sets,
    percent: int,
    name: str,
    components: Components = connected_components,
) -> DataFrame:
    """(node, component) of every item with a link, component its smallest item.

    ``items_of`` gives the rows (rep, payload) of the items in its argument
    (rep), each once.
    """
    members = bucket_members(keys, f"{name}-members")
    popular = materialize(popularity(members), f"{name}-popular")
    items = materialize(items_of(popular.select("rep")), f"{name}-items")
    parts = resolved(
        members, popular, lambda pairs: verified(pairs, items, sets_of, percent), lambda left: materialize(across(left, items, sets_of, percent), f"{name}-across"), name, components
    )
    discard(members, items)
    return parts


def resolved(
    members: DataFrame,
    popular: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    meet: Callable[[DataFrame], DataFrame],
    name: str,
    components: Components = connected_components,
) -> DataFrame:
    """``linked`` from stored members and their popularity, which goes.

    ``verify`` gives the links (a, b) of pairs (rep, centre); ``meet`` stores
    the components (a, b) that similar members of an unresolved bucket join.
    """
    links = materialize(verify(star_pairs(members, popular)), f"{name}-links")
    discard(popular)
    parts = components(links, name)
    discard(links)
    left = materialize(unresolved(members, parts), f"{name}-left")
    if not left.isEmpty():
        found = meet(left)
        if not found.isEmpty():
            joined = components(found, name).select(F.col("node").alias("component"), F.col("component").alias("whole"))
            # A component whose items are links among themselves already, or a single item.
            every = parts.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
            every = every.distinct().join(joined, "component", "left")
            parts = materialize(every.select("node", F.coalesce("whole", "component").alias("component")), f"{name}-parts")
    discard(left)
    return parts
