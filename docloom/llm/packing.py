"""Best-fit packing of token sequences by a length histogram.

The plan is made over counts: how many pieces have each length.  It has at
most ``capacity`` kinds of lengths, so planning takes the same memory at any
corpus size.  Pieces then take planned slots by their rank within their
length.

Defined cases: a null or empty text is the end token alone; rows with equal
ids are packed each on their own; a null id is kept; an empty table gives no
rows; columns besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, ship, slices
from .tokens import WordTokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one length, by rank, in neighbouring sequences."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int
    per_sequence: int


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit decreasing over a histogram {length: count}; runs, sequences.

    Open sequences with the same free space form groups of consecutive
    numbers.  A step fills a whole group, or uses up a length, so the number
    of steps depends on the kinds of lengths and not on the counts.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left, rank = counts[length], 0
        fits = sorted((s for s in free if s >= length and free[s]), reverse=True)
        while left:
            while fits and not free.get(fits[-1]):
                fits.pop()
            if fits:
                space = fits[-1]
                first, n = free[space].pop()
            else:
                space, per = capacity, capacity // length
                first, n = sequences, -(-left // per)
                sequences += n
            per = space // length
            whole = min(n, left // per)
            if whole == 0:
                whole, per = 1, left
            runs.append(Run(length, rank, whole * per, first, capacity - space, per))
            rank += whole * per
            left -= whole * per
            if n > whole:
                free.setdefault(space, []).append((first + whole, n - whole))
                if space >= length and (not fits or fits[-1] != space):
                    fits.append(space)
                    fits.sort(reverse=True)
            rest = space - per * length
            if rest:
                free.setdefault(rest, []).append((first, whole))
                if rest >= length and rest not in fits:
                    fits.append(rest)
                    fits.sort(reverse=True)
    return runs, sequences


def token_pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0
) -> DataFrame:
    """Tokenize each text, append ``end_id``, cut what exceeds ``capacity``."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.cached(tokenizer_file)
        for batch in slices(batches, "text"):
            ids, first = tokenizer.encode(batch.column(1))
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            names = batch.column(0).to_pylist()
            for d, name in enumerate(names):
                own = np.append(ids[first[d] : first[d + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    for column, value in zip(rows, (name, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(tokenize, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, length and ids_crc32.

    A rank within a length is found without bringing one length to one task:
    rows are dealt to buckets by their hash, ranked within (length, bucket),
    and bucket counts are summed up over each length.
    """
    pieces = materialize(pieces, "pieces")
    total = pieces.count()
    buckets = max(32, -(-total // 20_000))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counted = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs, _ = plan_best_fit({int(r.length): int(r.n) for r in by_length}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("rank", F.row_number().over(within).cast("long"))
        .join(bases.hint("shuffle_hash"), ["length", "bucket"])
        .withColumn("rank", F.col("rank") - 1 + F.col("base"))
        .drop("base", "bucket")
    )
    runs = sorted(runs, key=lambda r: (r.length, r.rank))
    table = np.array([(r.length, r.rank, r.count, r.sequence, r.offset, r.per_sequence) for r in runs], np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44  # more pieces of one length than this don't occur
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            length = batch.column(at["length"]).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(at["rank"]).to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 5], run[:, 4] + nth % run[:, 5] * length
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[c]) for c in keep] + [pa.array(sequence), pa.array(offset)],
                names=[*keep, "sequence_id", "offset"],
            )

    kept = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokenize and pack a table of texts into sequences of ``capacity`` tokens."""
    packed = pack(token_pieces(docs, tokenizer_file, capacity, id_column, text_column), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
