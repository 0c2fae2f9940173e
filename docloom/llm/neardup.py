"""Near-duplicate documents by one-permutation MinHash.

1. A document's set is its distinct word shingles, as 64-bit hashes.  Equal
   sets form a class, represented by the smallest id; only representatives
   go on.
2. One permutation gives one minimum per bin; an empty bin borrows from a bin
   that its own fixed random order names first (optimal densification).
   Bands of bins are bucket keys.
3. Members of a bucket are linked over a star, verified on full sets, and what
   a star can miss is compared in blocks; connected components follow (see
   ``linkage``).

Defined cases: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text with fewer words than a shingle has the
whole sequence as its one shingle; repeated rows of one id are one node; a
null id is linked with nothing and kept; an empty table gives no rows;
further columns are not read.  A batch is cut at about 1 MB of text, so a
longer text comes alone, and a block holds one set at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linkage
from .runtime import components_within, materialize, ship, slices
from .textops import Words, arrow_buffers, distinct_per_doc, mix64, window_hashes

BINS = 128
ROWS = 5
BANDS = BINS // ROWS

_rng = np.random.default_rng(20240229)
#: For each bin, the order in which it asks other bins when it is empty.
_ASK = np.argsort(_rng.random((BINS, BINS)), axis=1)
_U = np.uint64


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, and their ranges."""
    words = Words(*arrow_buffers(column))
    values, doc = window_hashes(words.hashes(), words.first, k)
    return distinct_per_doc(values, doc, len(column))


def densified(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """One-permutation signatures, a row of BINS minima per text.

    Texts with an empty set have a row of zeros.
    """
    docs = len(ranges) - 1
    doc = np.repeat(np.arange(docs), np.diff(ranges))
    bins = (values >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])
    signature = np.zeros((docs, BINS), np.uint64)
    has = np.zeros((docs, BINS), bool)
    signature[doc[first], bins[first]] = values[first]
    has[doc[first], bins[first]] = True
    row, empty = np.nonzero(~has & (np.diff(ranges) > 0)[:, None])
    for step in range(BINS):
        if not len(row):
            break
        asked = _ASK[empty, step]
        found = has[row, asked]
        signature[row[found], empty[found]] = signature[row[found], asked[found]]
        row, empty = row[~found], empty[~found]
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mix64(acc ^ signature[:, b * ROWS + r]) + _U(r)
        keys[:, b] = acc
    return keys


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, bands): set size, 128-bit set hash, keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, ranges = shingle_sets(batch.column(1), k)
            size = np.diff(ranges)
            sums = []
            for salt in (1, 2):
                total = np.concatenate([[_U(0)], np.cumsum(mix64(values * _U(salt) + _U(salt)), dtype=np.uint64)])
                sums.append(mix64(total[ranges[1:]] - total[ranges[:-1]] + size.astype(np.uint64)).view(np.int64))
            keys = band_keys(densified(values, ranges)).view(np.int64)[size > 0]
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), bands],
                names=["doc_id", "n_shingles", "hi", "lo", "bands"],
            )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct hashes of a text, as bytes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, ranges = shingle_sets(batch.column(1), k)
            data = values.astype("<u8").tobytes()
            cut = (ranges * 8).tolist()
            sets = pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["doc_id", "shingles"])

    return docs.mapInArrow(build, "doc_id long, shingles binary")


def stored_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets back from what ``full_sets`` stored."""
    cuts = np.cumsum([0, *(len(v.as_py()) // 8 for v in column)])
    return np.frombuffer(b"".join(v.as_py() for v in column), "<u8"), cuts


def near_duplicates(
    docs: DataFrame, percent: int = 80, k: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Linked are documents whose sets of ``k``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; a component's id is its smallest
    document's, which is the one kept.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = materialize(signatures(docs, k), "near-signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    least = usable.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    classes = materialize(least.select("hi", "lo", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")), "near-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = wanted.select(F.col("rep").alias("doc_id"))
        own = full_sets(docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), k).dropDuplicates(["doc_id"])
        return own.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("payload"))

    keys = classes.select("rep", F.explode("bands").alias("key"))
    parts = linkage.linked(keys, sets_of, stored_sets, percent, "near", components_within)

    named = classes.select("hi", "lo", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands").join(named, ["hi", "lo"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", own)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each component."""
    gone = near_duplicates(docs, percent, k).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
