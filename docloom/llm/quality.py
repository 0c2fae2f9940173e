"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of byte n-grams and of a text's profile are scaled by the log
ratio of their frequencies in the two classes; a linear model with hinge loss
is fitted to them by dual coordinate descent; a logistic curve fitted on
rows that the model hasn't seen turns margins into scores.

Fitting takes a bounded sample of labelled rows (``sample`` of each class,
the smallest by a hash of the id), which is documented and a parameter.  A row
has at most 2**18 + 5 feature numbers on the driver, a text of 3,000
characters about 2,500.  Scoring reads every whole text.

Defined cases: a null text scores like an empty one; rows without a label
take no part in fitting; with labels of one class only, or none, every score
is that class's (1 without labels); repeated rows are scored alike; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship, slices, trim
from .textops import Words, arrow_buffers

BITS = 18
ORDERS = (1, 2, 3, 4)
PROFILE = 80
SIZE = (1 << BITS) + PROFILE


def _indices(data: np.ndarray) -> np.ndarray:
    """Feature numbers of all byte n-grams, orders in rows; the tail repeats."""
    n = len(data)
    code = np.zeros(n, np.uint32)
    out = np.zeros((len(ORDERS), n), np.int32)
    for j in range(max(ORDERS)):
        code[: n - j] |= data[j:].astype(np.uint32) << np.uint32(8 * j)
        if j + 1 in ORDERS:
            spread = (code ^ np.uint32(0x9E37 * (j + 1))) * np.uint32(2654435761)
            out[ORDERS.index(j + 1)] = (spread >> np.uint32(32 - BITS)).astype(np.int32)
    return out


def _profiles(words: Words) -> np.ndarray:
    """Five profile features of each text, as feature numbers."""
    docs = len(words.offsets) - 1
    data = words.bytes
    kinds = np.zeros((3, 256), np.int64)
    kinds[0, 65:91] = 1
    kinds[1, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
    kinds[2, 48:58] = 1
    at = words.offsets
    length = np.maximum(np.diff(at), 1)
    share = []
    for kind in kinds:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        share.append((total[at[1:]] - total[at[:-1]]) / length)
    hashed = words.hashes()
    distinct, again = np.ones(docs), np.zeros(docs)
    for d in range(docs):
        a, b = words.first[d], words.first[d + 1]
        if b > a:
            distinct[d] = len(np.unique(hashed[a:b])) / (b - a)
            again[d] = (hashed[a + 1 : b] == hashed[a : b - 1]).mean() if b - a > 1 else 0.0
    step = PROFILE // 5
    bucket = lambda x: np.minimum((x * step).astype(np.int64), step - 1)
    columns = [bucket(np.sqrt(share[0])), bucket(np.sqrt(share[1])), bucket(np.sqrt(share[2])), bucket(distinct), bucket(again)]
    return np.stack([(1 << BITS) + i * step + c for i, c in enumerate(columns)], 1)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text in turn."""
    buffer, offsets = arrow_buffers(column)
    words = Words(buffer, offsets, lower=False)
    profile = _profiles(words)
    grams = _indices(words.bytes)
    mark = np.zeros(1 << BITS, np.int32)
    for d in range(len(column)):
        a, b = int(words.offsets[d]), int(words.offsets[d + 1])
        own = [grams[i, a : b - order + 1] for i, order in enumerate(ORDERS) if b - order + 1 > a]
        if not own:
            yield profile[d]
            continue
        flat = np.concatenate(own)
        place = np.arange(len(flat), dtype=np.int32)
        mark[flat] = place  # of equal numbers the last one written stays
        yield np.concatenate([flat[mark[flat] == place], profile[d]])


@dataclass
class QualityModel:
    """Weights of the scaled indicators and the curve that gives scores."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, numbers: np.ndarray) -> float:
        scale = self.ratio[numbers]
        norm = float(np.sqrt(scale @ scale)) or 1.0
        return float(self.weight[numbers] @ scale) / norm + self.bias

    def score(self, numbers: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(numbers) + self.shift, -40, 40))))


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, prior: float, cost: float = 1.0, epochs: int = 12, mixing: float = 0.75) -> QualityModel:
    """Fit on distinct feature numbers and 0/1 labels; ``prior`` is the share of 1 among all labels."""
    if len(np.unique(labels)) < 2:
        flat = np.zeros(SIZE, np.float32)
        return QualityModel(flat, flat, 0.0, 0.0, 20.0 if labels.min(initial=1) else -20.0)
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held = set(order[: max(2, len(rows) // 5)].tolist())
    train = [i for i in range(len(rows)) if i not in held]
    if len({int(labels[i]) for i in train}) < 2:
        train = list(range(len(rows)))
    counts = np.ones((2, SIZE))
    for i in train:
        counts[int(labels[i])][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(labels > 0, 1.0, -1.0)
    # One flat array for all rows, which goes back whole when fitting ends.
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data = np.empty(begin[-1], np.float32)
    for i in train:
        x = ratio[rows[i]]
        data[begin[i] : begin[i + 1]] = x / (np.sqrt(x @ x) or 1.0)
    # Dual coordinate descent: one multiplier per row, kept within 0..cost.
    weight, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train).tolist():
            x, y = data[begin[i] : begin[i + 1]], sign[i]
            gradient = y * (weight[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)  # |x|^2 + 1 (the bias) = 2
            change = (new - alpha[i]) * y
            if change:
                weight[rows[i]] += change * x
                bias += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    # Between the fitted weights and their mean size, as naive Bayes would weigh.
    used = np.zeros(SIZE, bool)
    for i in train:
        used[rows[i]] = True
    smooth = np.zeros(SIZE)
    smooth[used] = np.abs(weight[used]).mean()
    weight = mixing * weight + (1 - mixing) * smooth
    model = QualityModel(ratio.astype(np.float32), weight.astype(np.float32), float(bias), 1.0, 0.0)
    fold = sorted(held) if held - set(train) else train
    model.slope, model.shift = _curve(np.array([model.margin(rows[i]) for i in fold]), labels[fold], prior)
    return model


def _curve(margins: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic curve by Newton steps, rows weighted to the labels' true shares."""
    ones = labels > 0
    if ones.all() or not ones.any():
        return 4.0, 0.0
    share = np.where(ones, prior / ones.mean(), (1 - prior) / (1 - ones.mean()))
    goal = np.where(ones, (ones.sum() + 1) / (ones.sum() + 2), 1 / ((~ones).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([2.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (goal - p)) - 1e-3 * beta
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(docs: DataFrame, labelled: DataFrame, sample: int = 3000) -> QualityModel:
    """Fit to (doc_id, label) rows of ``labelled``, at most ``sample`` of each class.

    The sampled ids, at most twice ``sample``, are broadcast to find their
    texts in one pass over ``docs`` (doc_id, text).
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = labelled.where("label is not null and doc_id is not null").select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = {}
    for value in counts:
        for r in labelled.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample).collect():
            picked[r.doc_id] = value
    if not picked:
        return fit([], np.zeros(0, np.int64), 1.0)
    ids = spark.createDataFrame(list(picked.items()), "doc_id long, label int")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            packed = [f.astype("<i4").tobytes() for f in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "label", "numbers"])

    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    found = own.mapInArrow(numbers, "doc_id long, label int, numbers binary").orderBy("doc_id").toArrow()
    rows = [np.frombuffer(b.as_buffer(), "<i4") for b in found.column("numbers")]
    labels = found.column("label").to_numpy()
    model = fit(rows, labels, counts.get(1, 0) / sum(counts.values()))
    del found, rows, picked, ids
    trim()
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every whole text of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = np.array([model.score(f) for f in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")


def fold(id_column: Column) -> Column:
    """The fold 0..3 of an id; fold 2 is held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def keep_good(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    ship(docs.sparkSession)
    schema = docs.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([model.score(f) >= least for f in features(column)], pa.bool_()))

    return docs.mapInArrow(judge, schema)
