"""Vectorised text kernels shared by the Arrow-based operators.

Everything here works on a whole Arrow batch at once: texts are joined into
one code unit array, and words, shingles and runs are found with array
arithmetic.  There is no per-word Python loop.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial prefix hash, and its inverse modulo 2**64.
PRIME = 0x9E3779B97F4A7C15
PRIME_INV = pow(PRIME, -1, 1 << 64)
#: Multiplier that combines the hashes of neighbouring words.
COMBINE = 0xC2B2AE3D27D4EB4F


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", PRIME), ("down", PRIME_INV)):
                steps = np.full(size, base & (2**64 - 1), U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def run_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``units[start:end]`` for each run, equal for equal runs.

    One prefix sum over the batch serves all runs: a run's hash is the
    difference of two prefix values, brought back to exponent zero with the
    inverse power of its start.
    """
    n = len(units)
    if not len(starts):
        return np.zeros(0, U64)
    up, down = POWERS.need(n + 1)
    spread = mix64(units.astype(U64) + U64(0x51ED270B))
    prefix = np.zeros(n + 1, U64)
    np.cumsum(spread * up[:n], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(U64) * U64(COMBINE))


#: The bytes that separate words: space and the controls 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of UTF-8 texts.

    ``buffer`` holds the texts' bytes with ``offsets``, as in an Arrow string
    array; ``doc``, ``start`` and ``end`` give each word's text number and its
    byte range in the buffer.  ``first`` has each text's first word number
    (and one more for the end).
    """

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        base, top = int(offsets[0]), int(offsets[-1])
        self.bytes = buffer[base:top]
        self.offsets = (offsets - base).astype(np.int64)
        if lower:
            self.bytes = _LOWER[self.bytes]
        n = len(self.bytes)
        inside = ~_SPACE[self.bytes]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            cuts = self.offsets[1:-1]
            cuts = cuts[cuts < n]
            begins[cuts] = inside[cuts]
        self.start = np.flatnonzero(begins)
        stops = np.flatnonzero(~inside)
        # A word ends at the next space, at the next text, or at the end.
        after = np.searchsorted(stops, self.start)
        ends = np.append(stops, n)[after]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.end = np.minimum(ends, self.offsets[self.doc + 1]) if n else ends
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.bytes, self.start, self.end)


def arrow_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows and the text number of each.

    A text with fewer than ``k`` words, but at least one, gives one window of
    all its words.  Windows never cross texts.
    """
    n, docs = len(words), len(first) - 1
    counts = np.diff(first)
    acc = np.zeros(n, U64)
    weight = 1
    for j in range(k):
        part = words[j:] * U64(weight)
        acc[: n - j if n > j else 0] += part
        weight = weight * COMBINE % 2**64
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    doc = np.repeat(np.arange(docs), per_doc)
    begin = np.concatenate([[0], np.cumsum(per_doc)])
    at = np.arange(len(doc)) - begin[doc] + first[doc]
    out = acc[at] if len(at) else np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:
        total, weight = 0, 1
        for w in words[first[d] : first[d + 1]].tolist():
            total = (total + w * weight) % 2**64
            weight = weight * COMBINE % 2**64
        out[begin[d]] = (total + 0xA5A5 + int(counts[d])) % 2**64
    return mix64(out), doc


def distinct_per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``values`` of each text, and each text's range in them.

    ``doc`` ascends.
    """
    values = values.copy()
    cuts = np.searchsorted(doc, np.arange(docs + 1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    if len(values):
        keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(docs + 1))
