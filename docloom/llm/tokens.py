"""Exact tokenizer output at the speed of a table lookup.

A word-level byte-pair tokenizer maps each pre-token to ids on its own, so
each distinct word is tokenized once by the library and then looked up.
Words are found and hashed with array arithmetic over a batch of texts.
Texts with anything that acts across words (characters outside the plain set
below, special tokens) are given to the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from .textops import run_hashes

_NEVER = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER, WHOLE = range(5)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000; WHOLE sends a text to the library.

    Plain are assigned characters that neither normalisation form C changes
    nor lower-casing turns into more than one character, except the Greek
    capital sigma, whose lower case depends on its place.
    """
    table = np.full(0x3000, WHOLE, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cn" or kind[0] == "M" or cp == 0x3A3 or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
            continue
        if kind[0] == "C" and c not in "\t\n\x0b\x0c\r":
            continue
        if 0x1100 <= cp < 0x1200:  # jamo compose with their neighbours
            continue
        table[cp] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else SPACE if c.isspace() else OTHER
    return table


class WordTokenizer:
    """Batch encoder over a ``tokenizers`` file of the word-end kind."""

    _cache: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, words: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = words
        self.classes = _classes()
        model = json.loads(self.library.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # Byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last_ids = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int32)
        self.clear()

    @classmethod
    def cached(cls, path: str) -> WordTokenizer:
        """One tokenizer, with its words, per worker process."""
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merging of many words at once, one merge per word and round.

        ``symbols`` holds a word per row.  Each round merges every word's
        best-ranked pair, the leftmost of equals, and ranks only the two pairs
        that changed.
        """

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a.astype(np.int64) << 20 | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

        width = symbols.shape[1]
        sizes = sizes.copy()
        ranks = rank(symbols[:, :-1], symbols[:, 1:])
        ranks[np.arange(width - 1) >= sizes[:, None] - 1] = _NEVER
        places, active = np.arange(width), np.arange(len(symbols))
        own, own_ranks, own_sizes = symbols, ranks, sizes
        while len(active):
            best = own_ranks.argmin(1)
            row = np.arange(len(active))
            lowest = own_ranks[row, best]
            going = lowest < _NEVER
            if not going.all():
                symbols[active[~going]], sizes[active[~going]] = own[~going], own_sizes[~going]
                active, own, own_ranks, own_sizes = active[going], own[going], own_ranks[going], own_sizes[going]
                best, lowest, row = best[going], lowest[going], np.arange(len(active))
                if not len(active):
                    break
            own[row, best] = self.merged[lowest]
            take = np.minimum(places + (places > best[:, None]), width - 1)
            own = np.take_along_axis(own, take, 1)
            own_ranks = np.take_along_axis(np.pad(own_ranks, ((0, 0), (0, 1)), constant_values=_NEVER), take, 1)[:, :-1]
            own_sizes = own_sizes - 1
            for left in (best - 1, best):
                valid = (left >= 0) & (left + 1 < own_sizes)
                r, c = row[valid], left[valid]
                own_ranks[r, c] = rank(own[r, c], own[r, c + 1])
            own_ranks[row, np.minimum(own_sizes - 1, width - 2)] = _NEVER
        return symbols, sizes

    def _tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        coded = [None if "'" in w else w.lower().encode() for w in words]
        length = np.array([0 if c is None else len(c) for c in coded])
        parts: list[np.ndarray | None] = [None] * len(words)
        count = np.zeros(len(words), np.int64)
        low = 0
        for high in (6, 10, 16, 28):
            pick = np.flatnonzero((length > low) & (length <= high))
            low = high
            if not len(pick):
                continue
            size = length[pick]
            symbols = np.zeros((len(pick), high), np.int32)
            inside = np.arange(high) < size[:, None]
            raw = np.frombuffer(b"".join(coded[i] for i in pick), np.uint8)
            symbols[inside] = self.byte_ids[raw]
            symbols[np.arange(len(pick)), size - 1] = self.last_ids[raw[np.cumsum(size) - 1]]
            symbols, size = self._merge(symbols, size)
            count[pick] = size
            for i, ids, n in zip(pick.tolist(), symbols, size.tolist(), strict=True):
                parts[i] = ids[:n]
        for i in np.flatnonzero((length == 0) | (length > low)):  # contractions, and very long words
            parts[i] = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.int32)
            count[i] = len(parts[i])
        return np.concatenate(parts).astype(np.uint32), count

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Tokenize new words and merge them, sorted by key, into the table."""
        ids, count = self._tokenize(words)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.count = np.insert(self.count, place, count)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one more for the end)."""
        texts = ["" if t is None else t for t in column.to_pylist()]
        joined = "\n".join(texts) + "\n"
        units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        kinds = self.classes[np.minimum(units, 0x2FFF)]
        kinds[units >= 0x3000] = WHOLE
        odd = np.add.reduceat(kinds == WHOLE, bounds[:-1]) > 0
        for d in np.flatnonzero(np.add.reduceat((units[:-1] == 60) & (units[1:] == 124), np.minimum(bounds[:-1], len(units) - 2)) > 0) if len(units) > 1 else ():
            odd[d] = True  # "<|" may begin a special token
        kinds[kinds == WHOLE] = SPACE
        begins = np.ones(len(units), bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        begins &= kinds != SPACE
        start = np.flatnonzero(begins)
        # A lone apostrophe before a letter may begin a contraction: one run with the letters after it.
        lone = np.flatnonzero(units[start] == 39)
        if len(lone):
            lone = lone[(lone + 1 < len(start))]
            after = start[np.minimum(lone + 1, len(start) - 1)]
            lone = lone[(after == start[lone] + 1) & (kinds[after] == LETTER)]
            before = start[lone] - 1
            lone = lone[(before < 0) | (kinds[np.maximum(before, 0)] != OTHER)]
            start = np.delete(start, lone + 1)
        gaps = np.flatnonzero(kinds == SPACE)
        end = gaps[np.searchsorted(gaps, start)]
        if len(start):
            end[:-1] = np.minimum(end[:-1], start[1:])
        doc = np.searchsorted(bounds, start, side="right") - 1
        plain = ~odd[doc]
        start, end, doc = start[plain], end[plain], doc[plain]
        key, place, inverse = np.unique(run_hashes(units, start, end), return_index=True, return_inverse=True)
        hit = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        if len(self.keys):
            new = self.keys[np.minimum(hit, len(self.keys) - 1)] != key
        if new.any():
            if len(self.keys) + int(new.sum()) > self.words:
                self.clear()
                new[:] = True
            p = place[new]
            self._learn(key[new], [joined[a:b] for a, b in zip(start[p].tolist(), end[p].tolist(), strict=True)])
            hit = np.searchsorted(self.keys, key)
        count, at = self.count[hit][inverse], self.at[hit][inverse]
        whole = {int(d): np.array(self.library.encode(texts[d], add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(odd)}
        per_doc = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        flat_at = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        ids = self.ids[flat_at]
        first = np.concatenate([[0], np.cumsum(per_doc)])
        if whole:
            parts = [whole.get(d, ids[first[d] : first[d + 1]]) for d in range(len(texts))]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first
