"""The total order over all values, in plain Python.

Null < false < true < numbers < strings < lists < maps < anything else.
Numbers compare as doubles, strings by UTF-8 bytes, lists element by element,
maps by their entries in key order.  Column expressions follow the same order;
this module states it, encodes nested values, and serves tests.
"""

from __future__ import annotations

import math
import struct
from decimal import Decimal
from typing import Any

NULL, FALSE, TRUE, NUMBER, STRING, LIST, MAP, OTHER = range(8)


def rank(value: Any) -> int:
    """The class of a value within the total order."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return TRUE if value else FALSE
    if isinstance(value, (int, float, Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (list, tuple)):
        return LIST
    if isinstance(value, dict):
        return MAP
    return OTHER


def _ordered_double(x: float) -> bytes:
    # Flip all bits of negatives and the sign of the others: bytes then sort as numbers do.
    bits = struct.unpack(">Q", struct.pack(">d", x))[0]
    bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
    return struct.pack(">Q", bits)


def encode(value: Any) -> bytes:
    """Bytes whose unsigned order is the total order."""
    kind = rank(value)
    tag = bytes([kind])
    if kind == NUMBER:
        return tag + _ordered_double(float(value))
    if kind == STRING:
        return tag + _terminated(value.encode())
    if kind == LIST:
        return tag + b"".join(b"\x01" + encode(v) for v in value) + b"\x00"
    if kind == MAP:
        entries = sorted((k.encode() if isinstance(k, str) else str(k).encode(), v) for k, v in value.items())
        return tag + b"".join(b"\x01" + _terminated(k) + encode(v) for k, v in entries) + b"\x00"
    if kind == OTHER:
        return tag + _terminated(str(value).encode())
    return tag


def _terminated(raw: bytes) -> bytes:
    return raw.replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def compare_values(a: Any, b: Any) -> int:
    """-1, 0 or 1 as ``a`` stands before, with or after ``b``."""
    x, y = encode(a), encode(b)
    return (x > y) - (x < y)


def values_equal(a: Any, b: Any) -> bool:
    return encode(a) == encode(b)


def extract_field(document: Any, path: str) -> Any:
    """The value at a dotted path through maps; missing is None."""
    value = document
    for part in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(part)
    return value


def prefix_upper_bound(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None if there is none."""
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            following = 0xE000 if last + 1 == 0xD800 else last + 1
            return "".join(map(chr, points)) + chr(following)
    return None


def is_storable(value: Any) -> bool:
    """Whether a value can stand inside a stored document."""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, (list, tuple)):
        return all(map(is_storable, value))
    if isinstance(value, dict):
        return all(isinstance(k, str) and is_storable(v) for k, v in value.items())
    return value is None or isinstance(value, (bool, int, str))
