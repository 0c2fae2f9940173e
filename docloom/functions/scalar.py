"""Scalar functions: fingerprints of keys, checksums, encryption."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version and cipher bytes that an encrypted value begins with.
ENVELOPE = bytes([1, 2])
ITERATIONS = 210_000


def redacted_key(key: Column) -> Column:
    """``key#<8 hex of its SHA-256>(len=n)``, n in UTF-16 units."""
    wide = F.octet_length(F.encode(key, "UTF-16BE")) / 2
    return F.concat(F.lit("key#"), F.left(F.sha2(key, 256), F.lit(8)), F.lit("(len="), wide.cast("int").cast("string"), F.lit(")"))


def redacted_value(value: Column) -> Column:
    """``value(len=n)``: nothing of the content."""
    return F.concat(F.lit("value(len="), F.octet_length(value.cast("string")).cast("string"), F.lit(")"))


def redact_key(key: str) -> str:
    """``redacted_key`` of a Python string."""
    return f"key#{hashlib.sha256(key.encode()).hexdigest()[:8]}(len={len(key.encode('utf-16-be')) // 2})"


def redact_value(value: object) -> str:
    """``value(len=n)`` of a Python value."""
    return f"value(len={len(str(value).encode())})"


def checksum(value: Column) -> Column:
    """CRC-32 of a binary or string value."""
    return F.crc32(value.cast("binary"))


def derive_key(password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> tuple[bytes, bytes]:
    """(key, salt): 32 bytes by PBKDF2 with HMAC-SHA-256."""
    salt = secrets.token_bytes(16) if salt is None else salt
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32), salt


def encrypted(value: Column, key: bytes) -> Column:
    """AES-256-GCM: envelope, 12-byte IV, ciphertext, 16-byte tag."""
    return F.concat(F.lit(bytearray(ENVELOPE)), F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM")))


def decrypted(value: Column, key: bytes) -> Column:
    """Inverse of ``encrypted``; a changed value or another key raises when evaluated."""
    body = F.substring(value, F.lit(len(ENVELOPE) + 1), F.octet_length(value))
    return F.aes_decrypt(body, F.lit(bytearray(key)), F.lit("GCM"))


def expiry(now: Column, ttl_seconds: float | None, expires_at: Column | None = None) -> Column:
    """``expires_at`` if given, else ``now`` plus the time to live, else null."""
    if expires_at is not None:
        return expires_at
    if ttl_seconds is None:
        return F.lit(None).cast("timestamp")
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))
