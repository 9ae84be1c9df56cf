"""Compression frames (zstd) and the encryption envelope (AES-256-GCM)."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LEVELS = range(1, 23)
MOST_RAW = 256 << 20


def frame(data: bytes, level: int = 3) -> bytes:
    """Original size (uint32, little-endian) and the compressed bytes."""
    if level not in LEVELS:
        raise ValueError("the level must be 1 to 22")
    return struct.pack("<I", len(data)) + zstandard.ZstdCompressor(level=level).compress(data)


def unframe(data: bytes) -> bytes:
    if len(data) < 4:
        raise ValueError("frame too short")
    (size,) = struct.unpack_from("<I", data)
    if size > MOST_RAW:
        raise ValueError("frame too large")
    raw = zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=max(1, size))
    if len(raw) != size:
        raise ValueError("frame size differs")
    return raw


def compress(column: Column, level: int = 3) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else frame(bytes(v), level))

    return run(column)


def decompress(column: Column, strict: bool = True) -> Column:
    """The raw bytes of frames; a broken frame raises, or gives null if not ``strict``."""

    def one(v):
        if v is None:
            return None
        try:
            return unframe(bytes(v))
        except (ValueError, zstandard.ZstdError):
            if strict:
                raise
            return None

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(column)


def ratio(raw: Column, stored: Column) -> Column:
    """Stored bytes over raw bytes; 0 for empty input."""
    return F.when(F.octet_length(raw) == 0, 0.0).otherwise(F.octet_length(stored) / F.octet_length(raw))


NONCE = 12


def secret(spark: SparkSession, value: bytes) -> Column:
    """``value`` as a column that workers fill in, so that plans and event logs don't hold it."""
    shared = spark.sparkContext.broadcast(value)

    @F.pandas_udf("binary")
    def run(n: pd.Series) -> pd.Series:
        return pd.Series([shared.value] * len(n))

    return run(F.lit(0))


def keyed_nonce(spark: SparkSession, column: Column, key: bytes) -> Column:
    """A nonce from HMAC-SHA-256 of the key over the bytes' hash: it repeats only with equal bytes, and a task run again gives the same."""
    shared = spark.sparkContext.broadcast(key)

    @F.pandas_udf("binary")
    def run(digest: pd.Series) -> pd.Series:
        return digest.map(lambda v: None if v is None else hmac.digest(shared.value, bytes(v), "sha256")[:NONCE])

    return run(F.unhex(F.sha2(column.cast("binary"), 256)))


def encrypt(column: Column, key: Column, nonce: Column | None = None) -> Column:
    """Nonce length (uint32, little-endian), nonce, ciphertext and tag. Without ``nonce`` each call draws one."""
    args = [column.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")] + ([nonce] if nonce is not None else [])
    return F.concat(F.lit(struct.pack("<I", NONCE)), F.aes_encrypt(*args))


def decrypt(column: Column, key: Column) -> Column:
    """Null for a wrong key, changed bytes or another nonce length."""
    good = (F.octet_length(column) >= 4 + NONCE + 16) & (F.substring(column, 1, 4) == F.lit(struct.pack("<I", NONCE)))
    return F.when(good, F.try_aes_decrypt(F.substring(column, 5, 1 << 30), key, F.lit("GCM"), F.lit("DEFAULT")))


def new_key_file(password: str, salt: bytes | None = None) -> str:
    """Key parameters as JSON, on the driver. The key itself is never stored, only its hash."""
    salt = salt or secrets.token_bytes(32)
    if len(salt) != 32:
        raise ValueError("the salt must have 32 bytes")
    key = derive_key(password, salt)
    return json.dumps({"kdf": "scrypt-n15-r8-p1", "salt": salt.hex(), "key_sha256": hashlib.sha256(key).hexdigest()})


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 15, r=8, p=1, maxmem=1 << 26, dklen=32)


def open_key_file(text: str, password: str) -> bytes:
    stored = json.loads(text)
    key = derive_key(password, bytes.fromhex(stored["salt"]))
    if not hmac.compare_digest(hashlib.sha256(key).hexdigest(), stored["key_sha256"]):
        raise ValueError("wrong password")
    return key
