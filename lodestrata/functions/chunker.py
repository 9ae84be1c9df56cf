"""Content-defined chunking with a cyclic rolling hash, vectorised.

The hash at a place depends on the 32 bytes that end there (for any place from the 32nd on), so all
boundary candidates come from shifted table look-ups; one pass over the candidates applies
the length limits. With a minimum below the window the plain loop is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 32
# Fixed values of the rolling hash: its table is seeded by xorshift64 from this number.
SEED = 0x0123456789ABCDEF


@lru_cache
def table(seed: int = SEED) -> np.ndarray:
    out, x = [], seed
    for _ in range(256):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        out.append(x & 0xFFFFFFFF)
    return np.array(out, np.uint32)


def mask_for(target: int) -> int:
    """One less than the power of two below the target; an exact power gives half of itself."""
    return (1 << ((target - 1).bit_length() - 1)) - 1 if target > 1 else 0


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    by %= 32
    return x if by == 0 else (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def boundaries(data: bytes, least: int, target: int, most: int) -> np.ndarray:
    """Ends of the chunks of ``data``."""
    if not 0 < least < most or not least <= target <= most:
        raise ValueError("chunk sizes must satisfy 0 < min < max and min <= target <= max")
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    if least < WINDOW:
        return _slow_boundaries(data, least, target, most)
    mask = np.uint32(mask_for(target))
    values = table()[np.frombuffer(data, np.uint8)]
    padded = np.concatenate([np.full(WINDOW - 1, table()[0], np.uint32), values])
    state = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        state ^= _turn(padded[WINDOW - 1 - k : WINDOW - 1 - k + n], k)
    candidates = np.flatnonzero((state & mask) == mask) + 1
    ends, at = [], 0
    while at < n:
        k = np.searchsorted(candidates, at + least)
        end = int(candidates[k]) if k < len(candidates) else n
        at = min(end, at + most, n)
        ends.append(at)
    return np.array(ends, np.int64)


def _slow_boundaries(data: bytes, least: int, target: int, most: int) -> np.ndarray:
    """Byte by byte, for minimum sizes in which a chunk's first window, all zeros, still shows."""
    words, mask = [int(x) for x in table()], mask_for(target)
    spin = lambda x, by: ((x << by) | (x >> (32 - by))) & 0xFFFFFFFF
    ends, start, state, recent = [], 0, 0, [0] * WINDOW
    for i, byte in enumerate(data):
        state = spin(state ^ spin(words[recent[i % WINDOW]], 31), 1) ^ words[byte]
        recent[i % WINDOW] = byte
        length = i + 1 - start
        if length >= most or (length >= least and state & mask == mask):
            ends.append(i + 1)
            start, state, recent = i + 1, 0, [0] * WINDOW
    if start < len(data):
        ends.append(len(data))
    return np.array(ends, np.int64)


def chunk_files(files: DataFrame, key: str, content: str, least: int = 64 << 10, target: int = 512 << 10, most: int = 8 << 20, payload: bool = False) -> DataFrame:
    """(key, pos, start, length, chunk_hash) of every file, with the chunk's bytes as ``data`` if ``payload``; a worker holds one batch of files."""
    kind = files.schema[key].dataType.simpleString()
    names = [key, "pos", "start", "length", "chunk_hash"] + ["data"] * payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch[key], batch[content], strict=True):
                data = b"" if data is None else data.encode() if isinstance(data, str) else bytes(data)
                start = 0
                for pos, end in enumerate(boundaries(data, least, target, most).tolist()):
                    part = data[start:end]
                    rows.append((name, pos, start, end - start, hashlib.sha256(part).hexdigest()) + ((part,) if payload else ()))
                    start = end
                if payload:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, pos int, start long, length long, chunk_hash string" + ", data binary" * payload)
