"""Reed-Solomon parity over GF(256), with table look-ups over whole shards.

The parity rows are powers (alpha^(i*j), i from k on) below an identity block. Such a code can't
be solved from every choice of k survivors, so the rows are chosen by rank.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

POLYNOMIAL = 0x11D


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of 2, logarithms, and the 256 x 256 product table."""
    power, x = np.zeros(255, np.int64), 1
    for k in range(255):
        power[k] = x
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    log = np.zeros(256, np.int64)
    log[power] = np.arange(255)
    product = power[(log[:, None] + log[None, :]) % 255].astype(np.uint8)
    product[0, :] = product[:, 0] = 0
    return power, log, product


def mul(a: int, b: int) -> int:
    return int(tables()[2][a, b])


def inv(a: int) -> int:
    if a == 0:
        raise ZeroDivisionError("0 has no inverse")
    power, log, _ = tables()
    return int(power[-log[a] % 255])


def matrix(data: int, parity: int) -> np.ndarray:
    if data < 1 or parity < 1 or data + parity > 256:
        raise ValueError("shards must be positive and 256 in all at most")
    power = tables()[0]
    rows, columns = np.arange(data, data + parity)[:, None], np.arange(data)[None, :]
    return np.concatenate([np.eye(data, dtype=np.uint8), power[rows * columns % 255].astype(np.uint8)])


def product(m: np.ndarray, shards: np.ndarray) -> np.ndarray:
    table = tables()[2]
    out = np.zeros((len(m), shards.shape[1]), np.uint8)
    for r, row in enumerate(m):
        for c in np.flatnonzero(row):
            out[r] ^= table[row[c]][shards[c]]
    return out


def encode(shards: np.ndarray, parity: int) -> np.ndarray:
    return product(matrix(len(shards), parity)[len(shards) :], shards)


def solve(rows: list[int], data: int, parity: int) -> tuple[list[int], np.ndarray] | None:
    """``data`` of the given rows that are independent, and the inverse of their matrix; None if there are too few."""
    full, table = matrix(data, parity), tables()[2]
    work = np.zeros((data, 2 * data), np.uint8)
    chosen: list[int] = []
    pivots: list[int] = []
    for r in rows:
        line = np.zeros(2 * data, np.uint8)
        line[:data] = full[r]
        line[data + len(chosen)] = 1
        for k, p in enumerate(pivots):
            if line[p]:
                line ^= table[line[p]][work[k]]
        nonzero = np.flatnonzero(line[:data])
        if not len(nonzero):
            continue
        p = int(nonzero[0])
        line = table[inv(int(line[p]))][line]
        for k in range(len(pivots)):
            if work[k, p]:
                work[k] ^= table[work[k, p]][line]
        work[len(chosen)] = line
        chosen.append(r)
        pivots.append(p)
        if len(chosen) == data:
            return chosen, work[np.argsort(pivots), data:]
    return None


def reconstruct(shards: list[bytes | None], data: int, parity: int) -> list[bytes]:
    """All data shards; an error names patterns that can't be solved."""
    have = [k for k, s in enumerate(shards) if s is not None]
    if all(shards[k] is not None for k in range(data)):
        return [bytes(s) for s in shards[:data]]
    found = solve(have, data, parity) if len(have) >= data else None
    if found is None:
        raise ValueError(f"not solvable from shards {have}")
    rows, inverse = found
    known = np.stack([np.frombuffer(shards[r], np.uint8) for r in rows])
    lost = [k for k in range(data) if shards[k] is None]
    fixed = dict(zip(lost, product(inverse[lost], known), strict=True))
    return [fixed[k].tobytes() if k in fixed else bytes(shards[k]) for k in range(data)]


def add_parity(members: DataFrame, data: int, parity: int) -> DataFrame:
    """(group_no, pos, is_parity, shard_len, shard) for members (group_no, pos, payload): padded with zeros to the longest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = max(1, max(len(p) for p in rows["payload"]))
        held = np.zeros((data, size), np.uint8)
        for k, p in enumerate(rows["payload"]):
            held[k, : len(p)] = np.frombuffer(bytes(p), np.uint8)
        extra = encode(held, parity)
        group = rows["group_no"].iloc[0]
        out = [(group, k, False, size, held[k].tobytes()) for k in range(data)] + [(group, data + k, True, size, extra[k].tobytes()) for k in range(parity)]
        return pd.DataFrame(out, columns=["group_no", "pos", "is_parity", "shard_len", "shard"])

    return members.select("group_no", "pos", "payload").groupBy("group_no").applyInPandas(run, "group_no long, pos int, is_parity boolean, shard_len long, shard binary")


def repair(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """(group_no, pos, shard, solved) for groups with lost data shards, whose shard is null. A group has data + parity rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: list[bytes | None] = [None] * (data + parity)
        for pos, shard in zip(rows["pos"], rows["shard"], strict=True):
            held[pos] = None if shard is None else bytes(shard)
        lost = [k for k in range(data) if held[k] is None]
        group = rows["group_no"].iloc[0]
        try:
            whole = reconstruct(held, data, parity)
            out = [(group, k, whole[k], True) for k in lost]
        except ValueError:
            out = [(group, k, None, False) for k in lost]
        return pd.DataFrame(out, columns=["group_no", "pos", "shard", "solved"])

    return shards.select("group_no", "pos", "shard").groupBy("group_no").applyInPandas(run, "group_no long, pos int, shard binary, solved boolean")
