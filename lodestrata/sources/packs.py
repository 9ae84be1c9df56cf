"""Pack files: chunks laid end to end in one binary value, with a checksum.

A pack table has one row for each pack, (pack_id, content); ``read_packs`` makes one from a folder and
``export_packs`` writes one as files. Checksums and reads at a known place are SQL functions over
``content``; only the walk over all entries and the writer use Python workers, one pack at a time.

Cases: null or short content, a wrong magic or version and a broken entry are reported, never raised;
an empty table gives an empty one; entries of one hash in several packs are all listed.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators.packing import ENTRY, FOOTER, HEADER

# Fixed values of the pack format: magic, version, and the bytes that open an entry and end the entries.
MAGIC, VERSION, ENTRY_MARK, END_MARK = b"BKSP", 1, 1, 0
HASH = 64
NAME = r"pack-(\d{6,})\.pack$"

LISTING = "pack_id long, chunk_hash string, pack_offset long, stored_size long, error string"


def encode_pack(pack_id: int, entries: list[tuple[str, bytes]]) -> bytes:
    parts = [MAGIC, struct.pack("<HQ", VERSION, pack_id)]
    for digest, stored in entries:
        if len(digest) != HASH:
            raise ValueError(f"not a digest: {digest!r}")
        parts += [struct.pack("<B64sI", ENTRY_MARK, digest.encode("ascii"), len(stored)), stored]
    body = b"".join([*parts, bytes([END_MARK])])
    return body + hashlib.sha256(body).digest()


def walk_pack(content: bytes) -> Iterator[tuple[str, int, int]]:
    """(chunk_hash, offset, size) of every entry; payloads are stepped over."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a pack")
    if struct.unpack_from("<H", content, len(MAGIC))[0] != VERSION:
        raise ValueError("unknown pack version")
    at, end = HEADER, len(content) - FOOTER
    while at < end:
        mark, digest, size = struct.unpack_from("<B64sI", content, at)
        if mark != ENTRY_MARK or at + ENTRY + size > end:
            raise ValueError(f"broken entry at {at}")
        yield digest.decode("ascii"), at, size
        at += ENTRY + size
    if at != end or content[end] != END_MARK:
        raise ValueError("no end of entries")


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(pack_id, content) of the pack files in a folder; other names are passed over."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "pack-*.pack").load(folder)
    return found.where(F.col("path").rlike(NAME)).select(F.regexp_extract("path", NAME, 1).cast("long").alias("pack_id"), "content")


def list_pack_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The pack ids of a folder; contents aren't read. The greatest is ``agg(max)`` of it."""
    return read_packs(spark, folder).select("pack_id").orderBy("pack_id")


def build_packs(placed: DataFrame) -> DataFrame:
    """Packs from chunks (pack_id, pack_offset, chunk_hash, stored). A pack's size is bounded by the layout, so one task holds one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pack_offset")
        entries = [(h, bytes(s)) for h, s in zip(rows["chunk_hash"], rows["stored"], strict=True)]
        pack_id = int(rows["pack_id"].iloc[0])
        return pd.DataFrame({"pack_id": [pack_id], "content": [encode_pack(pack_id, entries)]})

    return placed.select(F.col("pack_id").cast("long").alias("pack_id"), "pack_offset", "chunk_hash", "stored").groupBy("pack_id").applyInPandas(run, "pack_id long, content binary")


def list_chunks(packs: DataFrame) -> DataFrame:
    """(pack_id, chunk_hash, pack_offset, stored_size, error): one row an entry, and one with ``error`` where a pack breaks off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pack_id, content in zip(batch["pack_id"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for digest, at, size in walk_pack(bytes(content) if content is not None else b""):
                        rows.append((pack_id, digest, at, size, None))
                except (ValueError, struct.error) as e:
                    rows.append((pack_id, None, None, None, str(e)))
                out = pd.DataFrame(rows, columns=["pack_id", "chunk_hash", "pack_offset", "stored_size", "error"])
                yield out.astype({"pack_offset": "Int64", "stored_size": "Int64"})

    return packs.select("pack_id", "content").mapInPandas(run, LISTING)


def _little(content: Column, at: Column) -> Column:
    """Four bytes from ``at`` (counted from 0) as an unsigned number."""
    digits = F.concat(*[F.hex(F.substring(content, at + F.lit(k + 1), F.lit(1))) for k in (3, 2, 1, 0)])
    return F.conv(digits, 16, 10).cast("long")


def verify_packs(packs: DataFrame) -> DataFrame:
    """(pack_id, status): ok, short, not a pack, or corrupt where the last 32 bytes aren't the hash of the rest."""
    size = F.octet_length("content")
    body = F.substring("content", F.lit(1), size - 32)
    status = (
        F.when(F.col("content").isNull() | (size < HEADER + FOOTER), "short")
        .when(F.substring("content", F.lit(1), F.lit(len(MAGIC))) != F.lit(MAGIC), "not a pack")
        .when(F.sha2(body, 256) != F.lower(F.hex(F.substring("content", size - 31, F.lit(32)))), "corrupt")
        .otherwise("ok")
    )
    return packs.select("pack_id", status.alias("status"))


def read_chunks(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_hash, pack_id, stored, status) of ``wanted`` (chunk_hash, pack_id, pack_offset): a read at each place.

    The places of a pack are gathered first (a pack bounds them), so each pack joins once. ``status`` is missing
    without the pack, and misplaced if no entry of that hash is at the place; what is read isn't hashed here.
    """
    places = wanted.groupBy("pack_id").agg(F.collect_list(F.struct("chunk_hash", F.col("pack_offset").cast("int").alias("at"))).alias("places"))
    joined = places.join(packs.select("pack_id", "content"), "pack_id", "left")
    content, none = F.col("content"), F.lit(None).cast("binary")

    def entry(p: Column) -> Column:
        at, digest = p["at"], F.encode(p["chunk_hash"], "UTF-8")
        size = _little(content, at + F.lit(1 + HASH))
        here = (F.substring(content, at + F.lit(1), F.lit(1)) == F.lit(bytes([ENTRY_MARK]))) & (F.substring(content, at + F.lit(2), F.lit(HASH)) == digest)
        here = here & (at + F.lit(ENTRY) + size <= F.octet_length(content) - F.lit(FOOTER))
        status = F.when(content.isNull(), "missing").when(F.coalesce(here, F.lit(False)), "ok").otherwise("misplaced")
        stored = F.when(F.coalesce(here, F.lit(False)), F.substring(content, at + F.lit(ENTRY + 1), size.cast("int"))).otherwise(none)
        return F.struct(p["chunk_hash"].alias("chunk_hash"), stored.alias("stored"), status.alias("status"))

    return joined.select("pack_id", F.explode(F.transform("places", entry)).alias("e")).select("e.chunk_hash", "pack_id", "e.stored", "e.status")


def export_packs(packs: DataFrame, folder: str) -> DataFrame:
    """Writes each pack to ``folder``, a path that every worker has mounted: (pack_id, file, bytes).

    A file gets its name only when it is whole and on disk, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for pack_id, name, content in zip(batch["pack_id"], batch["name"], batch["content"], strict=True):
                write_whole(os.path.join(folder, name), [bytes(content)])
                done.append((pack_id, name, len(content)))
            yield pd.DataFrame(done, columns=["pack_id", "file", "bytes"])

    return packs.select("pack_id", text.pack_name(F.col("pack_id")).alias("name"), "content").mapInPandas(run, "pack_id long, file string, bytes long")


def write_whole(path: str, parts) -> int:
    """Writes the parts to a file that appears under its name at once; returns the bytes."""
    import secrets

    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{secrets.token_hex(6)}.tmp"
    size = 0
    try:
        with open(part, "wb") as f:
            for p in parts:
                size += f.write(p)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise
    return size
