"""Verification, repair planning, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_quick(index: DataFrame, packs: DataFrame) -> DataFrame:
    """(chunk_hash, status): ``missing`` where the chunk's pack isn't there. No payload is read."""
    there = packs.select("pack_id").distinct().withColumn("there", F.lit(True))
    return index.join(there, "pack_id", "left").select("chunk_hash", F.when(F.col("there"), "ok").otherwise("missing").alias("status"))


def verify_full(index: DataFrame, data: DataFrame, payload: Column | None = None) -> DataFrame:
    """(chunk_hash, status): ok, missing or corrupt; ``payload`` gives a chunk's raw bytes from a row of ``data``."""
    hashed = data.select("chunk_hash", F.sha2((payload if payload is not None else F.col("stored")).cast("binary"), 256).alias("found"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("found") == F.col("chunk_hash"), "ok").otherwise("corrupt")
    return index.select("chunk_hash").join(hashed, "chunk_hash", "left").select("chunk_hash", status.alias("status"))


def sample(index: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct chunks, the same for the same seed."""
    return index.select("chunk_hash").distinct().orderBy(F.xxhash64(F.lit(seed), "chunk_hash"), "chunk_hash").limit(n)


def summary(statuses: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return statuses.agg(F.count(F.lit(1)).alias("checked"), count("ok"), count("missing"), count("corrupt"), F.count(F.when(F.col("status") != "ok", 1)).alias("bad"))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(done.cast("double") * 100 / total)


def broken_files(references: DataFrame, bad: DataFrame) -> DataFrame:
    """(snapshot_id, path, bad_chunks) of files that refer to a bad chunk."""
    return references.join(bad.select("chunk_hash").distinct(), "chunk_hash").groupBy("snapshot_id", "path").agg(F.countDistinct("chunk_hash").alias("bad_chunks"))


def wrong_file_hashes(nodes: DataFrame, references: DataFrame, bad: DataFrame) -> DataFrame:
    """Files whose stored hash isn't that of their chunk list, without files that a bad chunk explains."""
    found = F.sha2(F.array_join("chunk_hashes", "").cast("binary"), 256)
    wrong = nodes.where("node_type = 'file'").where(found != F.col("file_hash"))
    return wrong.join(broken_files(references, bad), ["snapshot_id", "path"], "left_anti").select("snapshot_id", "path")


def repair_plan(members: DataFrame, bad: DataFrame, parity: int) -> DataFrame:
    """Per parity group with bad members: how many, and whether they can be at most ``parity``."""
    marked = members.join(bad.select("chunk_hash").distinct().withColumn("bad", F.lit(1)), "chunk_hash", "left")
    groups = marked.groupBy("group_no").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    return groups.where("bad > 0").withColumn("repairable", F.col("bad") <= parity)


def restore(references: DataFrame, data: DataFrame, payload: str = "data") -> DataFrame:
    """(snapshot_id, path, content, missing): chunks put together in order, each byte copied once. ``data`` has one row for each hash.

    A file is one value, so of 2 GB at most; ``Repository.restore`` streams files of any size.
    """
    parts = references.join(data.select("chunk_hash", F.col(payload).alias("__ls_part")), "chunk_hash", "left")
    joined = F.expr("listagg(coalesce(__ls_part, X'')) WITHIN GROUP (ORDER BY pos)")
    return parts.groupBy("snapshot_id", "path").agg(joined.alias("content"), F.count(F.when(F.col("__ls_part").isNull(), 1)).alias("missing"))


def scrub(statuses: DataFrame, repairs: DataFrame, total: int | None = None) -> DataFrame:
    """One row on verified chunks (chunk_hash, status) and their repairs (chunk_hash, repaired): checked, ok, repaired, lost, percent of ``total`` (all by default)."""
    fixed = F.coalesce("repaired", F.lit(False))
    counted = statuses.join(repairs, "chunk_hash", "left").agg(
        F.count(F.lit(1)).alias("checked"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok"), F.count(F.when((F.col("status") != "ok") & fixed, 1)).alias("repaired"), F.count(F.when((F.col("status") != "ok") & ~fixed, 1)).alias("lost")
    )
    return counted.withColumn("percent", percent_done(F.col("checked"), F.lit(total) if total is not None else F.col("checked")))


def restore_counters(nodes: DataFrame, wanted: Column) -> DataFrame:
    """One row of a dry run: files and bytes that would be restored, files skipped by the filter."""
    files = nodes.where("node_type = 'file'")
    return files.agg(F.count(F.when(wanted, 1)).alias("restored"), F.count(F.when(~wanted, 1)).alias("skipped"), F.coalesce(F.sum(F.when(wanted, F.col("size"))), F.lit(0)).alias("bytes"))
