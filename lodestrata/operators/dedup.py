"""Chunk identity, references, and statistics of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def file_chunks(nodes: DataFrame) -> DataFrame:
    """One row a reference: (snapshot_id, path, pos, chunk_hash)."""
    return nodes.where("node_type = 'file'").select("snapshot_id", "path", F.posexplode("chunk_hashes").alias("pos", "chunk_hash"))


def reference_counts(references: DataFrame) -> DataFrame:
    """(chunk_hash, occurrences, snapshots). Counts are derived from the references and never stored, so they can't go stale."""
    return references.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("snapshot_id").alias("snapshots"))


def release(counts: DataFrame, released: DataFrame) -> DataFrame:
    """Counts after releasing (chunk_hash, n): never below 0; ``unreferenced`` where nothing is left."""
    left = F.greatest(F.lit(0).cast("long"), F.col("occurrences") - F.coalesce("n", F.lit(0).cast("long")))
    return counts.join(released, "chunk_hash", "left").select("chunk_hash", left.alias("occurrences"), (left == 0).alias("unreferenced"))


def new_chunks(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """One row for each incoming hash that the index lacks."""
    return incoming.dropDuplicates(["chunk_hash"]).join(index.select("chunk_hash"), "chunk_hash", "left_anti")


def known_chunks(incoming: DataFrame, index: DataFrame) -> DataFrame:
    return incoming.join(index.select("chunk_hash"), "chunk_hash", "left_semi")


def backup_counters(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """One row: references, new and duplicate ones, raw bytes and bytes that have to be stored. First copies count as new."""
    seen = index.select("chunk_hash").withColumn("known", F.lit(True))
    by_hash = incoming.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.max("raw_size").alias("raw_size")).join(seen, "chunk_hash", "left")
    fresh = F.col("known").isNull()
    return by_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count(F.when(fresh, 1)).alias("new_chunks"),
        F.coalesce(F.sum(F.col("n") - fresh.cast("long")), F.lit(0)).alias("duplicate_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("raw_size")), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum(F.when(fresh, F.col("raw_size"))), F.lit(0)).alias("new_bytes"),
    )


def store_stats(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, raw and stored bytes, references, and the ratio of logical to physical bytes.

    ``dedup_ratio_compat`` is total size times references over stored size; it equals the number of
    references where nothing is compressed.
    """
    counted = references.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("refs"))
    rows = chunks.join(counted, "chunk_hash", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))
    total = rows.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("raw_size"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"),
        F.coalesce(F.sum(F.col("refs") * F.col("raw_size")), F.lit(0)).alias("logical_bytes"),
    )
    share = lambda top: F.when(F.col("stored_bytes") == 0, 0.0).otherwise(F.col(top).cast("double") / F.col("stored_bytes"))
    return total.withColumns(
        {
            "dedup_ratio_compat": F.when(F.col("stored_bytes") == 0, 0.0).otherwise(F.col("raw_bytes").cast("double") * F.col("refs") / F.col("stored_bytes")),
            "dedup_ratio": share("logical_bytes"),
            "saved_bytes": F.col("logical_bytes") - F.col("stored_bytes"),
        }
    )


def snapshot_totals(nodes: DataFrame) -> DataFrame:
    """Per snapshot: total_size, total_chunks, files; symbolic links and directories don't count."""
    is_file = F.col("node_type") == "file"
    return nodes.groupBy("snapshot_id").agg(
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum(F.when(is_file, F.size("chunk_hashes"))), F.lit(0)).cast("long").alias("total_chunks"),
        F.count(F.when(is_file, 1)).alias("files"),
    )
