"""Versions, parent chains, snapshot differences and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of ``current`` (path, size, modified) with ``reused`` and the chunks of the equal file before.

    Only metadata is joined; content is read afterwards for those that aren't reused. Times are compared in
    microseconds on both sides.
    """
    before = previous.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("chunk_hashes").alias("old_chunks"))
    same = F.coalesce((F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified")), F.lit(False))
    joined = current.join(before, "path", "left")
    return joined.withColumns({"reused": same, "chunk_hashes": F.when(same, F.col("old_chunks")), "has_version": F.col("old_size").isNotNull() & ~same}).drop("old_size", "old_modified", "old_chunks")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or same, by file_hash."""
    a, b = old.select("path", F.col("file_hash").alias("h_old")), new.select("path", F.col("file_hash").alias("h_new"))
    change = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") == F.col("h_new"), "same").otherwise("modified")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def directories(paths: DataFrame) -> DataFrame:
    """Every directory above the given paths: (path, depth)."""
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(heads).alias("path")).where("path <> ''").distinct().select("path", F.size(F.split("path", "/")).alias("depth"))


def merge(previous: DataFrame, upserts: DataFrame, deleted: DataFrame) -> DataFrame:
    """``previous`` nodes after upserts (same columns) and deletions (path): a deleted directory takes what is below it.

    Directories that the upserts need and that aren't there are added, with null in other columns.
    """
    columns = previous.columns
    gone = deleted.select("path")
    ancestors = previous.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("above"))
    below = ancestors.join(gone.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    kept = previous.join(below, "path", "left_anti").join(upserts.select("path"), "path", "left_anti")
    files = kept.select(*columns).unionByName(upserts.select(*columns))
    needed = directories(upserts.select("path")).join(files.select("path"), "path", "left_anti")
    added = needed.select(*[F.col("path") if c == "path" else F.lit("dir").alias(c) if c == "node_type" else F.lit(None).cast(previous.schema[c].dataType).alias(c) for c in columns])
    return files.unionByName(added)


def versions(nodes: DataFrame) -> DataFrame:
    """Each file's versions in time: version number, and the hash and snapshot before; equal neighbours are one version."""
    w = Window.partitionBy("path").orderBy("ts", "snapshot_id")
    changed = F.lag("file_hash").over(w).isNull() | (F.lag("file_hash").over(w) != F.col("file_hash"))
    first = nodes.withColumn("changed", changed).where("changed").drop("changed")
    return first.withColumns({"version": F.row_number().over(w), "previous_snapshot_id": F.lag("snapshot_id").over(w)})


def chain(snapshots: DataFrame, start) -> DataFrame:
    """The parents of snapshot ``start``: (snapshot_id, depth, parent_missing), in a number of steps that grows with the logarithm of the chain.

    Each step doubles every snapshot's pointer, so a chain of 100,000 takes 17 joins. A parent that was
    deleted ends the chain and is flagged; a cycle ends it where it closes. Steps go on until none finds another parent.
    """
    from lodestrata.store import cut

    ids = snapshots.select("snapshot_id", "parent_snapshot_id")
    known = ids.select(F.col("snapshot_id").alias("parent_snapshot_id"), F.lit(True).alias("known"))
    jumps = ids.join(known, "parent_snapshot_id", "left").where("known").select("snapshot_id", F.col("parent_snapshot_id").alias("to"))
    found = ids.where(F.col("snapshot_id") == F.lit(start)).select("snapshot_id", F.lit(0).cast("long").alias("depth"))
    reach = 1
    while True:
        step = found.join(jumps, "snapshot_id").select(F.col("to").alias("snapshot_id"), (F.col("depth") + reach).alias("depth"))
        more = found.unionAll(step).groupBy("snapshot_id").agg(F.min("depth").alias("depth"))
        before, found = found, cut(more)
        if found.count() == before.count():
            break
        jumps = cut(jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.snapshot_id")).select(F.col("a.snapshot_id").alias("snapshot_id"), F.col("b.to").alias("to")))
        reach *= 2
    out = found.join(ids, "snapshot_id").join(known, "parent_snapshot_id", "left")
    return out.select("snapshot_id", "depth", (F.col("parent_snapshot_id").isNotNull() & F.col("known").isNull()).alias("parent_missing"))


def resolve(snapshots: DataFrame, wanted: str) -> DataFrame:
    """The snapshot that a query names: ``latest``, else the oldest whose id begins with it, else the oldest with it as tag."""
    if wanted == "latest":
        return snapshots.orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(1)
    by_id = F.col("snapshot_id").cast("string").startswith(wanted)
    by_tag = F.array_contains("tags", wanted)
    return snapshots.where(by_id | by_tag).orderBy(F.when(by_id, 0).otherwise(1), "ts", "snapshot_id").limit(1)
