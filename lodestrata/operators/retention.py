"""Which snapshots stay, which chunks are live, and what compaction frees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention(snapshots: DataFrame, daily: int, weekly: int, monthly: int, iso_year: bool = False) -> DataFrame:
    """``snapshots`` (snapshot_id, ts, ...) with the rank in each calendar bucket and ``keep``.

    Each rule keeps the newest N of *every* day, week or month. Weeks are named by calendar year and ISO week,
    or by ISO year and week with ``iso_year``. Ties go to the greater snapshot_id.
    """
    ts = F.col("ts")
    week_year = F.extract(F.lit("YEAROFWEEK"), ts) if iso_year else F.year(ts)
    newest = [F.desc("ts"), F.desc("snapshot_id")]

    def rank(*bucket):
        return F.row_number().over(Window.partitionBy(*bucket).orderBy(*newest))

    ranked = snapshots.withColumns(
        {
            "day_rank": rank(F.year(ts), F.month(ts), F.dayofmonth(ts)),
            "week_rank": rank(week_year, F.weekofyear(ts)),
            "month_rank": rank(F.year(ts), F.month(ts)),
        }
    )
    return ranked.withColumn("keep", (F.col("day_rank") <= daily) | (F.col("week_rank") <= weekly) | (F.col("month_rank") <= monthly))


def over_limit(snapshots: DataFrame, used: DataFrame, limit: int, least: int) -> DataFrame:
    """The snapshots to delete once ``used`` (one row: bytes) exceeds ``limit``: all but the newest ``least``."""
    ranked = _newest_first(snapshots)
    return ranked.join(F.broadcast(used.agg(F.sum("bytes").alias("bytes"))), F.col("bytes") > F.lit(limit)).where(F.col("place") > least).select("snapshot_id")


def _newest_first(snapshots: DataFrame) -> DataFrame:
    """``place`` from the newest on, in two steps: days are counted first, so only one row a day is in one task."""
    day = snapshots.withColumn("day", F.to_date("ts"))
    counts = day.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("day", (F.sum("n").over(Window.orderBy(F.desc("day"))) - F.col("n")).alias("base"))
    inside = day.withColumn("inside", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("snapshot_id"))))
    return inside.join(before, "day").withColumn("place", F.col("base") + F.col("inside")).drop("day", "base", "inside")


def within_budget(snapshots: DataFrame, budget: int, least: int) -> DataFrame:
    """The snapshots to delete so that the newest ones, ``least`` at any rate, have at most ``budget`` bytes (total_size)."""
    day = snapshots.withColumn("day", F.to_date("ts"))
    sums = day.groupBy("day").agg(F.sum("total_size").alias("s"))
    before = sums.select("day", (F.sum("s").over(Window.orderBy(F.desc("day"))) - F.col("s")).alias("base"))
    inside = day.withColumn("inside", F.sum("total_size").over(Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("snapshot_id")).rowsBetween(Window.unboundedPreceding, 0)))
    sized = inside.join(before, "day").select("snapshot_id", (F.col("base") + F.col("inside")).alias("running"))
    return sized.join(_newest_first(snapshots.select("snapshot_id", "ts")), "snapshot_id").where((F.col("running") > budget) & (F.col("place") > least)).select("snapshot_id")


def live_chunks(references: DataFrame, keep: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct hashes that kept snapshots refer to, and those of ``more`` (parity, versions)."""
    live = references.join(keep.select("snapshot_id"), "snapshot_id", "left_semi").select("chunk_hash")
    for extra in more:
        live = live.unionByName(extra.select("chunk_hash"))
    return live.distinct()


def orphans(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live, "chunk_hash", "left_anti")


def delete_snapshots(snapshots: DataFrame, ids: list[str]) -> DataFrame:
    """``snapshots`` without ``ids``; unknown ids do nothing."""
    return snapshots.where(~F.col("snapshot_id").cast("string").isin([str(i) for i in ids])) if ids else snapshots


def compaction_report(entries: DataFrame, live: DataFrame) -> DataFrame:
    """One row: entries kept and discarded, bytes kept and freed, packs that lose entries, for entries (pack_id, chunk_hash, stored_size)."""
    marked = entries.join(live.select("chunk_hash").withColumn("live", F.lit(True)), "chunk_hash", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    # packs are few next to entries: their sums first, then one row
    packs = marked.groupBy("pack_id").agg(
        F.count(F.when(F.col("live"), 1)).alias("kept"),
        F.count(F.when(~F.col("live"), 1)).alias("discarded"),
        F.sum(F.when(F.col("live"), F.col("stored_size")).otherwise(0)).alias("kept_bytes"),
        F.sum(F.when(~F.col("live"), F.col("stored_size")).otherwise(0)).alias("freed_bytes"),
    )
    return packs.agg(
        F.sum("kept").alias("kept"),
        F.sum("discarded").alias("discarded"),
        F.sum("kept_bytes").alias("kept_bytes"),
        F.sum("freed_bytes").alias("freed_bytes"),
        F.count(F.lit(1)).alias("packs_before"),
        F.count(F.when(F.col("kept") > 0, 1)).alias("packs_with_live"),
    )


def relocate(index: DataFrame, moved: DataFrame) -> DataFrame:
    """``index`` with the new pack_id and pack_offset of the chunks in ``moved``."""
    new = moved.select("chunk_hash", F.col("pack_id").alias("new_pack"), F.col("pack_offset").alias("new_offset"))
    joined = index.join(new, "chunk_hash", "left")
    return joined.withColumns({"pack_id": F.coalesce("new_pack", "pack_id"), "pack_offset": F.coalesce("new_offset", "pack_offset")}).drop("new_pack", "new_offset")
