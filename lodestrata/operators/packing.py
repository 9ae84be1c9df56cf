"""Layout of packs and parity groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the pack format.
HEADER, ENTRY, FOOTER = 14, 69, 33


def approximate_packs(chunks: DataFrame, target: int, lane: str, *order: str) -> DataFrame:
    """pack_no and pack_offset by a running sum in each lane: a pack is cut about every ``target`` bytes."""
    w = Window.partitionBy(lane).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(F.col("stored_size") + ENTRY).over(w), F.lit(0))
    numbered = chunks.withColumn("running", running).withColumn("pack_no", F.call_function("div", F.col("running"), F.lit(target - HEADER - FOOTER).cast("long")))
    first = F.min("running").over(Window.partitionBy(lane, "pack_no"))
    return numbered.withColumn("pack_offset", F.col("running") - first + HEADER).drop("running")


def exact_packs(chunks: DataFrame, target: int, lane: str, *order: str) -> DataFrame:
    """(lane, order..., stored_size, pack_no, pack_offset): a pack ends with the entry that reaches ``target``.

    Where a sum starts anew depends on all rows before it, so each lane (a writer) is folded in order; only
    sizes are in it, never payload.
    """
    keep = [lane, *order, "stored_size"]
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keep) + ", pack_no long, pack_offset long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        packs, offsets, pack, at = [], [], 0, 0
        for size in rows["stored_size"].tolist():
            packs.append(pack)
            offsets.append(HEADER + at)
            at += ENTRY + size
            if HEADER + at + FOOTER >= target:
                pack, at = pack + 1, 0
        return rows.assign(pack_no=packs, pack_offset=offsets)

    return chunks.select(*keep).groupBy(lane).applyInPandas(run, schema)


def parity_groups(chunks: DataFrame, data: int, lane: str, *order: str) -> DataFrame:
    """group_no, pos and shard_len (longest member) for every ``data`` chunks of a lane in order."""
    place = F.row_number().over(Window.partitionBy(lane).orderBy(*order)) - 1
    out = chunks.withColumn("place", place).withColumns({"group_no": F.call_function("div", F.col("place").cast("long"), F.lit(data).cast("long")), "pos": F.pmod("place", F.lit(data))}).drop("place")
    return out.withColumn("shard_len", F.max("stored_size").over(Window.partitionBy(lane, "group_no")))
