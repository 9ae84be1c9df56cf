"""Sharding by weighted rendezvous hashing of a stable key, in DataFrame functions only.

Each shard draws a number for each key, from their hash alone; the key goes to the shard with the
least draw over its weight. A new shard takes only the keys for which its draw is the least; the others stay.

Cases: a null doc_id is a key of its own, the same for all such rows; a null text has no bytes (size 1,
checksum 0); rows that repeat a doc_id share a shard and have slots of their own; equal draws go to the
smaller shard number; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Groups that a shard's rows are numbered in; each is sorted by one task.
PARTS = 4096


def draw(key: Column, shard: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: dict[int, float]) -> Column:
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need weights above 0")
    draws = [F.struct((-F.log(draw(key, s)) / float(w)).alias("draw"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(next(iter(weights)))


def record_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def assign(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, parts: int = PARTS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots come in two steps, so that no task sees a whole shard: rows are numbered in ``parts`` groups of
    each shard, and the groups' counts are added up. Only 40 bytes a row are shuffled.
    """
    rows = pick(docs, doc_id="long", text="string")
    key = record_key(F.col("doc_id"))
    described = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        shard_of(key, weights).cast("int").alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    whole = F.concat_ws(":", record_key(F.col("doc_id")), "text_crc32", "size")  # rows of one key are dealt to many groups
    placed = described.withColumn("part", F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("long") % parts)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("inside", inside).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"), "grown_shard"
    )


def _oracle(shards: int) -> str:
    draw_sql = "(CAST(CAST('0x' || substr(md5(key || ':' || s.shard), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
    return f"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(octet_length(encode(text)), 0) + 1 AS size,
         CASE WHEN coalesce(text, '') = '' THEN CAST(0 AS BIGINT) ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295, [CAST(('0x' || x) AS BIGINT) FOR x IN regexp_extract_all(hex(encode(text)), '..')]),
           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) END AS text_crc32
  FROM documents, steps),
p AS (
  SELECT d.*, arg_min(s.shard, (-ln({draw_sql}), s.shard)) FILTER (s.shard < {shards}) AS shard,
         arg_min(s.shard, (-ln({draw_sql}), s.shard)) AS grown_shard
  FROM d, (SELECT CAST(unnest(range({shards + 1})) AS INTEGER) AS shard) AS s GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 8) AS BIGINT) % {PARTS}, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM p
"""


ORACLE = _oracle(8)
