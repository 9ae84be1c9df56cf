"""Index documents (JSON) as tables and back: chunk index, parity index, file index, changed paths.

Cases: an empty or absent map or list gives no rows; a document that isn't JSON gives none either; counts of
references in a chunk index are passed over, since they are derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "hash string, size long, compressed_size long, refs long, parity_group long, pack_id long, pack_offset long"
GROUP = "group_id long, data_chunk_hashes array<string>, parity_chunk_hashes array<string>, chunk_size long"
FILE = "path string, mtime string, snapshot_id string, chunk_hashes array<string>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document may span lines, so a file is one; of a folder that ``write_documents`` made, each line is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return _lines(spark, path, schema)
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("d"))


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_hash, raw_size, stored_size, pack_id, pack_offset, parity_group)."""
    entries = _document(spark, path, f"entries map<string, struct<{_typed(CHUNK)}>>").select(F.explode("d.entries").alias("chunk_hash", "e"))
    return entries.select("chunk_hash", F.col("e.size").alias("raw_size"), F.col("e.compressed_size").alias("stored_size"), "e.pack_id", "e.pack_offset", "e.parity_group")


def read_parity_index(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, pos, is_parity, chunk_hash, shard_len): data members in order, then parity."""
    groups = _document(spark, path, f"groups array<struct<{_typed(GROUP)}>>").select(F.explode("d.groups").alias("g")).select("g.*")
    n = F.size("data_chunk_hashes")
    members = groups.select(F.col("group_id").alias("group_no"), F.col("chunk_size").alias("shard_len"), n.alias("n"), F.posexplode(F.concat("data_chunk_hashes", "parity_chunk_hashes")).alias("pos", "chunk_hash"))
    return members.select("group_no", "pos", (F.col("pos") >= F.col("n")).alias("is_parity"), "chunk_hash", "shard_len")


def parity_groups(members: DataFrame) -> DataFrame:
    """(group_id, data_chunk_hashes, parity_chunk_hashes, chunk_size) again; a group's size bounds its lists."""

    def ordered(parity: bool):
        kept = F.collect_list(F.when(F.col("is_parity") == parity, F.struct("pos", "chunk_hash")))
        return F.transform(F.array_sort(kept), lambda m: m["chunk_hash"])

    return members.groupBy(F.col("group_no").alias("group_id")).agg(ordered(False).alias("data_chunk_hashes"), ordered(True).alias("parity_chunk_hashes"), F.max("shard_len").alias("chunk_size"))


def changed_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path): the distinct paths of a hand-off file, a JSON list; an absent file has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string")
    texts = spark.read.text(path, wholetext=not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory())
    return texts.select(F.explode(F.from_json("value", "array<string>")).alias("path")).where("path IS NOT NULL").distinct()


def write_documents(df: DataFrame, path: str, kind: str, key: str, parts: int = 256) -> None:
    """Writes a table as index documents to a folder, rows dealt to ``parts`` documents by a hash of ``key``, so none has to hold all of a large index.

    Kinds: ``entries`` (chunk index: a map by ``chunk_hash``), ``groups`` (parity index), ``files`` (file index), and
    ``paths`` (a hand-off list). The readers take such a folder as they take one document.
    """
    if kind == "entries":
        row = F.struct(F.col("chunk_hash").alias("hash"), F.col("raw_size").alias("size"), F.col("stored_size").alias("compressed_size"), F.lit(0).cast("long").alias("refs"), "parity_group", "pack_id", "pack_offset")
        one = F.map_from_entries(F.collect_list(F.struct("chunk_hash", row.alias("e"))))
    elif kind in ("groups", "files"):
        one = F.collect_list(F.struct(*df.columns))
    elif kind == "paths":
        one = F.collect_set("path")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    text = F.to_json(one) if kind == "paths" else F.to_json(F.struct(one.alias(kind)))
    documents = df.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(text.alias("value"))
    documents.select("value").repartition(parts, "value").write.option("lineSep", "\n").text(path)


def read_file_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, snapshot_id, chunk_hashes)."""
    return _document(spark, path, f"files array<struct<{_typed(FILE)}>>").select(F.explode("d.files").alias("f")).select("f.*")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of a file index for the rows of ``wanted``, by those of its columns that the index has: path, (path, mtime) or snapshot_id."""
    by = [c for c in ("path", "mtime", "snapshot_id") if c in wanted.columns]
    if not by:
        raise ValueError("nothing to look up by")
    return index.join(wanted.select(*by).distinct(), by, "left_semi")


def add_files(index: DataFrame, more: DataFrame) -> DataFrame:
    """A file index (path, mtime, snapshot_id, chunk_hashes) with further entries."""
    return index.unionByName(more)


def remove_snapshot(index: DataFrame, snapshot_id: str) -> DataFrame:
    return index.where(F.col("snapshot_id") != snapshot_id)


def _typed(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(", ")))
