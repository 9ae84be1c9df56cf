"""Queries that run a whole repository over the driver's documents: backup, changes, prune, compact, repair, restore, indexes.

A document is a file; chunks are larger than any of them, so a file is one chunk and SQL can tell its hash.
"""

from __future__ import annotations

import secrets
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lodestrata import config
from lodestrata.functions import text
from lodestrata.operators import audit, dedup
from lodestrata.plans.catalogue import FILES, files, query, size_sql, table
from lodestrata.repository import Repository
from lodestrata.sources import indexes, tree
from lodestrata.store import Store, shared_folder

KEY = b"an example key of thirty-two byt"
SETTINGS = config.Config(chunk_min_size=8 << 20, chunk_target_size=8 << 20, chunk_max_size=16 << 20, ecc_data_shards=8, ecc_parity_shards=2)
DAY = [datetime(2024, 5, 1, 6 + k, tzinfo=timezone.utc) for k in range(4)]


def _folder(spark):
    return f"{shared_folder(spark)}/lodestrata/operations-{secrets.token_hex(8)}"


def _repository(spark, sealed=False):
    return Repository.create(Store(spark, _folder(spark)), SETTINGS.changed(encryption_enabled=sealed), KEY if sealed else None)


def _files(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "lang", "path", "size", F.lit("2024-05-01 05:00:00").cast("timestamp").alias("modified"), F.col("text").cast("binary").alias("content"))


HASH = "CASE WHEN text = '' THEN sha256('') ELSE sha256(sha256(text)) END"


@query("backup_nodes", f"WITH {FILES} SELECT path, size, {HASH} AS file_hash, CASE WHEN text = '' THEN 0 ELSE 1 END AS chunks FROM files")
def backup_nodes(spark, sf_dir):
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), "host", ts=DAY[0])
    return repo.table("nodes").select("path", "size", "file_hash", F.size("chunk_hashes").alias("chunks"))


@query(
    "backup_twice_stats",
    f"WITH {FILES}, d AS (SELECT DISTINCT sha256(text) AS h, size FROM files WHERE text <> '') SELECT (SELECT count(*) FROM d) AS chunks, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS raw_bytes, (SELECT 2 * count(*) FROM files WHERE text <> '') AS refs, (SELECT CAST(2 * sum(size) AS BIGINT) FROM files) AS logical_bytes, 2 AS snapshots",
)
def backup_twice_stats(spark, sf_dir):
    """The second backup reads nothing and stores nothing."""
    repo = _repository(spark)
    for ts in DAY[:2]:
        repo.backup(_files(spark, sf_dir), ts=ts)
    return repo.stats().select("chunks", "raw_bytes", "refs", "logical_bytes").crossJoin(repo.table("snapshots").agg(F.count("*").cast("int").alias("snapshots")))  # one row each


@query(
    "incremental_backup",
    f"WITH {FILES}, n AS (SELECT path, text || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END AS text FROM files WHERE doc_id % 10 <> 4) SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, {HASH} AS file_hash FROM n",
)
def incremental_backup(spark, sf_dir):
    """Of ten documents one changes, one is new and one goes; only the paths that changed are read."""
    every, repo = _files(spark, sf_dir), _repository(spark)
    repo.backup(every.where("doc_id % 10 <> 5"), ts=DAY[0])
    changed = every.where("doc_id % 10 IN (3, 4, 5)").select("path")
    now = every.where("doc_id % 10 <> 4").withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    last = repo.backup_changes(changed, now, ts=DAY[1])
    return repo.table("nodes").where(F.col("snapshot_id") == last).select("path", "size", "file_hash")


ONLY = "en AS (SELECT DISTINCT sha256(text) AS h FROM files WHERE lang = 'en' AND text <> '' AND text NOT IN (SELECT text FROM files WHERE lang <> 'en')), rest AS (SELECT DISTINCT sha256(text) AS h FROM files WHERE lang <> 'en' AND text <> '')"


@query("prune_and_compact", f"WITH {FILES}, {ONLY} SELECT (SELECT count(*) FROM rest) AS kept, (SELECT count(*) FROM en) AS discarded, 1 AS pruned, (SELECT count(*) FROM rest) AS verified")
def prune_and_compact(spark, sf_dir):
    """Two snapshots of one day without a common text: the older one goes, and its chunks with it."""
    every, repo = _files(spark, sf_dir), _repository(spark)
    rest = every.where("lang <> 'en'")
    repo.backup(every.where("lang = 'en'").join(rest.select("content"), "content", "left_anti"), ts=DAY[0])
    repo.backup(rest, ts=DAY[1])
    gone = repo.prune(1, 0, 0).agg(F.count("*").cast("int").alias("pruned"))
    report = repo.compact().select("kept", "discarded")
    return report.crossJoin(gone).crossJoin(repo.verify().where("status = 'ok'").agg(F.count("*").alias("verified")))  # one row each


@query(
    "loss_and_repair",
    f"WITH {FILES}, d AS (SELECT DISTINCT sha256(text) AS h FROM files WHERE text <> ''), g AS (SELECT substr(h, 1, 2) AS lane, count(*) AS n FROM d GROUP BY 1), b AS (SELECT CAST(sum((n + 7) // 8) AS BIGINT) AS bad FROM g) SELECT (SELECT count(*) FROM d) AS checked, (SELECT count(*) FROM d) - bad AS ok, bad AS repaired, CAST(0 AS BIGINT) AS lost, 100.0 AS percent, CAST(0 AS BIGINT) AS still_bad FROM b",
)
def loss_and_repair(spark, sf_dir):
    """The first chunk of every parity group is lost; all come back."""
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    version = repo.store.version()
    lost = repo.table("parity_members").where("NOT is_parity AND pos = 0").select("chunk_hash")
    repo.store.commit(replace={"chunk_data": repo.table("chunk_data").join(lost, "chunk_hash", "left_anti")}, expected=version)
    before = repo._staged("statuses", repo.verify())
    report = audit.scrub(before, repo.repair())
    return report.crossJoin(repo.verify().agg(F.count(F.when(F.col("status") != "ok", 1)).alias("still_bad")))  # one row each


@query("sealed_backup_read_back", f"WITH {FILES} SELECT path, sha256(text) AS content_sha256 FROM files WHERE text <> ''")
def sealed_backup_read_back(spark, sf_dir):
    """Compressed and encrypted chunks, opened again and put together by file."""
    repo = _repository(spark, sealed=True)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    data = repo.table("chunk_data").select("chunk_hash", repo._open(F.col("stored")).alias("data"))
    return audit.restore(repo.references(), data).select("path", F.sha2("content", 256).alias("content_sha256"))


@query("restore_preview", f"WITH {FILES} SELECT path, size AS bytes, 'planned' AS status FROM files WHERE lang = 'de'")
def restore_preview(spark, sf_dir):
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), tags=["all"], ts=DAY[0])
    return repo.restore("/nowhere", "all", ["de/*"], dry_run=True)


@query("long_listing", f"WITH {FILES} SELECT '-' AS kind, path, {size_sql('size')} AS size_text, '2024-05-01 05:00:00' AS modified FROM files")
def long_listing(spark, sf_dir):
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    return repo.listing()


@query("forget_chunks", f"WITH {FILES}, d AS (SELECT DISTINCT sha256(text) AS h FROM files WHERE text <> '') SELECT (SELECT count(*) FROM d WHERE substr(h, 1, 1) <> '7') AS indexed, (SELECT count(*) FROM d) AS stored")
def forget_chunks(spark, sf_dir):
    """Out of the index alone: the data is still there."""
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    hashes = [r[0] for r in repo.table("chunks").where("chunk_hash LIKE '7%'").select("chunk_hash").collect()]
    repo.forget(hashes)
    return repo.table("chunks").agg(F.count("*").alias("indexed")).crossJoin(repo.table("chunk_data").agg(F.count("*").alias("stored")))  # one row each


@query("snapshot_verified_chunks", f"WITH {FILES} SELECT DISTINCT sha256(text) AS chunk_hash, 'ok' AS status FROM files WHERE lang = 'fr' AND text <> ''")
def snapshot_verified_chunks(spark, sf_dir):
    """The distinct chunks of one of two snapshots, verified."""
    every, repo = _files(spark, sf_dir), _repository(spark)
    repo.backup(every, ts=DAY[0])
    return repo.verify(snapshot=repo.backup(every.where("lang = 'fr'"), ts=DAY[1]))


@query("chunk_index_documents", "SELECT sha256(CAST(p_partkey AS VARCHAR)) AS chunk_hash, CAST(p_size AS BIGINT) AS raw_size, CAST(p_size % 7 + 1 AS BIGINT) AS stored_size, p_partkey % 50 AS pack_id, p_partkey AS pack_offset, CAST(NULL AS BIGINT) AS parity_group FROM part")
def chunk_index_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    rows = p.select(dedup.chunk_hash(F.col("p_partkey").cast("string")).alias("chunk_hash"), size.alias("raw_size"), (size % 7 + 1).alias("stored_size"), (F.col("p_partkey") % 50).alias("pack_id"), F.col("p_partkey").alias("pack_offset"), F.lit(None).cast("long").alias("parity_group"))
    folder = _folder(spark)
    indexes.write_documents(rows, folder, "entries", "chunk_hash", parts=4)
    return indexes.read_chunk_index(spark, folder)


@query("parity_index_documents", "SELECT p_partkey // 6 AS group_no, CAST(p_partkey % 6 AS INTEGER) AS pos, p_partkey % 6 >= 4 AS is_parity, 'c' || p_partkey AS chunk_hash, p_partkey // 6 + 9 AS shard_len FROM part WHERE p_partkey // 6 BETWEEN 1 AND (SELECT max(p_partkey) // 6 - 1 FROM part)")
def parity_index_documents(spark, sf_dir):
    """Groups of four and two, written and read again; the groups at both ends aren't whole and are left out."""
    p = table(spark, sf_dir, "part").withColumn("group_no", F.floor(F.col("p_partkey") / 6))
    whole = p.join(p.groupBy("group_no").count().where("count = 6").select("group_no"), "group_no", "left_semi")
    members = whole.where("group_no >= 1").join(p.agg((F.floor(F.max("p_partkey") / 6) - 1).alias("last")), F.col("group_no") <= F.col("last"))  # one row on the right
    members = members.select("group_no", (F.col("p_partkey") % 6).cast("int").alias("pos"), (F.col("p_partkey") % 6 >= 4).alias("is_parity"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chunk_hash"), (F.col("group_no") + 9).alias("shard_len"))
    folder = _folder(spark)
    indexes.write_documents(indexes.parity_groups(members), folder, "groups", "group_id", parts=4)
    return indexes.read_parity_index(spark, folder)


def _file_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 90).cast("string")).alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("mtime"), F.col("o_orderkey").cast("string").alias("snapshot_id"), F.array(F.col("o_orderstatus")).alias("chunk_hashes"))
    folder = _folder(spark)
    indexes.write_documents(rows, folder, "files", "path", parts=4)
    return indexes.read_file_index(spark, folder)


ENTRIES = "e AS (SELECT 'f' || o_custkey % 90 AS path, strftime(o_orderdate, '%Y-%m-%d') AS mtime, CAST(o_orderkey AS VARCHAR) AS snapshot_id FROM orders)"


@query("file_index_by_path_and_time", f"WITH {ENTRIES} SELECT path, mtime, snapshot_id FROM e WHERE (path, mtime) IN (SELECT path, max(mtime) FROM e GROUP BY path)")
def file_index_by_path_and_time(spark, sf_dir):
    entries = _file_index(spark, sf_dir)
    return indexes.lookup(entries, entries.groupBy("path").agg(F.max("mtime").alias("mtime"))).select("path", "mtime", "snapshot_id")


@query("file_index_by_snapshot", f"WITH {ENTRIES} SELECT path, mtime FROM e WHERE snapshot_id IN ('1', '7', '33')")
def file_index_by_snapshot(spark, sf_dir):
    return indexes.lookup(_file_index(spark, sf_dir), spark.createDataFrame([("1",), ("7",), ("33",)], "snapshot_id string")).select("path", "mtime")


@query("file_index_without_snapshot", f"WITH {ENTRIES} SELECT path, count(*) AS entries FROM (SELECT * FROM e WHERE snapshot_id <> '1' UNION ALL SELECT 'new', '2024-01-01', 'x') GROUP BY path")
def file_index_without_snapshot(spark, sf_dir):
    more = spark.createDataFrame([("new", "2024-01-01", "x", ["h"])], indexes.FILE)
    return indexes.add_files(indexes.remove_snapshot(_file_index(spark, sf_dir), "1"), more).groupBy("path").agg(F.count("*").alias("entries"))


@query("changed_path_documents", "SELECT DISTINCT 'u' || user_id AS path FROM events")
def changed_path_documents(spark, sf_dir):
    folder = _folder(spark)
    indexes.write_documents(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")), folder, "paths", "path", parts=4)
    return indexes.changed_paths(spark, folder)


@query("count_files", f"WITH {FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files")
def count_files(spark, sf_dir):
    return tree.count_files(files(spark, sf_dir).select("path", "size"))


@query("settings_document", "SELECT 9 AS compression_level, 64 AS ecc_data_shards, 8 AS ecc_parity_shards, CAST(1048576 AS BIGINT) AS max_size")
def settings_document(spark, sf_dir):
    """Settings changed, written as text in the shared folder, and read again."""
    folder = _folder(spark)
    spark.createDataFrame([(config.Config().changed(compression_level=9, max_size=1 << 20).dumps(),)], "value string").coalesce(1).write.text(folder)
    read = config.loads(spark.read.text(folder, wholetext=True).first().value)
    return spark.createDataFrame([(read.compression_level, read.ecc_data_shards, read.ecc_parity_shards, read.max_size)], "compression_level int, ecc_data_shards int, ecc_parity_shards int, max_size long")


@query("saved_percent", f"WITH {FILES}, d AS (SELECT DISTINCT sha256(text) AS h, size FROM files WHERE text <> ''), s AS (SELECT (SELECT CAST(sum(size) AS BIGINT) FROM files) AS logical_bytes, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS raw_bytes) SELECT logical_bytes, raw_bytes, round((logical_bytes - raw_bytes) * 100.0 / logical_bytes, 6) AS percent FROM s")
def saved_percent(spark, sf_dir):
    """The share of bytes that deduplication alone saves."""
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    saved = F.col("logical_bytes") - F.col("raw_bytes")
    return repo.stats().select("logical_bytes", "raw_bytes", F.round(audit.percent_done(saved, F.col("logical_bytes")), 6).alias("percent"))


@query("short_names", f"WITH {FILES} SELECT path, substr({HASH}, 1, 12) AS short FROM files")
def short_names(spark, sf_dir):
    repo = _repository(spark)
    repo.backup(_files(spark, sf_dir), ts=DAY[0])
    return repo.nodes_of().select("path", text.short_id(F.col("file_hash")).alias("short"))
