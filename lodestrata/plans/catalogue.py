"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import chunker, codec, parity, text
from lodestrata.operators import audit, dedup, lineage, packing, retention
from lodestrata.sources import indexes, packs, tree
from lodestrata.store import cut
from lodestrata.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "dedup_by_lang",
    """
    SELECT lang, count(*) AS files, count(DISTINCT sha256(text)) AS unique_files,
           CAST(sum(octet_length(encode(text))) AS BIGINT) AS logical_bytes
    FROM documents GROUP BY lang
    """,
)
def dedup_by_lang(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.count("*").alias("files"),
            F.countDistinct(F.sha2("text", 256)).alias("unique_files"),
            F.sum(F.octet_length("text").cast("long")).alias("logical_bytes"),
        )
    )


# --- how the driver's tables stand for a store's -------------------------------------------


def snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("host"), F.array("o_orderpriority").alias("tags"), parent.alias("parent_snapshot_id")
    )


def references(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("path"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("chunk_hash"), F.col("l_quantity").cast("long").alias("raw_size"))


def index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256).alias("chunk_hash"), F.col("p_partkey"), F.col("p_size").cast("long").alias("raw_size"), (F.col("p_size") % 7 + 1).cast("long").alias("stored_size"), (F.col("p_partkey") % 50).alias("pack_id"))


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("long").alias("size"), F.lit("file").alias("node_type"), "lang", "source")


SNAP = "snap AS (SELECT o_orderkey AS snapshot_id, o_orderdate AS ts, o_custkey AS host, o_orderpriority AS tag, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)"
REFS = "refs AS (SELECT l_orderkey AS snapshot_id, l_linenumber AS path, sha256(CAST(l_partkey AS VARCHAR)) AS chunk_hash, CAST(l_quantity AS BIGINT) AS raw_size FROM lineitem)"
IDX = "idx AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS chunk_hash, p_partkey, CAST(p_size AS BIGINT) AS raw_size, CAST(p_size % 7 + 1 AS BIGINT) AS stored_size, p_partkey % 50 AS pack_id FROM part)"
FILES = "files AS (SELECT doc_id, lang || '/' || source || '/doc-' || doc_id || '.txt' AS path, text, CAST(octet_length(encode(text)) AS BIGINT) AS size, lang, source FROM documents)"
KEEP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY year(ts), month(ts), day(ts) ORDER BY ts DESC, snapshot_id DESC) AS day_rank,
  row_number() OVER (PARTITION BY year(ts), week(ts) ORDER BY ts DESC, snapshot_id DESC) AS week_rank,
  row_number() OVER (PARTITION BY year(ts), month(ts) ORDER BY ts DESC, snapshot_id DESC) AS month_rank FROM snap),
kept AS (SELECT * FROM ranked WHERE day_rank <= 1 OR week_rank <= 2 OR month_rank <= 3),
live AS (SELECT DISTINCT chunk_hash FROM refs WHERE snapshot_id IN (SELECT snapshot_id FROM kept WHERE host % 3 = 0))"""


def _keep(spark, sf_dir):
    return retention.retention(snapshots(spark, sf_dir), 1, 2, 3)


def _live(spark, sf_dir):
    """A third of the hosts is kept at all, so that some chunks are orphans."""
    return retention.live_chunks(references(spark, sf_dir), _keep(spark, sf_dir).where("keep AND host % 3 = 0"))


# --- identity, references, statistics ------------------------------------------------------


@query("chunk_refcounts", f"WITH {REFS} SELECT chunk_hash, count(*) AS occurrences, count(DISTINCT snapshot_id) AS snapshots FROM refs GROUP BY chunk_hash")
def chunk_refcounts(spark, sf_dir):
    return dedup.reference_counts(references(spark, sf_dir))


@query(
    "release_references",
    f"""WITH {REFS}, c AS (SELECT chunk_hash, count(*) AS n, count(*) FILTER (snapshot_id % 2 = 0) AS gone FROM refs GROUP BY chunk_hash)
    SELECT chunk_hash, greatest(0, n - gone) AS occurrences, n <= gone AS unreferenced FROM c""",
)
def release_references(spark, sf_dir):
    refs = references(spark, sf_dir)
    return dedup.release(dedup.reference_counts(refs), refs.where("snapshot_id % 2 = 0").groupBy("chunk_hash").agg(F.count("*").alias("n")))


@query(
    "merkle_file_hash",
    f"WITH {REFS} SELECT snapshot_id, sha256(string_agg(chunk_hash, '' ORDER BY path, raw_size, chunk_hash)) AS file_hash FROM refs GROUP BY snapshot_id",
)
def merkle_file_hash(spark, sf_dir):
    parts = references(spark, sf_dir).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("path", "raw_size", "chunk_hash"))).alias("parts"))
    return parts.select("snapshot_id", text.file_hash(F.col("parts.chunk_hash")).alias("file_hash"))


@query(
    "snapshot_totals",
    f"WITH {REFS} SELECT snapshot_id, CAST(sum(raw_size) AS BIGINT) AS total_size, count(*) AS total_chunks, count(*) AS files FROM refs GROUP BY snapshot_id",
)
def snapshot_totals(spark, sf_dir):
    nodes = references(spark, sf_dir).select("snapshot_id", F.lit("file").alias("node_type"), F.col("raw_size").alias("size"), F.array("chunk_hash").alias("chunk_hashes"))
    return dedup.snapshot_totals(nodes)


@query(
    "repository_stats",
    f"""WITH {REFS}, {IDX}, c AS (SELECT chunk_hash, count(*) AS refs FROM refs GROUP BY chunk_hash),
    t AS (SELECT count(*) AS chunks, CAST(sum(raw_size) AS BIGINT) AS raw_bytes, CAST(sum(stored_size) AS BIGINT) AS stored_bytes, CAST(sum(coalesce(c.refs, 0)) AS BIGINT) AS refs,
      CAST(sum(coalesce(c.refs, 0) * raw_size) AS BIGINT) AS logical_bytes FROM idx LEFT JOIN c USING (chunk_hash))
    SELECT *, round(CAST(raw_bytes AS DOUBLE) * refs / stored_bytes, 6) AS dedup_ratio_compat, round(CAST(logical_bytes AS DOUBLE) / stored_bytes, 6) AS dedup_ratio, logical_bytes - stored_bytes AS saved_bytes FROM t""",
)
def repository_stats(spark, sf_dir):
    out = dedup.store_stats(references(spark, sf_dir), index(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("dedup_ratio_compat", "dedup_ratio")})


@query(
    "disk_usage_by_area",
    f"""WITH {FILES}, p AS (SELECT octet_length(encode(html)) AS n FROM pages), c AS (SELECT octet_length(encode(text)) AS n FROM conversations)
    SELECT 'documents' AS area, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files
    UNION ALL SELECT 'pages', count(*), CAST(sum(n) AS BIGINT) FROM p UNION ALL SELECT 'conversations', count(*), CAST(sum(n) AS BIGINT) FROM c""",
)
def disk_usage_by_area(spark, sf_dir):
    areas = [("documents", "text"), ("pages", "html"), ("conversations", "text")]
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("area"), F.octet_length(c).cast("long").alias("n")) for t, c in areas]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("area").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


@query(
    "dedup_probe_new_chunks",
    "SELECT DISTINCT sha256(text) AS chunk_hash FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)",
)
def dedup_probe_new_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dedup.chunk_hash(F.col("text")).alias("chunk_hash"))
    return dedup.new_chunks(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("chunk_hash")


@query("dedup_probe_duplicate_chunks", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def dedup_probe_duplicate_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dedup.chunk_hash(F.col("text")).alias("chunk_hash"))
    return dedup.known_chunks(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query(
    "backup_counters",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) AS n FROM documents), i AS (SELECT h, count(*) AS c, max(n) AS n FROM d WHERE doc_id % 3 <> 0 GROUP BY h),
    m AS (SELECT i.*, h IN (SELECT h FROM d WHERE doc_id % 3 = 0) AS known FROM i)
    SELECT CAST(sum(c) AS BIGINT) AS chunks, count(*) FILTER (NOT known) AS new_chunks, CAST(sum(c - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS duplicate_chunks,
    CAST(sum(c * n) AS BIGINT) AS raw_bytes, CAST(sum(n) FILTER (NOT known) AS BIGINT) AS new_bytes FROM m""",
)
def backup_counters(spark, sf_dir):
    d = files(spark, sf_dir).select("doc_id", dedup.chunk_hash(F.col("text")).alias("chunk_hash"), F.col("size").alias("raw_size"))
    return dedup.backup_counters(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0").select("chunk_hash").distinct())


# --- retention and liveness ----------------------------------------------------------------


@query("retention_daily_weekly_monthly", f"WITH {SNAP}, {REFS}, {KEEP} SELECT snapshot_id, day_rank, week_rank, month_rank, day_rank <= 1 OR week_rank <= 2 OR month_rank <= 3 AS keep FROM ranked")
def retention_daily_weekly_monthly(spark, sf_dir):
    return _keep(spark, sf_dir).select("snapshot_id", "day_rank", "week_rank", "month_rank", "keep")


@query(
    "retention_iso_weeks",
    f"""WITH {SNAP}, r AS (SELECT snapshot_id, row_number() OVER (PARTITION BY isoyear(ts), week(ts) ORDER BY ts DESC, snapshot_id DESC) AS week_rank FROM snap)
    SELECT snapshot_id, week_rank FROM r WHERE week_rank <= 1""",
)
def retention_iso_weeks(spark, sf_dir):
    return retention.retention(snapshots(spark, sf_dir), 0, 1, 0, iso_year=True).where("keep").select("snapshot_id", "week_rank")


@query("orphans_after_prune", f"WITH {SNAP}, {REFS}, {IDX}, {KEEP} SELECT p_partkey FROM idx WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.chunk_hash = idx.chunk_hash)")
def orphans_after_prune(spark, sf_dir):
    return retention.orphans(index(spark, sf_dir), _live(spark, sf_dir)).select("p_partkey")


@query("live_chunks_after_prune", f"WITH {SNAP}, {REFS}, {KEEP} SELECT chunk_hash FROM live")
def live_chunks_after_prune(spark, sf_dir):
    return _live(spark, sf_dir)


@query(
    "compaction_report",
    f"""WITH {SNAP}, {REFS}, {IDX}, {KEEP}, m AS (SELECT idx.*, chunk_hash IN (SELECT chunk_hash FROM live) AS ok FROM idx), p AS (SELECT pack_id, count(*) FILTER (ok) AS k FROM m GROUP BY pack_id)
    SELECT count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS discarded, CAST(sum(stored_size) FILTER (ok) AS BIGINT) AS kept_bytes, CAST(coalesce(sum(stored_size) FILTER (NOT ok), 0) AS BIGINT) AS freed_bytes,
    (SELECT count(*) FROM p) AS packs_before, (SELECT count(*) FROM p WHERE k > 0) AS packs_with_live FROM m""",
)
def compaction_report(spark, sf_dir):
    return retention.compaction_report(index(spark, sf_dir), _live(spark, sf_dir))


@query("storage_limit_prune", f"WITH {SNAP}, r AS (SELECT snapshot_id, row_number() OVER (ORDER BY ts DESC, snapshot_id DESC) AS n FROM snap) SELECT snapshot_id FROM r WHERE n > 100 AND (SELECT sum(p_size % 7 + 1) FROM part) > 1000")
def storage_limit_prune(spark, sf_dir):
    return retention.over_limit(snapshots(spark, sf_dir), index(spark, sf_dir).select(F.col("stored_size").alias("bytes")), 1000, 100)


@query(
    "storage_budget_prune",
    f"""WITH {SNAP}, {REFS}, t AS (SELECT s.snapshot_id, s.ts, coalesce(sum(raw_size), 0) AS n FROM snap AS s LEFT JOIN refs USING (snapshot_id) GROUP BY ALL),
    r AS (SELECT snapshot_id, sum(n) OVER (ORDER BY ts DESC, snapshot_id DESC) AS running, row_number() OVER (ORDER BY ts DESC, snapshot_id DESC) AS place FROM t)
    SELECT snapshot_id FROM r WHERE running > 50000 AND place > 10""",
)
def storage_budget_prune(spark, sf_dir):
    sizes = references(spark, sf_dir).groupBy("snapshot_id").agg(F.sum("raw_size").alias("total_size"))
    sized = snapshots(spark, sf_dir).join(sizes, "snapshot_id", "left").withColumn("total_size", F.coalesce("total_size", F.lit(0)))
    return retention.within_budget(sized, 50_000, 10)


@query("delete_snapshots", "SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey NOT IN (1, 2, 3, 999999999)")
def delete_snapshots(spark, sf_dir):
    return retention.delete_snapshots(snapshots(spark, sf_dir), ["1", "2", "3", "999999999"]).select("snapshot_id")


# --- layout --------------------------------------------------------------------------------


@query(
    "pack_assignment_running_sum",
    """WITH r AS (SELECT p_partkey, p_brand, CAST(coalesce(sum(p_size * 100 + 69) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS running FROM part),
    n AS (SELECT *, running // (20000 - 47) AS pack_no FROM r)
    SELECT p_partkey, p_brand, pack_no, running - min(running) OVER (PARTITION BY p_brand, pack_no) + 14 AS pack_offset FROM n""",
)
def pack_assignment_running_sum(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 100).cast("long").alias("stored_size"))
    return packing.approximate_packs(chunks, 20_000, "p_brand", "p_partkey").select("p_partkey", "p_brand", "pack_no", "pack_offset")


@query(
    "pack_assignment_exact",
    """WITH RECURSIVE c AS (SELECT p_partkey, p_brand, CAST(p_size * 100 AS BIGINT) AS stored_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
    f AS (SELECT p_brand, n, p_partkey, stored_size, CAST(0 AS BIGINT) AS pack_no, CAST(14 AS BIGINT) AS pack_offset, stored_size + 69 AS used FROM c WHERE n = 1
      UNION ALL SELECT c.p_brand, c.n, c.p_partkey, c.stored_size, CASE WHEN 47 + used >= 20000 THEN pack_no + 1 ELSE pack_no END, CASE WHEN 47 + used >= 20000 THEN 14 ELSE 14 + used END,
        CASE WHEN 47 + used >= 20000 THEN 0 ELSE used END + c.stored_size + 69 FROM f JOIN c ON c.p_brand = f.p_brand AND c.n = f.n + 1)
    SELECT p_brand, p_partkey, stored_size, pack_no, pack_offset FROM f""",
)
def pack_assignment_exact(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 100).cast("long").alias("stored_size"))
    return packing.exact_packs(chunks, 20_000, "p_brand", "p_partkey")


@query(
    "parity_group_assignment",
    """WITH n AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part)
    SELECT p_partkey, p_brand, place // 8 AS group_no, CAST(place % 8 AS INTEGER) AS pos, max(p_size) OVER (PARTITION BY p_brand, place // 8) AS shard_len FROM n""",
)
def parity_group_assignment(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").alias("stored_size"))
    return packing.parity_groups(chunks, 8, "p_brand", "p_partkey").drop("stored_size")


# --- lineage -------------------------------------------------------------------------------


@query(
    "lineage_chain",
    f"""WITH RECURSIVE {SNAP}, head AS (SELECT max(snapshot_id) AS h FROM snap),
    c AS (SELECT snapshot_id, parent, CAST(0 AS BIGINT) AS depth FROM snap, head WHERE snapshot_id = h UNION ALL SELECT s.snapshot_id, s.parent, depth + 1 FROM c JOIN snap AS s ON s.snapshot_id = c.parent)
    SELECT snapshot_id, depth, parent IS NOT NULL AND parent NOT IN (SELECT snapshot_id FROM snap) AS parent_missing FROM c""",
)
def lineage_chain(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return lineage.chain(s, s.agg(F.max("snapshot_id")).first()[0])


@query(
    "unchanged_files",
    """WITH c AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, sha256(text) AS h FROM conversations), a AS (SELECT * FROM c WHERE turn = 1), b AS (SELECT * FROM c WHERE turn = 0)
    SELECT a.conv_id AS path, a.n AS size, coalesce(a.n = b.n, false) AS reused, CASE WHEN a.n = b.n THEN b.h END AS old_hash, b.n IS NOT NULL AND a.n <> b.n AS has_version FROM a LEFT JOIN b ON a.conv_id = b.conv_id""",
)
def unchanged_files(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "turn", F.octet_length("text").cast("long").alias("size"), F.lit(0).alias("modified"), F.array(F.sha2("text", 256)).alias("chunk_hashes"))
    out = lineage.unchanged(c.where("turn = 1").drop("turn", "chunk_hashes"), c.where("turn = 0").drop("turn"))
    return out.select("path", "size", "reused", F.get("chunk_hashes", F.lit(0)).alias("old_hash"), "has_version")


DIFF = """a AS (SELECT conv_id AS path, sha256(text) AS h FROM conversations WHERE turn = 0 AND conv_id % 5 <> 0), b AS (SELECT conv_id AS path, sha256(text) AS h FROM conversations WHERE turn = CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 1 END AND conv_id % 7 <> 0)"""


def _two_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), "turn", F.sha2("text", 256).alias("file_hash"))
    return c.where("turn = 0 AND path % 5 <> 0").drop("turn"), c.where("turn = CASE WHEN path % 2 = 0 THEN 0 ELSE 1 END AND path % 7 <> 0").drop("turn")


@query(
    "snapshot_diff",
    f"WITH {DIFF} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path",
)
def snapshot_diff(spark, sf_dir):
    return lineage.diff(*_two_turns(spark, sf_dir))


@query(
    "incremental_merge",
    f"""WITH {FILES}, prev AS (SELECT path, size FROM files WHERE doc_id % 3 = 0), up AS (SELECT path, size + 1 AS size FROM files WHERE doc_id % 9 IN (0, 1)), k AS (SELECT * FROM prev WHERE NOT starts_with(path, 'de/src0/') AND path NOT IN (SELECT path FROM up)),
    dirs AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path FROM up)
    SELECT path, 'file' AS node_type, size FROM k UNION ALL SELECT path, 'file', size FROM up UNION ALL SELECT path, 'dir', NULL FROM dirs""",
)
def incremental_merge(spark, sf_dir):
    f = files(spark, sf_dir)
    columns = ["path", "node_type", "size"]
    upserts = f.where("doc_id % 9 IN (0, 1)").withColumn("size", F.col("size") + 1).select(*columns)
    return lineage.merge(f.where("doc_id % 3 = 0").select(*columns), upserts, spark.createDataFrame([("de/src0",)], "path string"))


@query("directories_of_files", f"WITH {FILES}, d AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path FROM files) SELECT path, len(string_split(path, '/')) AS depth FROM d")
def directories_of_files(spark, sf_dir):
    return lineage.directories(files(spark, sf_dir).select("path"))


@query(
    "file_versions",
    """WITH c AS (SELECT conv_id AS path, turn AS snapshot_id, role AS h FROM conversations), m AS (SELECT *, lag(h) OVER (PARTITION BY path ORDER BY snapshot_id) AS p FROM c), v AS (SELECT * FROM m WHERE p IS NULL OR p <> h)
    SELECT path, snapshot_id, h AS file_hash, CAST(row_number() OVER (PARTITION BY path ORDER BY snapshot_id) AS INTEGER) AS version, lag(snapshot_id) OVER (PARTITION BY path ORDER BY snapshot_id) AS previous_snapshot_id FROM v""",
)
def file_versions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("snapshot_id"), F.col("turn").alias("ts"), F.col("role").alias("file_hash"))
    return lineage.versions(c).drop("ts")


@query("snapshot_resolve_latest", f"WITH {SNAP} SELECT snapshot_id, host FROM snap ORDER BY ts DESC, snapshot_id DESC LIMIT 1")
def snapshot_resolve_latest(spark, sf_dir):
    return lineage.resolve(snapshots(spark, sf_dir), "latest").select("snapshot_id", "host")


@query("snapshot_resolve_prefix", f"WITH {SNAP} SELECT snapshot_id, host FROM snap WHERE starts_with(CAST(snapshot_id AS VARCHAR), '12') ORDER BY ts, snapshot_id LIMIT 1")
def snapshot_resolve_prefix(spark, sf_dir):
    return lineage.resolve(snapshots(spark, sf_dir), "12").select("snapshot_id", "host")


@query("snapshot_resolve_tag", f"WITH {SNAP} SELECT snapshot_id, host FROM snap WHERE tag = '1-URGENT' ORDER BY ts, snapshot_id LIMIT 1")
def snapshot_resolve_tag(spark, sf_dir):
    return lineage.resolve(snapshots(spark, sf_dir), "1-URGENT").select("snapshot_id", "host")


def size_sql(column: str) -> str:
    """Size text of a column; ties to even."""
    q = lambda u: f"(({column} * 100) // {u} + CASE WHEN ({column} * 100) % {u} * 2 > {u} OR (({column} * 100) % {u} * 2 = {u} AND (({column} * 100) // {u}) % 2 = 1) THEN 1 ELSE 0 END)"
    cases = " ".join(f"WHEN {column} >= {1 << b} THEN CAST({q(1 << b)} // 100 AS VARCHAR) || '.' || lpad(CAST({q(1 << b)} % 100 AS VARCHAR), 2, '0') || ' {u}'" for u, b in text.UNITS)
    return f"CASE {cases} ELSE CAST({column} AS VARCHAR) || ' B' END"


@query(
    "list_snapshots",
    f"WITH {SNAP}, {REFS}, t AS (SELECT snapshot_id, count(*) AS files, CAST(sum(raw_size) * 1000 AS BIGINT) AS bytes FROM refs GROUP BY snapshot_id) SELECT snapshot_id, strftime(ts, '%Y-%m-%d %H:%M') AS taken, coalesce(files, 0) AS files, {size_sql('coalesce(bytes, 0)')} AS size_text FROM snap LEFT JOIN t USING (snapshot_id)",
)
def list_snapshots(spark, sf_dir):
    t = references(spark, sf_dir).groupBy("snapshot_id").agg(F.count("*").alias("files"), (F.sum("raw_size") * 1000).alias("bytes"))
    s = snapshots(spark, sf_dir).join(t, "snapshot_id", "left").orderBy("ts", "snapshot_id")
    return s.select("snapshot_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("taken"), F.coalesce("files", F.lit(0)).alias("files"), text.format_size(F.coalesce("bytes", F.lit(0).cast("long"))).alias("size_text"))


# --- text functions ------------------------------------------------------------------------


@query("format_size", f"WITH {FILES}, n AS (SELECT doc_id, size * size * (doc_id % 4 + 1) AS n FROM files) SELECT doc_id, {size_sql('n')} AS size_text FROM n")
def format_size(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", text.format_size(F.col("size") * F.col("size") * (F.col("doc_id") % 4 + 1)).alias("size_text"))


@query(
    "parse_size",
    """WITH t AS (SELECT doc_id, (doc_id % 100) || '.5' || ['', ' KB', 'MB', ' g', ' XB'][doc_id % 5 + 1] AS t FROM documents)
    SELECT doc_id, CAST(CASE doc_id % 5 WHEN 4 THEN NULL ELSE floor((doc_id % 100 + 0.5) * [1, 1024, 1048576, 1073741824, 0][doc_id % 5 + 1]) END AS BIGINT) AS bytes FROM t""",
)
def parse_size(spark, sf_dir):
    units = F.array(*[F.lit(u) for u in ("", " KB", "MB", " g", " XB")])
    t = F.concat((F.col("doc_id") % 100).cast("string"), F.lit(".5"), F.element_at(units, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_size(t).alias("bytes"))


@query("glob_filter_files", rf"WITH {FILES} SELECT path FROM files WHERE regexp_full_match(path, '(.*/)?doc-.7\.txt', 's') OR regexp_full_match(path, '(.*/)?de/src[0-4]/.*', 's')")
def glob_filter_files(spark, sf_dir):
    return files(spark, sf_dir).where(text.matches_globs(F.col("path"), ["doc-?7.txt", "de/src[0-4]/*", "[broken"])).select("path")


@query("exclude_filter_subtree", rf"WITH {FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '(^|/)src1[^/]*(/|$)') AND NOT regexp_matches(path, '(^|/)doc-[^/]*5\.txt(/|$)')")
def exclude_filter_subtree(spark, sf_dir):
    return files(spark, sf_dir).where(~text.excluded(F.col("path"), ["src1*", "doc-*5.txt"])).select("path")


@query("hash_prefix_layout", "SELECT doc_id, substr(sha256(text), 1, 2) AS folder, substr(sha256(text), 3) AS rest, 'pack-' || CASE WHEN doc_id < 100000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END || '.pack' AS pack, substr(sha256(text), 1, 12) AS short FROM documents")
def hash_prefix_layout(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", text.hash_prefix(h).alias("folder"), text.hash_rest(h).alias("rest"), text.pack_name(F.col("doc_id")).alias("pack"), text.short_id(h).alias("short"))


@query("sanitize_name", r"WITH s AS (SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_.\-]', '', 'g') AS n FROM pages) SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN 'unnamed' ELSE n END AS name FROM s")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"))


@query(
    "url_parse_backends",
    """WITH u AS (SELECT page_id, page_id % 5 AS k, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS r FROM pages)
    SELECT page_id, ['s3', 'sftp', 'webdav', 'file', NULL][k + 1] AS kind, CASE WHEN k < 3 THEN split_part(r, '/', 1) END AS host,
    CASE WHEN k = 1 THEN 22 END AS port, CASE WHEN k < 3 THEN regexp_replace(r, '^[^/]*/?', '') WHEN k = 3 THEN r END AS path, k = 4 AS error FROM u""",
)
def url_parse_backends(spark, sf_dir):
    rest = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    scheme = F.element_at(F.array(*[F.lit(x) for x in ("s3://", "sftp://", "webdav://", "", "ftp://")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.parse_backend_url(F.concat(scheme, rest)).alias("u")).select("page_id", "u.*")


@query(
    "symlink_target_validation",
    """WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || url WHEN 1 THEN '../' || page_id WHEN 2 THEN 'a/' || page_id ELSE 'a/../b' END AS target FROM pages)
    SELECT page_id, NOT starts_with(target, '/') AND NOT list_contains(string_split(target, '/'), '..') AS safe FROM t""",
)
def symlink_target_validation(spark, sf_dir):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    target = F.when(k == 0, F.concat(F.lit("/"), "url")).when(k == 1, F.concat(F.lit("../"), i)).when(k == 2, F.concat(F.lit("a/"), i)).otherwise("a/../b")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_symlink_target(target).alias("safe"))


@query("rebase_paths", f"WITH {FILES} SELECT doc_id, CASE WHEN starts_with(path, 'de/') THEN substr(path, 4) ELSE path END AS relative, '/mnt/snap/' || path AS rebased FROM files")
def rebase_paths(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", text.relative_path(F.col("path"), "de").alias("relative"), text.rebase_path(F.concat(F.lit("/"), "path"), "/mnt/snap").alias("rebased"))


@query("file_index_lookup", f"WITH {FILES} SELECT path, size FROM files WHERE path IN ('en/src1/doc-1.txt', 'de/src0/doc-100.txt')")
def file_index_lookup(spark, sf_dir):
    entries = files(spark, sf_dir).select("path", F.lit("t").alias("mtime"), F.lit("s").alias("snapshot_id"), "size")
    wanted = spark.createDataFrame([("en/src1/doc-1.txt",), ("de/src0/doc-100.txt",)], "path string")
    return indexes.lookup(entries, wanted).select("path", "size")


# --- audit and restore ---------------------------------------------------------------------

BAD = "bad AS (SELECT chunk_hash, p_partkey FROM idx WHERE p_partkey % 97 = 0)"


def _bad(spark, sf_dir):
    return index(spark, sf_dir).where("p_partkey % 97 = 0")


@query("files_with_bad_chunks", f"WITH {REFS}, {IDX}, {BAD} SELECT snapshot_id, path, count(DISTINCT chunk_hash) AS bad_chunks FROM refs WHERE chunk_hash IN (SELECT chunk_hash FROM bad) GROUP BY ALL")
def files_with_bad_chunks(spark, sf_dir):
    return audit.broken_files(references(spark, sf_dir), _bad(spark, sf_dir))


@query(
    "verify_report",
    f"WITH {IDX}, s AS (SELECT CASE WHEN pack_id % 10 = 3 THEN 'missing' ELSE 'ok' END AS status FROM idx) SELECT count(*) AS checked, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing') AS missing, CAST(0 AS BIGINT) AS corrupt, count(*) FILTER (status <> 'ok') AS bad FROM s",
)
def verify_report(spark, sf_dir):
    i = index(spark, sf_dir)
    return audit.summary(audit.verify_quick(i, i.where("pack_id % 10 <> 3")))


@query(
    "verify_full_report",
    "WITH s AS (SELECT DISTINCT sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) % 11 AS k FROM documents) SELECT count(*) AS checked, count(*) FILTER (k > 1) AS ok, count(*) FILTER (k = 0) AS missing, count(*) FILTER (k = 1) AS corrupt, count(*) FILTER (k <= 1) AS bad FROM s",
)
def verify_full_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(dedup.chunk_hash(F.col("text")).alias("chunk_hash")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    stored = d.where("doc_id % 11 <> 0").select("chunk_hash", F.when(F.col("doc_id") % 11 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("stored"))
    return audit.summary(audit.verify_full(d, stored))


@query("sample_verify_size", f"WITH {IDX} SELECT least(count(DISTINCT chunk_hash), 25) AS checked FROM idx")
def sample_verify_size(spark, sf_dir):
    return audit.sample(index(spark, sf_dir), 25, seed=1).agg(F.count("*").alias("checked"))


GROUPS = "m AS (SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 8 AS g, p_brand FROM part), mb AS (SELECT p_brand || '-' || g AS group_no, count(*) AS members, count(*) FILTER (p_partkey % 9 = 0) AS bad FROM m GROUP BY ALL)"


def _members(spark, sf_dir):
    chunks = index(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    grouped = packing.parity_groups(chunks, 8, "p_brand", "p_partkey")
    return grouped.withColumn("group_no", F.concat("p_brand", F.lit("-"), F.col("group_no").cast("string")))


@query("bad_chunks_by_parity_group", f"WITH {GROUPS} SELECT group_no, members, bad FROM mb WHERE bad > 0")
def bad_chunks_by_parity_group(spark, sf_dir):
    return audit.repair_plan(_members(spark, sf_dir), index(spark, sf_dir).where("p_partkey % 9 = 0"), 1).drop("repairable")


@query("repairable_groups", f"WITH {GROUPS} SELECT group_no, bad <= 1 AS repairable FROM mb WHERE bad > 0")
def repairable_groups(spark, sf_dir):
    return audit.repair_plan(_members(spark, sf_dir), index(spark, sf_dir).where("p_partkey % 9 = 0"), 1).select("group_no", "repairable")


@query(
    "restore_counters",
    f"WITH {FILES}, w AS (SELECT size, regexp_full_match(path, '(.*/)?fr/.*', 's') AS wanted FROM files) SELECT count(*) FILTER (wanted) AS restored, count(*) FILTER (NOT wanted) AS skipped, CAST(coalesce(sum(size) FILTER (wanted), 0) AS BIGINT) AS bytes FROM w",
)
def restore_counters(spark, sf_dir):
    return audit.restore_counters(files(spark, sf_dir), text.matches_globs(F.col("path"), ["fr/*"]))


def _chunked(spark, sf_dir, payload=False):
    """(doc_id, pos, start, length, chunk_hash) by content, with sizes for short texts."""
    return chunker.chunk_files(table(spark, sf_dir, "documents"), "doc_id", "text", 256, 1024, 4096, payload)


# Chunks by the definition of the rolling hash. It is turned by each byte's place, so that one exclusive-or over 32 rows gives it at any
# place; a recursion over the candidates applies the length limits.
CUTS = """
RECURSIVE seed AS (SELECT 0 AS i, CAST(81985529216486895 AS HUGEINT) AS x
  UNION ALL SELECT i + 1, xor(b, (b << 17) & 18446744073709551615::HUGEINT) FROM (SELECT i, xor(a, a >> 7) AS b FROM (SELECT i, xor(x, (x << 13) & 18446744073709551615::HUGEINT) AS a FROM seed WHERE i < 256))),
words AS MATERIALIZED (SELECT i - 1 AS byte, CAST(x & 4294967295::HUGEINT AS BIGINT) AS w FROM seed WHERE i > 0),
raw AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
pairs AS (SELECT doc_id, regexp_extract_all(h, '..') AS p FROM raw),
bytes AS (SELECT doc_id, CAST('0x' || unnest(p) AS BIGINT) AS byte, generate_subscripts(p, 1) - 1 AS i FROM pairs),
turned AS (SELECT doc_id, i, ((w << CAST((32 - i % 32) % 32 AS INTEGER)) | (w >> CAST(i % 32 AS INTEGER))) & 4294967295 AS r FROM bytes JOIN words USING (byte)),
rolled AS (SELECT doc_id, i, bit_xor(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS r FROM turned),
ends AS MATERIALIZED (SELECT doc_id, i + 1 AS e FROM rolled WHERE i >= 31 AND (((r << CAST(i % 32 AS INTEGER)) | (r >> CAST(32 - i % 32 AS INTEGER))) & 511) = 511),
cuts AS (SELECT doc_id, -1 AS pos, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, n FROM raw
  UNION ALL SELECT c.doc_id, c.pos + 1, c.stop, least(c.n, c.stop + 4096, coalesce(min(e.e), c.n)), c.n FROM cuts AS c LEFT JOIN ends AS e ON e.doc_id = c.doc_id AND e.e >= c.stop + 256 WHERE c.stop < c.n GROUP BY c.doc_id, c.pos, c.stop, c.n),
pieces AS (SELECT doc_id, pos, start, stop - start AS length, sha256(unhex(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)))) AS chunk_hash FROM cuts JOIN raw USING (doc_id) WHERE pos >= 0)
"""


@query("cdc_cut_positions", f"WITH {CUTS} SELECT doc_id, pos, start, length, chunk_hash FROM pieces")
def cdc_cut_positions(spark, sf_dir):
    return _chunked(spark, sf_dir)


@query("cdc_invariants", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, true AS lengths_ok FROM documents WHERE text <> ''")
def cdc_invariants(spark, sf_dir):
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    ok = (F.col("length") <= 4096) & ((F.col("length") >= 256) | (F.col("pos") == last))
    return _chunked(spark, sf_dir).withColumn("ok", ok).groupBy("doc_id").agg(F.sum("length").alias("bytes"), F.min("ok").alias("lengths_ok"))


@query("cdc_chunk_dedup", f"WITH {CUTS} SELECT chunk_hash, count(*) AS occurrences, count(DISTINCT doc_id) AS files, max(length) AS length FROM pieces GROUP BY chunk_hash")
def cdc_chunk_dedup(spark, sf_dir):
    return _chunked(spark, sf_dir).groupBy("chunk_hash").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("files"), F.max("length").alias("length"))


@query("restore_roundtrip", "SELECT doc_id, sha256(text) AS content_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE text <> ''")
def restore_roundtrip(spark, sf_dir):
    """Chunk, deduplicate, compress; then look up, decompress and put together again."""
    chunks = cut(_chunked(spark, sf_dir, payload=True))  # the chunker runs once
    first = chunks.groupBy("chunk_hash").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("chunk_hash", "at.doc_id", "at.pos")
    stored = chunks.join(first, ["chunk_hash", "doc_id", "pos"], "left_semi").select("chunk_hash", codec.compress(F.col("data")).alias("stored"))
    data = stored.select("chunk_hash", codec.decompress(F.col("stored")).alias("data"))
    refs = chunks.select(F.lit(0).alias("snapshot_id"), F.col("doc_id").alias("path"), "pos", "chunk_hash")
    out = audit.restore(refs, data)
    return out.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("bytes"))


@query("compress_ratio")
def compress_ratio(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return raw.withColumn("stored", codec.compress(F.col("raw"))).select("doc_id", F.round(codec.ratio(F.col("raw"), F.col("stored")), 4).alias("ratio"))


@query("aes_roundtrip", "SELECT doc_id, sha256(text) AS content_sha256, octet_length(encode(text)) + 32 AS envelope_bytes, true AS wrong_key_fails FROM documents")
def aes_roundtrip(spark, sf_dir):
    key, other = F.lit(b"0123456789abcdef0123456789abcdef"), F.lit(b"x" * 32)
    sealed = table(spark, sf_dir, "documents").select("doc_id", codec.encrypt(F.col("text"), key, F.substring(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), 1, 12)).alias("e"))
    return sealed.select("doc_id", F.sha2(codec.decrypt(F.col("e"), key), 256).alias("content_sha256"), F.octet_length("e").cast("long").alias("envelope_bytes"), codec.decrypt(F.col("e"), other).isNull().alias("wrong_key_fails"))


@query("parity_encode_repair", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 8 IN (1, 6)")
def parity_encode_repair(spark, sf_dir):
    """Groups of 8 documents get 2 parity shards, lose members 1 and 6, and get them back."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") / 8).cast("long").alias("group_no"), (F.col("doc_id") % 8).cast("int").alias("pos"), F.col("text").cast("binary").alias("payload"))
    shards = parity.add_parity(docs, 8, 2).withColumn("shard", F.when(~F.col("pos").isin(1, 6), F.col("shard")))
    back = parity.repair(shards, 8, 2).join(docs, ["group_no", "pos"])  # short groups have padding for members
    return back.select((F.col("group_no") * 8 + F.col("pos")).alias("doc_id"), F.sha2(F.expr("substring(shard, 1, octet_length(payload))"), 256).alias("content_sha256"))


# --- changes -------------------------------------------------------------------------------


@query("changed_paths_distinct", "SELECT user_id AS path, count(*) AS changes, max(ts) AS last_ts FROM events WHERE event_type <> 'view' GROUP BY user_id")
def changed_paths_distinct(spark, sf_dir):
    return changes.changed_paths(changes.relevant(_changes(spark, sf_dir), ["view"]))


def _changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.col("ts").alias("event_ts"), "event_id")


@query("classify_changes", "SELECT DISTINCT user_id AS path, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'present' ELSE 'deleted' END AS state FROM events")
def classify_changes(spark, sf_dir):
    now = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"))
    return changes.classify(_changes(spark, sf_dir), now)


@query(
    "trigger_batches",
    "WITH f AS (SELECT user_id AS path, min(ts) AS first_ts FROM events GROUP BY user_id), n AS (SELECT path, row_number() OVER (ORDER BY first_ts, path) - 1 AS k FROM f) SELECT path, k // 5 AS batch FROM n",
)
def trigger_batches(spark, sf_dir):
    return changes.batches(_changes(spark, sf_dir), 5)


@query("changes_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS changes, count(DISTINCT user_id) AS paths FROM events GROUP BY ALL")
def changes_tumbling(spark, sf_dir):
    return changes.windowed(_changes(spark, sf_dir), "1 hour")


@query(
    "changes_sliding",
    "WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type AS kind, user_id FROM events) SELECT start, kind, count(*) AS changes, count(DISTINCT user_id) AS paths FROM w GROUP BY ALL",
)
def changes_sliding(spark, sf_dir):
    return changes.windowed(_changes(spark, sf_dir), "1 hour", "30 minutes")


@query(
    "changes_session",
    """WITH g AS (SELECT user_id AS path, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT path, min(ts) AS start, count(*) AS changes FROM s GROUP BY path, k""",
)
def changes_session(spark, sf_dir):
    return changes.sessions(_changes(spark, sf_dir), "2 hours")


@query("wrong_file_hashes", f"WITH {FILES}, {REFS.replace('refs AS', 'unused AS')} SELECT CAST(0 AS INTEGER) AS snapshot_id, path FROM files WHERE doc_id % 13 = 0 AND doc_id % 26 <> 0")
def wrong_file_hashes(spark, sf_dir):
    """Every 13th file has a wrong stored hash; for half of these a bad chunk explains it."""
    f = files(spark, sf_dir).select("doc_id", F.lit(0).alias("snapshot_id"), "path", "node_type", F.array(F.sha2(F.col("path"), 256)).alias("chunk_hashes"))
    right = text.file_hash(F.col("chunk_hashes"))
    nodes = f.withColumn("file_hash", F.when(F.col("doc_id") % 13 == 0, F.lit("?")).otherwise(right))
    refs = dedup.file_chunks(nodes)
    return audit.wrong_file_hashes(nodes, refs, refs.join(f.where("doc_id % 26 = 0").select("path"), "path", "left_semi"))


@query("relocate_after_compaction", f"WITH {IDX} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN pack_id + 1000 ELSE pack_id END AS pack_id, CASE WHEN p_partkey % 5 = 0 THEN 14 ELSE 0 END AS pack_offset FROM idx")
def relocate_after_compaction(spark, sf_dir):
    i = index(spark, sf_dir).withColumn("pack_offset", F.lit(0))
    moved = i.where("p_partkey % 5 = 0").select("chunk_hash", (F.col("pack_id") + 1000).alias("pack_id"), F.lit(14).alias("pack_offset"))
    return retention.relocate(i, moved).select("p_partkey", "pack_id", "pack_offset")


@query("multi_source_tree", f"WITH {FILES} SELECT 'backup-1/documents/' || path AS path, size FROM files UNION ALL SELECT 'backup-1/pages/' || page_id || '.html', CAST(octet_length(encode(html)) AS BIGINT) FROM pages")
def multi_source_tree(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.octet_length("html").cast("long").alias("size"))
    return tree.under_root("backup-1", {"documents": files(spark, sf_dir).select("path", "size"), "pages": p})


# --- pack files ----------------------------------------------------------------------------


def _packed(spark, sf_dir):
    """Texts as chunks, 50 numbers of documents to a pack."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    chunks = docs.select(F.call_function("div", F.col("doc_id"), F.lit(50).cast("long")).alias("pack_id"), "doc_id", F.sha2("text", 256).alias("chunk_hash"), F.col("text").cast("binary").alias("stored"))
    w = Window.partitionBy("pack_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("stored").cast("long") + packing.ENTRY).over(w), F.lit(0).cast("long"))
    return chunks.withColumn("pack_offset", before + packing.HEADER)


PACKED = """c AS (
    SELECT doc_id // 50 AS pack_id, doc_id, sha256(text) AS chunk_hash, CAST(octet_length(encode(text)) AS BIGINT) AS stored_size
    FROM documents WHERE text IS NOT NULL)"""


@query(
    "pack_directory",
    f"WITH {PACKED} SELECT CAST(pack_id AS BIGINT) AS pack_id, chunk_hash, CAST(14 + coalesce(sum(69 + stored_size) OVER (PARTITION BY pack_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pack_offset, stored_size FROM c",
)
def pack_directory(spark, sf_dir):
    """Writes packs and walks their entries."""
    return packs.list_chunks(packs.build_packs(_packed(spark, sf_dir))).drop("error")


@query("pack_checksums", f"WITH {PACKED} SELECT DISTINCT CAST(pack_id AS BIGINT) AS pack_id, CASE WHEN pack_id % 3 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM c")
def pack_checksums(spark, sf_dir):
    """Every third pack loses its last byte to another."""
    built = packs.build_packs(_packed(spark, sf_dir))
    last = F.when(F.substring("content", -1, 1) == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    changed = F.concat(F.substring("content", F.lit(1), F.octet_length("content") - 1), last)
    return packs.verify_packs(built.withColumn("content", F.when(F.col("pack_id") % 3 == 0, changed).otherwise(F.col("content"))))


@query(
    "pack_point_reads",
    f"WITH {PACKED} SELECT chunk_hash, CAST(pack_id AS BIGINT) AS pack_id, CASE WHEN pack_id % 5 = 0 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN pack_id % 5 <> 0 THEN chunk_hash END AS read_sha256 FROM c",
)
def pack_point_reads(spark, sf_dir):
    """Reads each chunk at its place; every fifth pack is gone."""
    placed = _packed(spark, sf_dir)
    read = packs.read_chunks(packs.build_packs(placed).where("pack_id % 5 <> 0"), placed.select("chunk_hash", "pack_id", "pack_offset"))
    return read.select("chunk_hash", "pack_id", "status", F.sha2("stored", 256).alias("read_sha256"))


from lodestrata.plans import operations  # noqa: E402, F401  registers the queries that run a whole repository
