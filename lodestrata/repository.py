"""A deduplicated store: backup, retention, compaction, audit, repair and restore as commits of ``Store``.

Tables: ``snapshots``, ``nodes``, ``chunks`` (chunk_hash, raw_size, stored_size, stored_hash), ``chunk_data``
(chunk_hash, stored_size, stored), ``parity_members`` (group_no, pos, is_parity, chunk_hash, shard_len) and
``parity_data`` (chunk_hash, stored). A chunk is named by the hash of its raw content; references are in the
nodes and are never counted in a table. Every operation reads one version and commits the next.

Cases: an empty source makes a snapshot without files; a file without bytes has no chunks; a file of the same
size and time as in the last snapshot isn't read again; a filter or id that matches nothing changes nothing.
"""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.config import Config
from lodestrata.functions import chunker, codec, parity, text
from lodestrata.operators import audit, dedup, lineage, packing, retention
from lodestrata.sources import packs
from lodestrata.store import Store

TABLES = {
    "snapshots": "snapshot_id string, ts timestamp, hostname string, tags array<string>, total_size long, total_chunks long, files long, parent_snapshot_id string",
    "nodes": "snapshot_id string, path string, node_type string, size long, modified timestamp, mode int, target string, file_hash string, chunk_hashes array<string>",
    "chunks": "chunk_hash string, raw_size long, stored_size long, stored_hash string",
    "chunk_data": "chunk_hash string, stored_size long, stored binary",
    "parity_members": "group_no long, pos int, is_parity boolean, chunk_hash string, shard_len long",
    "parity_data": "chunk_hash string, stored binary",
}


class Repository:
    def __init__(self, store: Store, config: Config | None = None, key: bytes | None = None):
        self.store, self.spark, self.config, self.key = store, store.spark, config or Config(), key
        if self.config.encryption_enabled and key is None:
            raise ValueError("an encrypted store needs its key")

    @classmethod
    def create(cls, store: Store, config: Config | None = None, key: bytes | None = None) -> "Repository":
        """Empty tables in a new store; an existing one is refused."""
        store.init()
        store.commit(replace={n: store.spark.createDataFrame([], s) for n, s in TABLES.items()}, expected=0, note="create")
        return cls(store, config, key)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.table(name, version)

    # --- codec ---------------------------------------------------------------------------

    def _seal(self, raw: Column) -> Column:
        return codec.compress(raw, self.config.compression_level)

    def _encrypted(self, framed: Column) -> Column:
        if not self.config.encryption_enabled:
            return framed
        return codec.encrypt(framed, codec.secret(self.spark, self.key), codec.keyed_nonce(self.spark, framed, self.key))

    def _open(self, stored: Column) -> Column:
        plain = codec.decrypt(stored, codec.secret(self.spark, self.key)) if self.config.encryption_enabled else stored
        return codec.decompress(plain, strict=False)

    # --- backup --------------------------------------------------------------------------

    def backup(self, files: DataFrame, hostname: str = "", tags: list[str] | None = None, links: DataFrame | None = None, ts: datetime | None = None) -> str:
        """Commits a snapshot of ``files`` (path, size, modified, content) and ``links`` (path, target); returns its id.

        Content of changed files is read once, chunked and compressed, and put in a staging folder of the store,
        so that hashes and bytes come from the same read. Of each new hash one copy is stored.
        """
        base = self.store.version()
        ts = ts or datetime.now(timezone.utc)
        before = self.table("snapshots", base).orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(1).collect()
        parent = before[0].snapshot_id if before else None
        snapshot_id = secrets.token_hex(16)
        old = self.table("nodes", base).where((F.col("node_type") == "file") & (F.col("snapshot_id") == F.lit(parent)))
        known = lineage.unchanged(files.select("path", "size", "modified"), old)
        fresh = files.join(known.where(~F.col("reused")).select("path"), "path", "left_semi")
        staged = self._stage(fresh)
        nodes = self._file_nodes(known, staged, snapshot_id)
        if links is not None:
            nodes = nodes.unionByName(links.select(F.lit(snapshot_id).alias("snapshot_id"), "path", F.lit("symlink").alias("node_type"), "target"), allowMissingColumns=True)
        self._commit_snapshot(snapshot_id, parent, nodes, staged, base, ts, hostname, tags)
        return snapshot_id

    def backup_changes(self, changed: DataFrame, files: DataFrame, hostname: str = "", tags: list[str] | None = None, ts: datetime | None = None) -> str:
        """Commits the last snapshot with the ``changed`` paths (path) as they are now in ``files`` (path, size, modified, content); returns its id.

        Only ``files`` among the changed paths are read. A changed path that isn't in ``files`` is deleted, and what is below it too.
        Without a snapshot before, the files are all there is.
        """
        base = self.store.version()
        ts = ts or datetime.now(timezone.utc)
        before = self.table("snapshots", base).orderBy(F.desc("ts"), F.desc("snapshot_id")).limit(1).collect()
        parent = before[0].snapshot_id if before else None
        snapshot_id = secrets.token_hex(16)
        paths = changed.select("path").distinct()
        now = files.join(paths, "path", "left_semi")
        staged = self._stage(now)
        known = now.select("path", "size", "modified", F.lit(False).alias("reused"), F.lit(None).cast("array<string>").alias("chunk_hashes"))
        upserts = self._file_nodes(known, staged, snapshot_id).select(*_columns("nodes"))
        old = self.table("nodes", base).where(F.col("snapshot_id") == F.lit(parent)).withColumn("snapshot_id", F.lit(snapshot_id)).select(*_columns("nodes"))
        deleted = paths.join(now.select("path"), "path", "left_anti")
        nodes = lineage.merge(old, upserts, deleted).where("node_type <> 'dir'")
        self._commit_snapshot(snapshot_id, parent, nodes, staged, base, ts, hostname, tags)
        return snapshot_id

    def _file_nodes(self, known: DataFrame, staged: DataFrame, snapshot_id: str) -> DataFrame:
        """Nodes of the files ``known`` (path, size, modified, reused, chunk_hashes); those that aren't reused get the staged chunks."""
        c = F.array_sort(F.collect_list(F.struct("pos", "chunk_hash")))
        cut = staged.groupBy("path").agg(F.transform(c, lambda x: x["chunk_hash"]).alias("cut"), F.sum("length").alias("read"))
        joined = known.join(cut, "path", "left")
        hashes = F.when(F.col("reused"), F.col("chunk_hashes")).otherwise(F.coalesce("cut", F.array().cast("array<string>")))
        size = F.when(F.col("reused"), F.col("size")).otherwise(F.coalesce("read", F.lit(0).cast("long")))
        nodes = joined.select(
            F.lit(snapshot_id).alias("snapshot_id"), "path", F.lit("file").alias("node_type"), size.alias("size"), "modified", F.lit(None).cast("int").alias("mode"), F.lit(None).cast("string").alias("target"), hashes.alias("chunk_hashes")
        )
        return nodes.withColumn("file_hash", text.file_hash(F.col("chunk_hashes")))

    def _commit_snapshot(self, snapshot_id: str, parent: str | None, nodes: DataFrame, staged: DataFrame, base: int, ts: datetime, hostname: str, tags: list[str] | None) -> None:
        nodes = self._staged("nodes", nodes.select(*_columns("nodes")))
        first = staged.groupBy("chunk_hash").agg(F.min(F.struct("path", "pos")).alias("at"))
        new = first.join(self.table("chunks", base).select("chunk_hash"), "chunk_hash", "left_anti").select("chunk_hash", "at.path", "at.pos")
        data = staged.join(new, ["chunk_hash", "path", "pos"], "left_semi")
        chunks = data.select("chunk_hash", F.col("length").alias("raw_size"), "stored_size", "stored_hash")
        members, shards = self._parity(data.select("chunk_hash", "stored_size", "stored"), base + 1)
        totals = nodes.agg(*[x for x in (F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.size("chunk_hashes")), F.lit(0)), F.count(F.when(F.col("node_type") == "file", 1)))]).first()
        row = self.spark.createDataFrame([(snapshot_id, ts, hostname, tags or [], int(totals[0]), max(0, int(totals[1])), int(totals[2]), parent)], TABLES["snapshots"])
        frames = {"snapshots": row, "nodes": nodes, "chunks": chunks, "chunk_data": data.select(*_columns("chunk_data")), "parity_members": members, "parity_data": shards}
        self.store.commit(append=frames, expected=base, note=f"backup {snapshot_id}")

    def _staged(self, name: str, df: DataFrame) -> DataFrame:
        folder = f"{self.store.path}/data/_staged/{name}-{secrets.token_hex(6)}"
        df.write.parquet(folder)
        return self.spark.read.parquet(folder)

    def _stage(self, fresh: DataFrame) -> DataFrame:
        s = self.config
        cut = chunker.chunk_files(fresh, "path", "content", s.chunk_min_size, s.chunk_target_size, s.chunk_max_size, payload=True)
        framed = cut.withColumn("framed", self._seal(F.col("data"))).drop("data", "start")
        stored = framed.withColumn("stored", self._encrypted(F.col("framed"))).drop("framed")
        return self._staged("chunks", stored.withColumns({"stored_size": F.octet_length("stored").cast("long"), "stored_hash": F.sha2("stored", 256)}))

    def _parity(self, data: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """Groups of new chunks in lanes by hash prefix, so no task orders all of them."""
        s = self.config
        laned = data.select("chunk_hash", "stored_size").withColumn("lane", F.conv(F.substring("chunk_hash", 1, 2), 16, 10).cast("long"))
        grouped = packing.parity_groups(laned, s.ecc_data_shards, "lane", "chunk_hash")
        number = F.lit(version).cast("long") * F.lit(1 << 32) + F.col("lane") * F.lit(1 << 24) + F.col("group_no")
        placed = grouped.select(number.alias("group_no"), F.col("pos").cast("int").alias("pos"), "chunk_hash", "shard_len")
        payload = placed.join(data.select("chunk_hash", F.col("stored").alias("payload")), "chunk_hash")
        shards = parity.add_parity(payload, s.ecc_data_shards, s.ecc_parity_shards).where("is_parity")
        shards = self._staged("parity", shards.withColumn("chunk_hash", F.sha2("shard", 256)))
        members = placed.withColumn("is_parity", F.lit(False)).unionByName(shards.select("group_no", "pos", "is_parity", "chunk_hash", "shard_len"))
        return members.select(*_columns("parity_members")), shards.select("chunk_hash", F.col("shard").alias("stored"))

    # --- retention and compaction --------------------------------------------------------

    def references(self, version: int | None = None) -> DataFrame:
        return dedup.file_chunks(self.table("nodes", version))

    def prune(self, daily: int, weekly: int, monthly: int, dry_run: bool = False) -> DataFrame:
        """The snapshots that no rule keeps; without ``dry_run`` they go."""
        gone = retention.retention(self.table("snapshots"), daily, weekly, monthly).where(~F.col("keep")).select("snapshot_id")
        return self._remove(gone, dry_run, "prune")

    def delete(self, ids: list[str]) -> DataFrame:
        return self._remove(self.table("snapshots").where(F.col("snapshot_id").isin(ids)).select("snapshot_id"), False, "delete")

    def prune_to_size(self, dry_run: bool = True) -> DataFrame:
        """All but the newest ``min_snapshots`` go once the stored bytes exceed ``max_size`` (0: no limit)."""
        if not self.config.max_size:
            return self.table("snapshots").limit(0).select("snapshot_id")
        used = self.table("chunks").agg(F.coalesce(F.sum("stored_size"), F.lit(0)).alias("bytes"))
        return self._remove(retention.over_limit(self.table("snapshots"), used, self.config.max_size, self.config.min_snapshots), dry_run, "prune to size")

    def _remove(self, gone: DataFrame, dry_run: bool, note: str) -> DataFrame:
        base = self.store.version()
        gone = self._staged("gone", gone)
        if dry_run or gone.isEmpty():
            return gone
        keep = self.table("snapshots", base).join(gone, "snapshot_id", "left_anti")
        nodes = self.table("nodes", base).join(gone, "snapshot_id", "left_anti")
        live = self._live(dedup.file_chunks(nodes), base)
        frames = {"snapshots": keep, "nodes": nodes, "chunks": self.table("chunks", base).join(live, "chunk_hash", "left_semi")}
        self.store.commit(replace=frames, expected=base, note=note)
        return gone

    def _live(self, references: DataFrame, version: int) -> DataFrame:
        """Chunks of files, and all data members of the parity groups that guard one of them."""
        used = references.select("chunk_hash").distinct()
        members = self.table("parity_members", version).where("NOT is_parity")
        groups = members.join(used, "chunk_hash", "left_semi").select("group_no").distinct()
        return used.unionByName(members.join(groups, "group_no", "left_semi").select("chunk_hash")).distinct()

    def forget(self, hashes: list[str]) -> DataFrame:
        """Takes chunks out of the index alone; their data stays until ``compact``. Returns the hashes that were there."""
        base = self.store.version()
        gone = self._staged("gone", self.table("chunks", base).where(F.col("chunk_hash").isin(hashes)).select("chunk_hash"))
        if not gone.isEmpty():
            self.store.commit(replace={"chunks": self.table("chunks", base).join(gone, "chunk_hash", "left_anti")}, expected=base, note="forget")
        return gone

    def compact(self) -> DataFrame:
        """Rewrites the data of indexed chunks and the parity that guards them; one row: kept, discarded, kept_bytes, freed_bytes.

        The folders before stay readable by version until ``vacuum``.
        """
        base = self.store.version()
        index, data, members = self.table("chunks", base), self.table("chunk_data", base), self.table("parity_members", base)
        marked = data.select("chunk_hash", "stored_size").join(index.select("chunk_hash", F.lit(True).alias("live")), "chunk_hash", "left")
        dead, size = F.col("live").isNull(), F.col("stored_size")
        total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0).cast("long"))
        report = self._staged("report", marked.agg(F.count(F.when(~dead, 1)).alias("kept"), F.count(F.when(dead, 1)).alias("discarded"), total(~dead).alias("kept_bytes"), total(dead).alias("freed_bytes")))
        groups = members.where("NOT is_parity").join(index.select("chunk_hash"), "chunk_hash", "left_semi").select("group_no").distinct()
        members = members.join(groups, "group_no", "left_semi").select(*_columns("parity_members"))
        shards = self.table("parity_data", base).join(members.where("is_parity").select("chunk_hash").distinct(), "chunk_hash", "left_semi")
        frames = {"chunk_data": data.join(index.select("chunk_hash"), "chunk_hash", "left_semi"), "parity_members": members, "parity_data": shards}
        self.store.commit(replace=frames, expected=base, note="compact")
        return report

    # --- audit and repair ----------------------------------------------------------------

    def verify(self, level: str = "full", n: int = 100, seed: int = 0, snapshot: str | None = None) -> DataFrame:
        """(chunk_hash, status) of chunks: ``quick`` looks for the data only, ``full`` hashes it, ``sample`` hashes ``n``; or those of one snapshot."""
        if level not in ("quick", "full", "sample"):
            raise ValueError(f"unknown level {level!r}")
        index, data = self.table("chunks"), self.table("chunk_data")
        if snapshot is not None:
            index = index.join(self.references().where(F.col("snapshot_id") == snapshot).select("chunk_hash").distinct(), "chunk_hash", "left_semi")
        if level == "sample":
            index = index.join(audit.sample(index, n, seed), "chunk_hash", "left_semi")
        found = F.lit("") if level == "quick" else F.sha2("stored", 256)
        there = data.select("chunk_hash", found.alias("found"), F.lit(True).alias("there"))
        good = F.lit(True) if level == "quick" else F.col("found") == F.col("stored_hash")
        status = F.when(F.col("there").isNull(), "missing").when(good, "ok").otherwise("corrupt")
        return index.select("chunk_hash", "stored_hash").join(there, "chunk_hash", "left").select("chunk_hash", status.alias("status"))

    def wrong_files(self, statuses: DataFrame) -> DataFrame:
        """(snapshot_id, path) of files whose hash isn't that of their chunk list, bad chunks aside."""
        return audit.wrong_file_hashes(self.table("nodes"), self.references(), statuses.where("status <> 'ok'"))

    def repair(self) -> DataFrame:
        """(chunk_hash, repaired) for bad chunks: solved from parity, cut to size and hashed before they replace the bad data."""
        s, base = self.config, self.store.version()
        bad = self._staged("bad", self.verify().where("status <> 'ok'").select("chunk_hash"))
        members = self.table("parity_members", base)
        groups = members.join(bad, "chunk_hash", "left_semi").where("NOT is_parity").select("group_no").distinct()
        hit = members.join(groups, "group_no", "left_semi")
        index, data = self.table("chunks", base), self.table("chunk_data", base)
        good = data.join(bad, "chunk_hash", "left_anti").join(index, "chunk_hash", "left_semi").select("chunk_hash", "stored")
        whole = self.table("parity_data", base).where(F.sha2("stored", 256) == F.col("chunk_hash")).dropDuplicates(["chunk_hash"])
        held = hit.where("NOT is_parity").join(good, "chunk_hash", "left").unionByName(hit.where("is_parity").join(whole, "chunk_hash", "left"))
        padded = F.when(F.col("stored").isNotNull(), F.rpad("stored", F.col("shard_len").cast("int"), F.lit(b"\x00")))
        shards = held.select("group_no", "pos", padded.alias("shard"), "shard_len")
        # places that a short group never filled hold zeros
        places = hit.groupBy("group_no").agg(F.max("shard_len").alias("shard_len"), F.collect_set(F.when(~F.col("is_parity"), F.col("pos"))).alias("used"))
        unused = places.select("group_no", "shard_len", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(s.ecc_data_shards - 1)), "used")).alias("pos"))
        zeros = unused.select("group_no", "pos", F.rpad(F.lit(b""), F.col("shard_len").cast("int"), F.lit(b"\x00")).alias("shard"), "shard_len")
        solved = parity.repair(shards.unionByName(zeros), s.ecc_data_shards, s.ecc_parity_shards).where("solved")
        back = solved.join(hit.select("group_no", "pos", "chunk_hash"), ["group_no", "pos"]).join(index, "chunk_hash")
        cut = back.withColumn("stored", F.substring("shard", F.lit(1), F.col("stored_size").cast("int"))).where(F.sha2("stored", 256) == F.col("stored_hash"))
        fixed = self._staged("fixed", cut.dropDuplicates(["chunk_hash"]).select(*_columns("chunk_data")))
        if not fixed.isEmpty():
            rest = data.join(fixed.select("chunk_hash"), "chunk_hash", "left_anti")
            self.store.commit(replace={"chunk_data": rest.select(*_columns("chunk_data")).unionByName(fixed)}, expected=base, note="repair")
        return bad.join(fixed.select("chunk_hash", F.lit(True).alias("repaired")), "chunk_hash", "left").select("chunk_hash", F.coalesce("repaired", F.lit(False)).alias("repaired"))

    # --- restore and lineage -------------------------------------------------------------

    def nodes_of(self, wanted: str = "latest", patterns: list[str] | None = None) -> DataFrame:
        """Nodes of the snapshot that ``wanted`` names (latest, id prefix or tag), filtered by globs."""
        found = lineage.resolve(self.table("snapshots"), wanted).select("snapshot_id")
        nodes = self.table("nodes").join(F.broadcast(found), "snapshot_id", "left_semi")  # one row
        return nodes.where(text.matches_globs(F.col("path"), patterns or []))

    def listing(self, wanted: str = "latest", patterns: list[str] | None = None) -> DataFrame:
        """(kind, path, size_text, modified): a long listing of a snapshot's nodes; kind is ``-`` for files and ``l`` for links."""
        kind = F.when(F.col("node_type") == "symlink", "l").otherwise("-")
        size = F.when(F.col("node_type") == "file", text.format_size(F.coalesce("size", F.lit(0).cast("long"))))
        return self.nodes_of(wanted, patterns).select(kind.alias("kind"), "path", size.alias("size_text"), F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))

    def restore(self, target: str, wanted: str = "latest", patterns: list[str] | None = None, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
        """(path, bytes, status) of the nodes written below ``target``, a path that every worker has mounted.

        Chunks stream to a file in order, so a file needs no memory of its size; it gets its name when it is whole.
        Status: ok, exists (and no ``overwrite``), missing chunks, or unsafe for paths and links that leave the target.
        """
        nodes = self.nodes_of(wanted, patterns)
        if dry_run:
            return nodes.select("path", F.coalesce("size", F.lit(0).cast("long")).alias("bytes"), F.lit("planned").alias("status"))
        data = self.table("chunk_data").select("chunk_hash", self._open(F.col("stored")).alias("raw"))
        sound = F.when(F.sha2("raw", 256) == F.col("chunk_hash"), F.col("raw"))
        listed = nodes.where("node_type IN ('file', 'symlink')").select("path", "node_type", "target", F.posexplode_outer("chunk_hashes").alias("pos", "chunk_hash"))
        parts = listed.join(data, "chunk_hash", "left").select("path", "node_type", "target", "pos", sound.alias("raw"))
        return parts.repartition("path").sortWithinPartitions("path", "pos").mapInPandas(_writer(target, overwrite), "path string, bytes long, status string")

    def versions(self, path: str) -> DataFrame:
        """Versions of one file over all snapshots."""
        dated = self.table("nodes").where((F.col("path") == path) & (F.col("node_type") == "file")).join(self.table("snapshots").select("snapshot_id", "ts"), "snapshot_id")
        return lineage.versions(dated)

    def stats(self) -> DataFrame:
        return dedup.store_stats(self.references(), self.table("chunks"))

    # --- copies and packs ----------------------------------------------------------------

    def copy_to(self, store: Store) -> "Repository":
        """The last version as the first version of a new store, without what only older versions read."""
        version = self.store.version()
        store.init()
        store.commit(replace={n: self.table(n, version) for n in TABLES}, expected=0, note=f"copy of version {version}")
        return Repository(store, self.config, self.key)

    def as_packs(self, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
        """(places, packs): the chunks in pack files. Lanes by hash prefix are laid out apart; a pack's id counts over all of them."""
        sized = self.table("chunks").select("chunk_hash", "stored_size").withColumn("lane", F.substring("chunk_hash", 1, 2))
        placed = self._staged("places", packing.exact_packs(sized, self.config.pack_target_size, "lane", "chunk_hash"))
        counts = placed.groupBy("lane").agg((F.max("pack_no") + 1).alias("n")).collect()  # 256 lanes at most
        at, rows = first_id, []
        for lane, n in sorted((r.lane, r.n) for r in counts):
            rows.append((lane, at))
            at += n
        bases = self.spark.createDataFrame(rows, "lane string, base long")
        places = placed.join(F.broadcast(bases), "lane").select("chunk_hash", "stored_size", (F.col("base") + F.col("pack_no")).alias("pack_id"), "pack_offset")
        return places, packs.build_packs(places.join(self.table("chunk_data").select("chunk_hash", "stored"), "chunk_hash"))


def _columns(name: str) -> list[str]:
    return [c.split(" ")[0] for c in TABLES[name].split(", ")]


def _writer(target: str, overwrite: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch["path"], batch["node_type"], batch["target"], batch["raw"], batch["pos"], strict=True)

        from itertools import groupby

        for path, parts in groupby(rows(), key=lambda r: r[0]):
            size, status = _write_node(target, path, parts, overwrite)
            yield pd.DataFrame({"path": [path], "bytes": [size], "status": [status]})

    return run


class _Missing(Exception):
    pass


def _write_node(target: str, path: str, parts: Iterator[tuple], overwrite: bool) -> tuple[int, str]:
    first = next(parts)
    root = os.path.realpath(target)
    place = os.path.join(root, path.lstrip("/"))
    parent = os.path.realpath(os.path.dirname(place))
    inside = lambda p: p == root or p.startswith(root + os.sep)
    if ".." in path.split("/") or not inside(parent):
        return 0, "unsafe"
    if os.path.lexists(place) and not overwrite:
        return 0, "exists"
    if first[1] == "symlink":
        link = first[2]
        if not link or os.path.isabs(link) or ".." in link.split("/") or not inside(os.path.realpath(os.path.join(parent, link))):
            return 0, "unsafe"
        os.makedirs(parent, exist_ok=True)
        part = f"{place}.{secrets.token_hex(6)}.tmp"
        os.symlink(link, part)
        os.replace(part, place)
        return 0, "ok"

    def content() -> Iterator[bytes]:
        for _, _, _, raw, pos in [first] if pd.isna(first[4]) else _chain(first, parts):
            if pd.isna(pos):
                return
            if raw is None:
                raise _Missing
            yield bytes(raw)

    try:
        return packs.write_whole(place, content()), "ok"
    except _Missing:
        return 0, "missing chunks"


def _chain(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest
