import hashlib
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata import config
from lodestrata.repository import Repository
from lodestrata.sources import indexes, packs, tree
from lodestrata.store import Store

SMALL = dict(chunk_min_size=256, chunk_target_size=1024, chunk_max_size=4096, ecc_data_shards=4, ecc_parity_shards=2, pack_target_size=8192)


def _files(spark, folder):
    return tree.scan(spark, f"file://{folder}").select(F.col("rel_path").alias("path"), "size", "modified", "content")


def _write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.mark.parametrize("key", [None, b"k" * 32])
def test_backup_prune_repair_restore(spark, tmp_path, key):
    draw = random.Random(7)
    big = draw.randbytes(20_000)
    source = tmp_path / "in"
    for name, data in {"a/one.bin": big, "a/two.bin": big + b"tail" * 300, "empty": b"", "b/x.txt": b"hello"}.items():
        _write(source, name, data)
    settings = config.Config(**SMALL, encryption_enabled=key is not None)
    repo = Repository.create(Store(spark, f"file://{tmp_path}/store"), settings, key)
    links = spark.createDataFrame([("a/link", "one.bin"), ("a/bad", "../../etc/x")], "path string, target string")
    first = repo.backup(_files(spark, source), "host", ["t1"], links, datetime(2024, 1, 1, 8, tzinfo=timezone.utc))
    stats = repo.stats().first()
    assert stats.logical_bytes == 41_205 and stats.raw_bytes < 26_000
    _write(source, "b/x.txt", b"changed!")
    second = repo.backup(_files(spark, source), ts=datetime(2024, 1, 1, 9, tzinfo=timezone.utc))
    assert repo.table("snapshots").where(F.col("snapshot_id") == second).first().parent_snapshot_id == first
    assert repo.versions("b/x.txt").count() == 2 and repo.versions("a/one.bin").count() == 1
    for level in ("quick", "full", "sample"):
        assert {r.status for r in repo.verify(level).collect()} == {"ok"}
    assert repo.wrong_files(repo.verify()).count() == 0

    # two chunks of one group lost, one of another changed
    version = repo.store.version()
    group = repo.table("parity_members").where("NOT is_parity").groupBy("group_no").count().orderBy(F.desc("count"), "group_no").first().group_no
    hashes = [r.chunk_hash for r in repo.table("parity_members").where((F.col("group_no") == group) & ~F.col("is_parity")).collect()]
    lost = hashes[:1]
    other = repo.table("chunks").where(~F.col("chunk_hash").isin(hashes)).orderBy("chunk_hash").first().chunk_hash
    data = repo.table("chunk_data", version).where(~F.col("chunk_hash").isin(lost))
    data = data.withColumn("stored", F.when(F.col("chunk_hash") == other, F.lit(b"junk")).otherwise(F.col("stored")))
    repo.store.commit(replace={"chunk_data": data}, expected=version)
    assert sorted(r.status for r in repo.verify().where("status <> 'ok'").collect()) == ["corrupt", "missing"]
    assert {r.chunk_hash: r.repaired for r in repo.repair().collect()} == {lost[0]: True, other: True}
    assert repo.verify().where("status <> 'ok'").count() == 0

    gone = repo.prune(1, 0, 0)
    assert [r.snapshot_id for r in gone.collect()] == [first]
    report = repo.compact().first()
    assert repo.table("chunk_data").count() == report.kept == repo.table("chunks").count()
    out = tmp_path / "out"
    got = {r.path: r.status for r in repo.restore(str(out)).collect()}
    assert got == {"a/one.bin": "ok", "a/two.bin": "ok", "empty": "ok", "b/x.txt": "ok"}
    for name in got:
        assert (out / name).read_bytes() == (source / name).read_bytes()
    assert {r.status for r in repo.restore(str(out)).collect()} == {"exists"}
    assert repo.restore(str(out), patterns=["a/*"], dry_run=True).count() == 2
    copy = repo.copy_to(Store(spark, f"file://{tmp_path}/copy"))
    assert copy.verify().count() == repo.verify().count()
    if key:  # neither plans nor the nonce show the key
        files = _files(spark, source)
        frame = files.select(repo._encrypted(F.col("content")).alias("x"), repo._open(F.col("content")).alias("y"))
        plan = frame._jdf.queryExecution().toString()
        assert key.hex().lower() not in plan.lower() and key.decode() not in plan and "107, 107, 107" not in plan
    assert repo.store.vacuum(hours=0) > 0 and repo.verify().where("status <> 'ok'").count() == 0


def test_links_and_missing_chunks(spark, tmp_path):
    _write(tmp_path / "in", "f", b"x" * 900)
    repo = Repository.create(Store(spark, f"file://{tmp_path}/store"), config.Config(**SMALL))
    links = spark.createDataFrame([("good", "f"), ("bad", "../f"), ("far", "/etc/x")], "path string, target string")
    repo.backup(_files(spark, tmp_path / "in"), links=links)
    version = repo.store.version()
    got = {r.path: r.status for r in repo.restore(str(tmp_path / "out")).collect()}
    assert got == {"f": "ok", "good": "ok", "bad": "unsafe", "far": "unsafe"}
    assert os.readlink(tmp_path / "out/good") == "f"
    repo.store.commit(replace={"chunk_data": repo.table("chunk_data", version).limit(0)}, expected=version)
    got = {r.path: r.status for r in repo.restore(str(tmp_path / "out2"), patterns=["f"]).collect()}
    assert got == {"f": "missing chunks"} and not (tmp_path / "out2/f").exists()


def test_empty_source_and_limits(spark, tmp_path):
    repo = Repository.create(Store(spark, f"file://{tmp_path}/store"), config.Config(**SMALL))
    files = spark.createDataFrame([], "path string, size long, modified timestamp, content binary")
    first = repo.backup(files)
    row = repo.table("snapshots").first()
    assert (row.snapshot_id, row.total_size, row.total_chunks, row.files) == (first, 0, 0, 0)
    assert repo.verify().count() == 0 and repo.repair().count() == 0 and repo.compact().first().kept == 0
    assert repo.prune(0, 0, 0, dry_run=True).count() == 1 and repo.table("snapshots").count() == 1
    assert repo.delete(["unknown"]).count() == 0 and repo.delete([first]).count() == 1
    assert repo.table("snapshots").count() == 0 and repo.prune_to_size().count() == 0
    for bad in (dict(compression_level=0), dict(chunk_min_size=0), dict(chunk_max_size=64 << 10), dict(chunk_target_size=1), dict(ecc_data_shards=0), dict(ecc_parity_shards=0), dict(ecc_data_shards=250)):
        with pytest.raises(ValueError):
            config.Config(**bad)
    settings = config.Config(max_size=5)
    assert config.loads(settings.dumps()) == settings and config.loads("min_snapshots = 4\nother = 1").min_snapshots == 4
    with pytest.raises(ValueError):
        Repository(repo.store, config.Config(encryption_enabled=True))


def test_pack_files(spark, tmp_path):
    draw = random.Random(3)
    parts = [draw.randbytes(draw.randrange(0, 3000)) for _ in range(40)]
    rows = sorted({hashlib.sha256(p).hexdigest(): p for p in parts}.items())
    from lodestrata.operators import packing

    chunks = spark.createDataFrame([("l", h, p) for h, p in rows], "lane string, chunk_hash string, stored binary").withColumn("stored_size", F.octet_length("stored").cast("long"))
    placed = packing.exact_packs(chunks, 8192, "lane", "chunk_hash").join(chunks.select("chunk_hash", "stored"), "chunk_hash").withColumn("pack_id", F.col("pack_no") + 1)
    built = packs.build_packs(placed)
    folder = tmp_path / "packs"
    done = packs.export_packs(built, str(folder)).collect()
    (folder / "pack-12.pack").write_bytes(b"")
    assert sorted(os.listdir(folder)) == ["pack-" + "%06d.pack" % (k + 1) for k in range(len(done))] + ["pack-12.pack"]
    read = packs.read_packs(spark, f"file://{folder}")
    assert [r.pack_id for r in packs.list_pack_ids(spark, f"file://{folder}").collect()] == list(range(1, len(done) + 1))
    assert {r.status for r in packs.verify_packs(read).collect()} == {"ok"}
    listed = {(r.chunk_hash, r.pack_offset, r.stored_size) for r in packs.list_chunks(read).collect()}
    assert listed == {(r.chunk_hash, r.pack_offset, r.stored_size) for r in placed.collect()}
    got = packs.read_chunks(read, placed.select("chunk_hash", "pack_id", "pack_offset")).collect()
    assert {r.chunk_hash: bytes(r.stored) for r in got} == dict(rows) and {r.status for r in got} == {"ok"}
    wrong = placed.select("chunk_hash", "pack_id", (F.col("pack_offset") + 1).alias("pack_offset"))
    assert {r.status for r in packs.read_chunks(read, wrong).collect()} == {"misplaced"}
    gone = placed.select("chunk_hash", (F.col("pack_id") + 99).alias("pack_id"), "pack_offset")
    assert {r.status for r in packs.read_chunks(read, gone).collect()} == {"missing"}
    whole = packs.encode_pack(5, rows[:2])
    cases = {1: b"", 2: None, 3: b"XXXX" + whole[4:], 4: whole[:100] + b"?" + whole[101:], 5: whole}
    odd = spark.createDataFrame(list(cases.items()), "pack_id long, content binary")
    assert {r.pack_id: r.status for r in packs.verify_packs(odd).collect()} == {1: "short", 2: "short", 3: "not a pack", 4: "corrupt", 5: "ok"}
    assert packs.list_chunks(odd.where("pack_id <= 3")).where("error IS NULL").count() == 0


def test_index_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"entries": {"ab": {"hash": "ab", "size": 9, "compressed_size": 7, "refs": 3, "parity_group": 0, "pack_id": 1, "pack_offset": 14}}}')
    (tmp_path / "p.json").write_text('{"groups": [{"group_id": 4, "data_chunk_hashes": ["a", "b"], "parity_chunk_hashes": ["p"], "chunk_size": 8}]}')
    (tmp_path / "w.json").write_text('["x", "y", "x"]')
    assert [tuple(r) for r in indexes.read_chunk_index(spark, f"file://{tmp_path}/c.json").collect()] == [("ab", 9, 7, 1, 14, 0)]
    members = indexes.read_parity_index(spark, f"file://{tmp_path}/p.json")
    assert [tuple(r) for r in members.orderBy("pos").collect()] == [(4, 0, False, "a", 8), (4, 1, False, "b", 8), (4, 2, True, "p", 8)]
    assert tuple(indexes.parity_groups(members).first()) == (4, ["a", "b"], ["p"], 8)
    assert indexes.changed_paths(spark, f"file://{tmp_path}/w.json").count() == 2
    assert indexes.changed_paths(spark, f"file://{tmp_path}/none.json").count() == 0
    files = spark.createDataFrame([("f", "t", "s1", ["a"])], indexes.FILE)
    assert indexes.remove_snapshot(indexes.add_files(files, files), "s1").count() == 0


def test_backup_of_changed_paths(spark, tmp_path):
    """A changed file, a new one, a deleted directory, a path that never was, and one that repeats; without a snapshot before, the files are all there is."""
    folder = tmp_path / "in"
    for name, data in {"d/a": b"a" * 700, "d/sub/b": b"b" * 700, "keep": b"k" * 700, "gone/x": b"x"}.items():
        _write(folder, name, data)
    repo = Repository.create(Store(spark, f"file://{tmp_path}/store"), config.Config(**SMALL))
    changed = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    first = repo.backup_changes(changed("d/a", "d/sub/b", "keep", "gone/x"), _files(spark, folder))
    full = repo.backup(_files(spark, folder))
    paths = lambda i: {r.path: r.file_hash for r in repo.table("nodes").where(F.col("snapshot_id") == i).collect()}
    assert paths(first) == paths(full) and set(paths(full)) == {"d/a", "d/sub/b", "keep", "gone/x"}
    _write(folder, "d/a", b"new")
    _write(folder, "e/f/g", b"")
    (folder / "gone/x").unlink()
    last = repo.backup_changes(changed("d/a", "d/a", "e/f/g", "gone", "never"), _files(spark, folder))
    assert set(paths(last)) == {"d/a", "d/sub/b", "keep", "e/f/g"} and paths(last)["d/a"] != paths(full)["d/a"] and paths(last)["keep"] == paths(full)["keep"]
    row = repo.table("snapshots").where(F.col("snapshot_id") == last).first()
    assert (row.parent_snapshot_id, row.files, row.total_size) == (full, 4, 3 + 700 + 700)
    assert repo.verify().where("status <> 'ok'").count() == 0
    assert repo.backup_changes(changed(), _files(spark, folder).limit(0)) and repo.table("snapshots").count() == 4
    assert repo.forget(["unknown"]).count() == 0
