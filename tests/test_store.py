import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrata import session
from lodestrata.operators import lineage, retention
from lodestrata.sources import tree
from lodestrata.store import CommitConflict, Store, numbered
from lodestrata.streaming import changes


def test_commits_and_crashes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").init()
    with pytest.raises(FileExistsError):
        s.init()
    one, two = spark.range(3).withColumnRenamed("id", "x"), spark.range(3, 5).withColumnRenamed("id", "x")
    assert s.commit(replace={"t": one}) == 1
    two.write.parquet(f"{s.path}/data/t/00000002-crashed")  # data of a writer that died before its commit
    assert s.version() == 1 and s.table("t").count() == 3
    assert s.commit(append={"t": two}) == 2
    assert s.table("t").count() == 5 and s.table("t", version=1).count() == 3
    with pytest.raises(CommitConflict):
        s.commit(append={"t": two}, expected=1)
    assert s.vacuum() == 0  # all of it is young enough to be another writer's
    assert s.vacuum(hours=0) == 2 and s.table("t").count() == 5


def test_crash_before_the_record_is_whole(spark, tmp_path, monkeypatch):
    """A writer that dies with its record begun, or whole but without its number, changes nothing; nor does a backup under way lose data to ``vacuum``."""
    s = Store(spark, f"file://{tmp_path}/s").init()
    one = spark.range(3).withColumnRenamed("id", "x")
    s.commit(replace={"t": one})
    stream = s._fs.create(s._at("_commits/.00000002-dead.part"), False)
    assert s.version() == 1
    stream.close()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            s.commit(append={"t": one})
    other = Store(spark, s.path)
    assert other.version() == 1 and other.table("t").count() == 3

    def overtaken(self, record, target, version, publish=Store._publish):
        monkeypatch.setattr(Store, "_publish", publish)
        assert other.vacuum() == 0  # while the data of the first writer isn't committed yet
        other.commit(append={"t": one})
        return publish(self, record, target, version)

    monkeypatch.setattr(Store, "_publish", overtaken)
    with pytest.raises(CommitConflict):
        s.commit(append={"t": one})
    assert s.version() == 2 and s.table("t").count() == 6


def test_long_chain_and_missing_parent(spark):
    rows = [(k, k - 1) for k in range(1, 300)]
    df = spark.createDataFrame(rows, "snapshot_id long, parent_snapshot_id long")
    got = {r.snapshot_id: (r.depth, r.parent_missing) for r in lineage.chain(df, 299).collect()}
    assert len(got) == 299 and got[299] == (0, False) and got[1] == (298, True)


def test_chain_has_no_longest(spark):
    n = 140_000  # more than 17 doublings reach
    df = spark.range(1, n + 1).select(F.col("id").alias("snapshot_id"), (F.col("id") - 1).alias("parent_snapshot_id"))
    got = lineage.chain(df, n).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum(F.col("parent_missing").cast("int")).alias("missing")).first()
    assert tuple(got) == (n, n - 1, 1)
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "snapshot_id long, parent_snapshot_id long")
    assert {tuple(r) for r in lineage.chain(ring, 3).collect()} == {(3, 0, False), (2, 1, False), (1, 2, False)}


def test_retention_keeps_each_rule(spark):
    df = spark.sql("SELECT id AS snapshot_id, timestamp'2024-12-30 10:00:00' - make_interval(0, 0, 0, CAST(d AS INT), CAST(h AS INT)) AS ts FROM VALUES (1, 35, 0), (2, 9, 0), (3, 2, 0), (4, 2, -1), (5, 0, 2), (6, 0, 1) AS t(id, d, h)")
    kept = {r.snapshot_id for r in retention.retention(df, 1, 1, 1).where("keep").collect()}
    assert kept == {1, 2, 4, 6}
    assert retention.retention(df.limit(0), 1, 1, 1).count() == 0


def test_scan_and_snapshots(spark, tmp_path):
    (tmp_path / "in/sub dir").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"hello")
    (tmp_path / "in/sub dir/e.bin").write_bytes(bytes(510))
    (tmp_path / "in/empty").write_bytes(b"")
    found = tree.scan(spark, f"file://{tmp_path}/in")
    assert found.count() == 3 and tree.count_files(found).first().bytes == 515
    doc = {"id": "s1", "root": {"type": "dir", "name": "r", "children": [{"type": "file", "name": "b", "size": 3, "chunks": ["x", "y"], "hash": "h"}, {"type": "symlink", "name": "a", "target": "b"}]}}
    (tmp_path / "snaps").mkdir()
    (tmp_path / "snaps/1.json").write_text(json.dumps(doc))
    (tmp_path / "snaps/2.json").write_text("{")
    nodes, errors = tree.read_snapshots(spark, f"file://{tmp_path}/snaps")
    assert [(r.path, r.rel_path, r.node_type) for r in nodes.orderBy("path").collect()] == [("r", "", "dir"), ("r/a", "a", "symlink"), ("r/b", "b", "file")]
    assert errors.count() == 1


def test_places_in_an_order(spark):
    """One key for nearly all rows, nulls, ties in part of the order, and an empty table."""
    df = spark.range(500).select(F.when(F.col("id") % 50 != 0, F.lit(7)).alias("k"), F.col("id").alias("v")).repartition(5)
    got = numbered(df, "k", "v").collect()
    want = sorted((r.k is not None, r.k or 0, r.v) for r in got)
    assert [r.place for r in sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.v))] == list(range(500)) and len(want) == 500
    assert numbered(df.limit(0), "k").count() == 0


def test_session_master(monkeypatch):
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS"):
        monkeypatch.delenv(name, raising=False)
    assert not session.master_given()
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell")
    assert session.master_given()


def test_stream_replay_commits_once(spark, tmp_path):
    schema = "path string, kind string, event_ts timestamp"
    rows = spark.sql("SELECT concat('f', id % 7) AS path, 'modify' AS kind, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS event_ts FROM range(40)")
    rows.repartition(4).write.parquet(f"file://{tmp_path}/feed")
    s = Store(spark, f"file://{tmp_path}/store").init()
    done = set()

    def commit(frame, number):
        if number not in done:
            s.commit(append={"paths": changes.changed_paths(changes.relevant(frame)).select("path")})
            done.add(number)

    for _ in range(2):  # the second run finds nothing new
        changes.run_batches(changes.source(spark, f"file://{tmp_path}/feed", schema), commit, f"file://{tmp_path}/ck", once=True).awaitTermination(60)
    assert s.table("paths").distinct().count() == 7 and len(done) == 1


def test_stream_trigger(spark, tmp_path):
    spark.sql("SELECT concat('f', id) AS path, 'modify' AS kind, timestamp'2024-01-01' AS event_ts FROM range(12)").write.parquet(f"file://{tmp_path}/feed")
    out = changes.triggered(changes.source(spark, f"file://{tmp_path}/feed"), size=5, lanes=1)
    q = out.writeStream.format("memory").queryName("fired").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").start()
    until = time.time() + 60  # a query with timers always has a batch to run, so it is never idle
    while time.time() < until and spark.table("fired").count() == 0:
        q.awaitTermination(1)
    q.stop()
    fired = spark.table("fired").select(F.explode("paths").alias("p"), "reason").collect()
    assert {r.p for r in fired} == {f"f{k}" for k in range(12)} and {r.reason for r in fired} == {"count"}
