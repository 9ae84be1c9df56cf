"""Versioned tables with one commit record for each version; backup, prune, compact and restore on them.

A version's data is written first, to folders of its own; then its record, under a name that no reader looks at. Last, the
whole record gets its number in ``_commits``, and only if no other writer has that number (a hard link on a local file
system, elsewhere a rename, which has to refuse an existing target, as HDFS does). A reader follows the last
record, so a crash at any point leaves the version before readable and writable, and two writers can't both win.
"""

from __future__ import annotations

import json
import os
import re
import secrets
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if all run in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder, for loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in an order, whatever the order's keys: ranges are dealt to tasks, numbered there, and their counts added up."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(df.repartitionByRange(*by).withColumn("__ls_part", F.spark_partition_id()))
    counts = dealt.groupBy("__ls_part").agg(F.count(F.lit(1)).alias("__ls_n"))
    before = counts.select("__ls_part", (F.sum("__ls_n").over(Window.orderBy("__ls_part")) - F.col("__ls_n")).alias("__ls_base"))  # a row a task
    inside = F.row_number().over(Window.partitionBy("__ls_part").orderBy(*by)) - 1
    return dealt.withColumn("__ls_inside", inside).join(F.broadcast(before), "__ls_part").withColumn(name, F.col("__ls_base") + F.col("__ls_inside")).drop("__ls_part", "__ls_base", "__ls_inside")


class CommitConflict(RuntimeError):
    """Another writer has made the next version."""


class Store:
    """A store at a path that Spark can write to. ``tables`` are named DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}" if rest else self.path)

    def init(self) -> "Store":
        if self._fs.exists(self._at("_commits")):
            raise FileExistsError(f"a store exists at {self.path}")
        self._fs.mkdirs(self._at("_commits"))
        return self

    def version(self) -> int:
        """The last committed version, 0 for an empty store."""
        if not self._fs.exists(self._at("_commits")):
            raise FileNotFoundError(f"no store at {self.path}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_commits"))]
        return max([int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)], default=0)

    def _record(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "note": ""}
        rows = self.spark.read.text(f"{self.path}/_commits/{version:08d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        entry = self._record(self.version() if version is None else version)["tables"][name]
        frames = [self.spark.read.parquet(f"{self.path}/{p}") for p in entry]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, expected: int | None = None, note: str = "") -> int:
        """Writes tables and then the record. ``expected`` is the version that the frames were read from."""
        base = self.version() if expected is None else expected
        tables = dict(self._record(base)["tables"])
        for name, df in {**(replace or {}), **(append or {})}.items():
            folder = f"data/{name}/{base + 1:08d}-{secrets.token_hex(6)}"
            df.write.parquet(f"{self.path}/{folder}")
            tables[name] = ([] if name in (replace or {}) else tables.get(name, [])) + [folder]
        record = self._at(f"_commits/.{base + 1:08d}-{secrets.token_hex(6)}.part")
        stream = self._fs.create(record, False)
        stream.write(bytearray(json.dumps({"tables": tables, "note": note}).encode()))
        stream.close()
        try:
            self._publish(record, self._at(f"_commits/{base + 1:08d}.json"), base + 1)
        finally:
            self._fs.delete(record, False)
        return base + 1

    def _publish(self, record, target, version: int) -> None:
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(record.toUri().getPath(), target.toUri().getPath())
                return
            except FileExistsError as e:
                raise CommitConflict(f"version {version} was made by another writer") from e
        if self._fs.exists(target) or not self._fs.rename(record, target):
            raise CommitConflict(f"version {version} was made by another writer")

    def vacuum(self, hours: float = 24.0) -> int:
        """Deletes data folders that the last version doesn't use and that are older than ``hours``; returns how many.

        Younger ones may be those of a writer that hasn't committed yet; ``hours`` has to exceed the longest write.
        """
        used = {p for entry in self._record(self.version())["tables"].values() for p in entry}
        gone, before = 0, (time.time() - 3600 * hours) * 1000
        if not self._fs.exists(self._at("data")):
            return 0
        for table in self._fs.listStatus(self._at("data")):
            for folder in self._fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in used and folder.getModificationTime() <= before:
                    self._fs.delete(folder.getPath(), True)
                    gone += 1
        return gone
