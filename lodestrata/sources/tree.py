"""File trees as nodes: content through Spark's readers, virtual roots, recursive snapshot documents."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "snapshot_id string, path string, rel_path string, parent_path string, name string, node_type string, depth int, size long, modified string, mode int, target string, file_hash string, chunk_hashes array<string>"


def scan(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, rel_path, size, modified, content) of all files below ``root``; unread columns aren't loaded.

    Spark's file sources leave out files without bytes, so these come from a listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    empty = spark.createDataFrame(_empty_files(spark, root, pattern), "path string, size long, ms long")
    empty = empty.select("path", "size", F.timestamp_millis("ms").alias("modified"), F.lit(b"").alias("content"))
    base = re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    return found.unionAll(empty).select("path", F.regexp_replace("path", f"^.*?{base}/", "").alias("rel_path"), "size", "modified", "content")


def _empty_files(spark: SparkSession, root: str, pattern: str | None) -> list[tuple[str, int, int]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while listing.hasNext():
        f = listing.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and name[0] not in "._" and (pattern is None or fnmatch.fnmatchcase(name, pattern)):
            out.append((f.getPath().toString(), 0, f.getModificationTime()))
    return out


def count_files(files: DataFrame) -> DataFrame:
    """One row: files and bytes, from metadata only."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def under_root(root: str, sources: dict[str, DataFrame]) -> DataFrame:
    """The union of several sources, each below a directory of its name in a virtual root."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("path", F.concat(F.lit(f"{root}/{name}/"), "path"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def flatten_snapshot(document: dict) -> list[dict]:
    """Nodes of one snapshot document, with the root in ``path`` and without it in ``rel_path``; a stack, no recursion."""
    rows, stack = [], [(document["root"], "", "", 0)]
    while stack:
        node, above, rel, depth = stack.pop()
        kind = {"file": "file", "dir": "dir", "directory": "dir", "symlink": "symlink"}[node["type"]]
        path = f"{above}/{node['name']}" if above else node["name"]
        below = "" if depth == 0 else f"{rel}/{node['name']}" if rel else node["name"]
        chunks = node.get("chunks")
        rows.append({"snapshot_id": document["id"], "path": path, "rel_path": below, "parent_path": above or None, "name": node["name"], "node_type": kind, "depth": depth, "size": node.get("size"), "modified": node.get("modified"), "mode": node.get("mode"), "target": node.get("target"), "file_hash": node.get("hash"), "chunk_hashes": chunks if kind == "file" else None})
        stack += [(c, path, below, depth + 1) for c in sorted(node.get("children", []), key=lambda c: c["name"], reverse=True)]
    return rows


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors) of the snapshot documents in a folder; a bad document is reported and doesn't stop the rest."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in NODE.split(", ")]
        for batch in batches:
            for file, value in zip(batch["file"], batch["value"], strict=True):
                try:
                    rows = pd.DataFrame(flatten_snapshot(json.loads(value)), columns=columns)
                    for c, kind in (("size", "Int64"), ("mode", "Int32"), ("depth", "Int32")):
                        rows[c] = rows[c].astype(kind)
                    yield rows.assign(file=file, error=None)
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    yield pd.DataFrame({**{c: [None] for c in columns}, "file": [file], "error": [f"{type(e).__name__}: {e}"]})

    flat = texts.mapInPandas(run, NODE + ", file string, error string")
    return flat.where("error IS NULL").drop("file", "error"), flat.where("error IS NOT NULL").select("file", "error")
