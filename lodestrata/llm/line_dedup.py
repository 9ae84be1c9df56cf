"""Line deduplication across documents, in DataFrame functions only.

A line's key is the line without blanks (20, 09-0D) at its ends, A-Z in lower case. Keys with enough
characters that are found in enough documents lose all their lines but those of the smallest doc_id.

Cases: null and empty texts are one empty line; a line that a single document repeats stays; rows
that repeat a doc_id and its text are one document and lose the same lines; a null doc_id neither
counts as a document nor loses lines; a text that loses all its lines is empty; an empty table
gives an empty table; other columns stay as they are in ``dedup_lines`` and are ignored in ``line_report``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """One row for each line whose key is long enough: its key as two hashes, its document and its place."""
    lines = rows.where("__ls_id IS NOT NULL").select("__ls_id", "__ls_text_hash", F.posexplode(F.split("__ls_text", "\n")).alias("__ls_at", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "__ls_id", "__ls_text_hash", "__ls_at")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__ls_id": F.col("doc_id").cast("long"), "__ls_text": text, "__ls_text_hash": F.xxhash64(text)})


def _with_kept(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``docs`` with __ls_lines (all lines), __ls_n (their number), __ls_drop (places to drop, null for none) and __ls_kept.

    The keys are made once and written, some 20 bytes a line. Shuffles: 24 bytes for each distinct key of a task, 36 for each line, and the texts once.
    The repeated keys are written to a table of their own, so the join's two sides are both dealt out
    afresh and AQE can split a key that a third of all documents share.
    """
    rows = _rows(docs)
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_keys(rows, least_chars))
    if least_docs <= 2:
        found = lines.groupBy("h1", "h2").agg(F.min("__ls_id").alias("first"), F.max("__ls_id").alias("last")).where("first < last")
    else:
        each = lines.groupBy("h1", "h2", "__ls_id").agg(F.lit(1).alias("one"))
        found = each.groupBy("h1", "h2").agg(F.min("__ls_id").alias("first"), F.count("one").alias("n")).where(F.col("n") >= least_docs)
    repeated = scratch.keep(found.select("h1", "h2", "first"))
    drops = (
        lines.join(repeated, ["h1", "h2"])
        .where("__ls_id <> first")
        .groupBy("__ls_id", "__ls_text_hash")
        .agg(F.collect_set("__ls_at").alias("__ls_drop"))
    )
    joined = rows.join(drops, ["__ls_id", "__ls_text_hash"], "left").withColumn("__ls_lines", F.split("__ls_text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ls_lines") - 1), F.col("__ls_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__ls_lines"), i)), "\n")
    return joined.withColumns({"__ls_n": F.size("__ls_lines"), "__ls_kept": F.when(F.col("__ls_drop").isNull(), F.col("__ls_text")).otherwise(kept)})


def dedup_lines(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """``docs``, all columns, with the kept lines as text (and n_chars, where there is one, to match)."""
    out = _with_kept(docs, least_chars, least_docs)
    new = {"text": F.col("__ls_kept")} | ({"n_chars": F.char_length("__ls_kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = _with_kept(pick(docs, doc_id="long", text="string"), least_chars, least_docs)
    return out.select(
        F.col("__ls_id").alias("doc_id"),
        F.col("__ls_n").cast("long").alias("n_lines"),
        F.coalesce(F.size("__ls_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.col("__ls_kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.place, k.line, r.first IS NOT NULL AND k.doc_id <> r.first AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
