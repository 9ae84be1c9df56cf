"""Shared parts: scratch tables in the cluster's shared folder and vectorised text kernels."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- scratch tables ------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if all run in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage. Every table is written once, to a folder of its own.

    A reader of a table outlives the loss of any executor, as the files are in the shared folder.
    ``drop`` removes tables that no later plan reads; the others stay with the session's folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; columns that ``df`` lacks are null. Other columns never meet ours."""
    return df.select(*[(F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])


def lowest_hashes(rows: DataFrame, want: int, *key: str, group: str | None = None) -> DataFrame:
    """The ``want`` rows (of each group) whose keys have the lowest hashes, with their ``place``: a bounded sample.

    Groups are counted first (a written table, so that Spark knows its size and joins it accordingly), and only rows below a hash that about 4 * want + 64 rows of a group are below
    are ranked, so no task sees more of a large group, however many tasks there are.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    by = F.col(group) if group else F.lit("all")
    keyed = rows.withColumns({"__ls_g": by, "__ls_h": h})
    counts = Scratch(rows.sparkSession, "counts").keep(keyed.groupBy("__ls_g").agg(F.count(F.lit(1)).alias("__ls_n")))
    joined = keyed.join(counts, "__ls_g")
    low = joined.where(F.col("__ls_h") * F.col("__ls_n").cast("double") < float((4 * want + 64) * (1 << 40)))
    order = Window.partitionBy("__ls_g").orderBy("__ls_h", *key)
    return low.withColumn("place", F.row_number().over(order)).where(F.col("place") <= want).drop("__ls_g", "__ls_h", "__ls_n")


def tidy(run):
    """``run`` (batches to batches), and at its end freed memory goes back to the system.

    Workers stay for later tasks; without this each keeps the peak of all it has done.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- Arrow strings -------------------------------------------------------------------------


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one buffer, and each row's bounds in it; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- word hashes ---------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_PIECE = 1 << 20


def _byte_values(separators: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte, A-Z as a-z; 0 for separators."""
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[separators] = 0
    return values


def _space_separators() -> np.ndarray:
    return np.array([9, 10, 11, 12, 13, 32])


def _non_alphanumeric_separators() -> np.ndarray:
    return np.array([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def word_values(kind: str) -> np.ndarray:
    """``space``: words are runs without 20, 09-0D. ``alnum``: runs of 0-9, a-z and non-ASCII (after lower-casing A-Z)."""
    if kind == "space":
        return _byte_values(_space_separators())
    drop = _non_alphanumeric_separators()
    values = _byte_values(drop)
    values[65:91] = values[97:123]
    return values


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hash_piece(buf: np.ndarray, breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one piece; a word also ends at each of ``breaks``."""
    v = values[buf]
    inside = v != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(buf))]
    if len(cut):
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(buf) + 1)
    v *= up[: len(buf)]
    np.cumsum(v, out=v)
    before = np.where(starts > 0, v[starts - 1], np.uint64(0))
    return mix64((v[stops - 1] - before) * down[starts]), starts


def hash_words(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, in order, and each row's bounds among them.

    Bytes are worked through in pieces of about 1 MiB, cut where rows end or at separators, so
    that memory does not follow the length of a text.
    """
    hashes, starts, n, at = [], [], len(buf), 0
    while at < n:
        end = min(n, at + _PIECE)
        if end < n:
            k = np.searchsorted(offsets, end, "right") - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:  # one long row: back to its last separator, or on to its next
                gaps = np.flatnonzero(values[buf[at:end]] == 0)
                while not len(gaps) and end < n:
                    more = min(n, end + _PIECE)
                    gaps = np.flatnonzero(values[buf[end:more]] == 0) + (end - at)
                    end = more
                end = at + int(gaps[-1]) + 1 if len(gaps) else n
                k = np.searchsorted(offsets, at, "right")
                if k < len(offsets):
                    end = min(end, max(int(offsets[k]), at + 1))
        low, high = np.searchsorted(offsets, (at, end))
        h, s = _hash_piece(buf[at:end], offsets[low:high] - at, values)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


# --- token ids -----------------------------------------------------------------------------

_TURN = 1 << 18
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Token ids by the tokenizers library, each distinct word encoded once.

    A tokenizer whose pre-tokenizer drops white space never merges across it, so a text's ids are
    the ids of its words in a row. Words are cut at blanks and line feeds only; all else is left to
    the library. Words of Latin letters with a run of marks behind them are encoded many at a time:
    their ids are told apart by the vocabulary's word ends, and one by one if that count differs.
    Where the tokenizer's file says that it lower-cases and cuts letters from marks, such a word has two units, its
    letters in lower case and its marks, whose ids in a row are the word's; any other word is one unit.
    Units are kept, as Arrow strings, for later batches; beyond ``most`` units only those found twice in a
    batch, and at twice as many the store starts anew.
    """

    MARKS = ".,;:!?%$#&*"
    PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([.,;:!?%$#&*]*)$"
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most: int = 1_200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.in_units = self._cuts_units()
        self.most = most
        self.reset()

    def _cuts_units(self) -> bool:
        """Whether the file's normalizer lower-cases and does nothing else to Latin letters, and its pre-tokenizer cuts by ``CUTS``."""
        import json

        def steps(part: dict | None, name: str) -> list[dict]:
            return [] if not part else part[name] if part["type"] == "Sequence" else [part]

        made = json.loads(self.library.to_str())
        folds, cuts = steps(made["normalizer"], "normalizers"), steps(made["pre_tokenizer"], "pretokenizers")
        return (
            [x["type"] for x in folds] == ["NFC", "Replace", "Lowercase"]
            and folds[1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": self.CUTS}, "Removed", True)
            and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        )

    def reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int32)

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units of the words, and the places there of each word's first and second one (-1: none)."""
        import pyarrow.compute as pc

        second = np.full(len(words), -1, np.int64)
        if not self.in_units:
            return words, np.arange(len(words)), second
        plain = pc.match_substring_regex(words, self.PLAIN)
        letters = pc.utf8_rtrim(words, characters=self.MARKS)
        marked = np.flatnonzero(pc.and_(plain, pc.not_equal(letters, words)).to_numpy(zero_copy_only=False))
        first = pc.if_else(plain, pc.utf8_lower(letters), words)
        size = pc.binary_length(letters).to_numpy()[marked]
        buf, offsets = string_bytes(words.take(pa.array(marked)))
        sizes = np.diff(offsets) - size
        run = buf[spread(offsets[:-1] + size, sizes)]
        marks = pa.LargeStringArray.from_buffers(len(marked), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(run))
        both = pa.concat_arrays([first, marks]).dictionary_encode()
        places = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        second[marked] = places[len(words) :]
        return both.dictionary, places[: len(words)], second

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        units = np.ones(len(words), np.int64)
        last = pc.match_substring_regex(words, "[.,;:!?%$#&*]$").to_numpy(zero_copy_only=False)
        units[last] = 2
        sizes, found = np.zeros(len(words), np.int32), []
        at = np.flatnonzero(plain)
        cuts = np.append(np.arange(0, len(at), 2000), len(at))
        rows = pa.LargeListArray.from_arrays(pa.array(cuts), words.take(pa.array(at)))
        for low, text in zip(cuts[:-1].tolist(), pc.binary_join(rows, pa.scalar(" ", pa.large_string())), strict=True):
            part = at[low : low + 2000]
            ids = np.array(self.library.encode_batch_fast([text.as_py()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            want = np.cumsum(units[part])
            if len(ends) != want[-1] or ends[-1] != len(ids):
                plain[part] = False
                continue
            sizes[part] = np.diff(ends[want - 1], prepend=0)
            found.append((part, ids))
        rest = np.flatnonzero(~plain)
        for low in range(0, len(rest), 2000):
            part = rest[low : low + 2000]
            got = [x.ids for x in self.library.encode_batch_fast(words.take(pa.array(part)).to_pylist(), add_special_tokens=False)]
            sizes[part] = [len(x) for x in got]
            found.append((part, np.array([i for x in got for i in x], np.uint32)))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        out = np.zeros(int(sizes.sum(dtype=np.int64)), np.uint32)
        for part, ids in found:
            out[spread(starts[part], sizes[part])] = ids
        return out, sizes

    def encode_units(self, units: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many units, and each unit's start and size there; new units are encoded. counts: how often the batch has each."""
        import pyarrow.compute as pc

        if len(self.known) > 2 * self.most:
            self.reset()
        slot = pc.index_in(units, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(slot < 0)
        ids, sizes = self.encode_words(units.take(pa.array(new)))
        slot[new] = len(self.sizes) + np.arange(len(new))
        all_ids, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(all_sizes, dtype=np.int64) - all_sizes
        if len(self.known) <= self.most:
            self.known = pa.concat_arrays([self.known, units.take(pa.array(new))])
            self.ids, self.sizes = all_ids, all_sizes
        else:
            again = np.flatnonzero(counts[new] > 1)
            self.known = pa.concat_arrays([self.known, units.take(pa.array(new[again]))])
            self.ids = np.concatenate([self.ids, ids[spread((np.cumsum(sizes) - sizes)[again], sizes[again])]])
            self.sizes = np.concatenate([self.sizes, sizes[again]])
        return all_ids, starts[slot], all_sizes[slot]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and each row's bounds; null is empty."""
        import pyarrow.compute as pc

        column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), "\n", " ")
        parts = pc.split_pattern(column, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        index = words.indices.to_numpy(zero_copy_only=False)
        if not len(index):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        units, first, second = self.units(words.dictionary)
        times = np.bincount(index, minlength=len(first))
        marked = np.flatnonzero(second >= 0)
        counts = np.bincount(first, times, len(units)) + np.bincount(second[marked], times[marked], len(units))
        ids, at, of = self.encode_units(units, counts)
        # the ids of the batch's distinct words
        sizes = of[first].astype(np.int64)
        sizes[marked] += of[second[marked]]
        starts = np.cumsum(sizes) - sizes
        table = np.empty(int(sizes.sum()), np.uint32)
        table[spread(starts, of[first])] = ids[spread(at[first], of[first])]
        table[spread((starts + of[first])[marked], of[second[marked]])] = ids[spread(at[second[marked]], of[second[marked]])]
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        out = np.empty(int(ends[-1]), np.uint32)
        for low in range(0, len(index), _TURN):  # positions are eight bytes an id: some at a time
            part = index[low : low + _TURN]
            out[ends[low] : ends[low + len(part)]] = table[spread(starts[part], sizes[part])]
        return out, ends[bounds]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs (start, size), one run after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file; workers serve many tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenized(batch: pa.RecordBatch, path: str, limit: int = 12 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) of runs of rows of column ``text``, about ``limit`` bytes each."""
    column = batch.column("text").cast(pa.large_string())
    _, offsets = string_bytes(column)
    for low, high in slices(offsets, limit):
        yield low, *tokenizer(path).encode(column.slice(low, high - low))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
