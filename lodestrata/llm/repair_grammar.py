"""Token ids in grammar-compressed shards (Re-Pair), with random access to each document.

Every shard is one binary value. Frequent pairs of neighbouring ids are replaced by nonterminals
again and again; the rules and each rule's expansion length are stored, so that any document, or
any run of ids, is decoded without the rest of its shard.

Shard format, little-endian:

===========================  ==============================================================
``b"LRP2"``                  magic
6 x uint32                   first nonterminal, rules, symbols, documents, bits of a symbol, bits of a length
uint64                       ids
symbol[rules, 2]             left and right part of each rule; a part is below its own nonterminal
length[rules]                expansion length of each rule, in ids
count[documents+1]           bounds of each document among the symbols
place[documents+1]           bounds of each document among the ids
symbol[symbols]              the symbols
===========================  ==============================================================

The five arrays hold numbers of as many bits as their largest needs (lowest bit first, each array begins on a full byte):
those named symbol or length of the bits in the head, count of the bits of the number of symbols, place of that of ids.

Rows of equal doc_id are put in order by their text's length and hash.

Cases: null text is empty; an empty document holds only its end id; rows that repeat a doc_id are
documents of their own, ordered by length and hash of the text; null doc_ids come first; an empty table
gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, spread, tidy, tokenized

MAGIC = b"LRP2"
SHARD_IDS = 1 << 20
LEAST = 8


def compress(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> bytes:
    """One shard from the ids of its documents. Pairs never reach across two documents.

    In each round the pairs are counted and, from the most frequent on, taken together as long as no
    id is the left part of one and the right part of another; so no two occurrences overlap and all of
    a round's pairs are replaced in one pass. A pair of equal ids shares its id with no other pair of the round and
    takes every second place of a run. Rounds go on until no pair has ``least`` occurrences.

    A pair that is rarer than that stays so, as later rounds only take occurrences away; so a round counts
    only pairs that were frequent in the one before or have one of its symbols.
    """
    seq = ids.astype(np.int64)
    ends = bounds.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    next_symbol = base
    open_ = np.ones(len(seq), bool)  # whether the pair that begins here may be frequent
    while len(seq) >= 2 * least:
        last = ends[1:] - 1
        open_[last[last >= 0]] = False
        where = np.flatnonzero(open_)
        if not len(where):
            break
        key, where = _sorted_pairs(seq, where, next_symbol)
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        found, counts = key[first], np.diff(first, append=len(key))
        keep = counts >= least
        open_[where[np.repeat(~keep, counts)]] = False
        if not keep.any():
            break
        chosen = _disjoint(found[keep], counts[keep])
        numbers = np.full(len(found), -1, np.int64)
        numbers[np.searchsorted(found, chosen)] = np.arange(len(chosen))
        symbol = np.repeat(numbers, counts)
        hit = np.flatnonzero(symbol >= 0)
        hit = hit[np.argsort(where[hit])]
        at, symbol = where[hit], symbol[hit]
        equal = (chosen >> 32 == chosen & 0xFFFFFFFF)[symbol]
        if equal.any():
            stay = ~equal
            stay[np.flatnonzero(equal)[np.isin(at[equal], _alternate(at[equal]), assume_unique=True)]] = True
            at, symbol = at[stay], symbol[stay]
        seq[at] = next_symbol + symbol
        open_[at] = True
        open_[at[at > 0] - 1] = True
        ends = ends - np.searchsorted(at, ends - 2, "right")
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, open_ = seq[stay], open_[stay]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1))
        next_symbol += len(chosen)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths, done = np.ones(len(pairs), np.int64), 0
    for part in rules:  # parts of a round's rules come from earlier rounds
        size = [np.where(part[:, side] < base, 1, lengths[np.maximum(part[:, side] - base, 0)]) for side in (0, 1)]
        lengths[done : done + len(part)] = size[0] + size[1]
        done += len(part)
    wide = max(1, int(next_symbol - 1).bit_length())
    long = max(1, int(lengths.max(initial=1)).bit_length())
    head = np.array([base, len(pairs), len(seq), len(bounds) - 1, wide, long], "<u4")
    arrays = [(pairs.ravel(), wide), (lengths, long), (ends, len(seq).bit_length()), (bounds, int(bounds[-1]).bit_length()), (seq, wide)]
    return b"".join([MAGIC, head.tobytes(), np.array([bounds[-1]], "<u8").tobytes(), *(pack_bits(x, n) for x, n in arrays)])


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits each, one after another, lowest bit first. Eight of them fill whole bytes: one column of bits at a time."""
    n = -(-len(values) // 8)
    if not n or not bits:
        return b""
    rows = np.zeros(8 * n, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(n, 8)
    out = np.zeros((n, bits + 8), np.uint8)  # eight numbers in ``bits`` bytes; the rest stays empty
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        part = rows[:, k] << np.uint64(shift)
        for b in range(-(-(bits + shift) // 8)):
            out[:, at + b] |= (part >> np.uint64(8 * b)).astype(np.uint8)
    return out[:, :bits].tobytes()


def packed_size(count: int, bits: int) -> int:
    return -(-count // 8) * bits


def unpack_bits(data: np.ndarray, low: int, high: int, bits: int) -> np.ndarray:
    """Numbers ``low`` to ``high`` of an array of packed ones."""
    if high <= low or not bits:
        return np.zeros(max(0, high - low), np.int64)
    first, last = low // 8, -(-high // 8)
    rows = np.zeros((last - first, bits + 8), np.uint8)
    rows[:, :bits] = data[first * bits : last * bits].reshape(-1, bits)
    out = np.zeros((last - first, 8), np.uint64)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        for b in range(-(-(bits + shift) // 8)):
            out[:, k] |= rows[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] >>= np.uint64(shift)
    out &= np.uint64((1 << bits) - 1)
    return out.ravel()[low - 8 * first : high - 8 * first].astype(np.int64)


def _sorted_pairs(seq: np.ndarray, where: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that begin at ``where``, sorted, and their places: packed in one integer if it has the room, as plain sorts are fast."""
    wide, deep = symbols.bit_length(), len(seq).bit_length()
    if 2 * wide + deep > 63:
        key = (seq[where] << 32) | seq[where + 1]
        order = np.argsort(key)
        return key[order], where[order]
    both = (((seq[where] << wide) | seq[where + 1]) << deep) | where
    both.sort()
    where = both & ((1 << deep) - 1)
    both >>= deep
    return ((both >> wide) << 32) | (both & ((1 << wide) - 1)), where


def _disjoint(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs by falling count (ties: smaller pair first) whose left and right ids stay apart."""
    order = np.lexsort((found, -counts))
    side: dict[int, int] = {}  # 0 left, 1 right, 2 both
    out = []
    for pair in found[order].tolist():
        left, right = pair >> 32, pair & 0xFFFFFFFF
        if left == right:
            if left not in side:
                side[left] = 2
                out.append(pair)
        elif side.get(left, 0) == 0 and side.get(right, 1) == 1:
            side[left], side[right] = 0, 1
            out.append(pair)
    return np.array(out, np.int64)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Every second position of each run of neighbouring positions, from its first on."""
    if not len(at):
        return at
    new = np.concatenate([[True], np.diff(at) != 1])
    start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return at[(at - start) % 2 == 0]


class Shard:
    """Reader of one stored shard."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        self.base, rules, symbols, self.documents, wide, long = (int(x) for x in np.frombuffer(payload, "<u4", 6, 4))
        ids = int(np.frombuffer(payload, "<u8", 1, 28)[0])
        data, at = np.frombuffer(payload, np.uint8), 36

        def take(n: int, bits: int) -> np.ndarray:
            nonlocal at
            out = data[at : at + packed_size(n, bits)]
            at += len(out)
            return out

        self.wide, self.n_symbols = wide, symbols
        self.rules = unpack_bits(take(2 * rules, wide), 0, 2 * rules, wide).reshape(-1, 2)
        self.lengths = unpack_bits(take(rules, long), 0, rules, long)
        bits = symbols.bit_length()
        self.symbol_bounds = unpack_bits(take(self.documents + 1, bits), 0, self.documents + 1, bits)
        bits = ids.bit_length()
        self.id_bounds = unpack_bits(take(self.documents + 1, bits), 0, self.documents + 1, bits)
        self.packed = take(symbols, wide)

    def symbols(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Some of the shard's symbols; no others are unpacked."""
        return unpack_bits(self.packed, int(low), self.n_symbols if high is None else int(high), self.wide)

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        out[big] = self.lengths[symbols[big] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids below ``symbols``: of many symbols by copying from all rules' expansions, where these are not much longer than the shard."""
        if len(symbols) <= len(self.rules) or int(self.lengths.sum()) > 4 * int(self.id_bounds[-1]):
            return self._open(symbols)
        table = np.concatenate([np.zeros(1, np.uint32), self._open(np.arange(self.base, self.base + len(self.rules)))])
        sizes = self._size(symbols)
        begin = np.zeros(len(symbols), np.int64)
        big = symbols >= self.base
        begin[big] = (1 + np.cumsum(self.lengths) - self.lengths)[symbols[big] - self.base]
        out = table[spread(begin, sizes)]
        out[(np.cumsum(sizes) - sizes)[~big]] = symbols[~big]
        return out

    def _open(self, symbols: np.ndarray) -> np.ndarray:
        """Each pass opens the nonterminals that are left and puts their parts in place."""
        todo = symbols.astype(np.int64)
        sizes = self._size(todo)
        place = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        while len(todo):
            big = todo >= self.base
            out[place[~big]] = todo[~big]
            pair, place = self.rules[todo[big] - self.base], place[big]
            todo = pair.ravel()
            place = np.stack([place, place + self._size(pair[:, 0])], 1).ravel()
        return out

    def document(self, n: int) -> np.ndarray:
        return self.expand(self.symbols(self.symbol_bounds[n], self.symbol_bounds[n + 1]))

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` of the shard: only the symbols that cover them are expanded."""
        high = min(high, int(self.id_bounds[-1]))
        low = max(0, min(low, high))
        first = max(0, int(np.searchsorted(self.id_bounds, low, "right")) - 1)
        end = int(np.searchsorted(self.id_bounds, high, "left"))
        symbols = self.symbols(self.symbol_bounds[first], self.symbol_bounds[min(end, self.documents)])
        ends = np.cumsum(self._size(symbols)) + int(self.id_bounds[first])
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        if low >= high:
            return np.zeros(0, np.uint32)
        skip = low - (int(ends[a - 1]) if a else int(self.id_bounds[first]))
        return self.expand(symbols[a:b])[skip : skip + high - low]


def write_shards(docs: DataFrame, tokenizer_path: str, scratch: Scratch, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Documents in ascending doc_id order as a table of shards (part, shard, doc_ids, n_ids, payload).

    A range shuffle orders the documents; a shard is closed at ``shard_ids`` ids, so a worker holds
    about one shard. A document is never split: one longer than that has a shard of its own.
    """
    schema = "part int, shard int, doc_ids array<long>, n_ids long, payload binary"
    types = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        held, sizes, names, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            row = [[part], [shard], [[x for n in names for x in n]], [int(bounds[-1])], [compress(np.concatenate(held), bounds)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types.types, strict=True)], schema=types)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, bounds in tokenized(batch, tokenizer_path):
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                bounds = bounds + np.arange(n + 1)
                low = 0
                while low < n:
                    high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + shard_ids - total, "right")) - 1))
                    held.append(ids[bounds[low] : bounds[high]])
                    sizes.append(np.diff(bounds[low : high + 1]))
                    names.append(doc_ids[first + low : first + high])
                    total += int(bounds[high] - bounds[low])
                    low = high
                    if total >= shard_ids or low < n:
                        yield close()
                        held, sizes, names, total, shard = [], [], [], 0, shard + 1
        if held:
            yield close()

    rows = pick(docs, doc_id="long", text="string").withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text")})
    order = ["doc_id", "size", "hash"]  # equal or null doc_ids in any number are dealt to many tasks, too
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return scratch.keep(ordered.mapInArrow(tidy(pack), schema), "zstd")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards: doc_id, start, n_tokens, ids_crc32, shard_place, symbols.

    Starts are sums in two steps, over the shards of a part and over the parts, so no task sees more
    than one row for each part or each shard of a part.
    """
    schema = "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long, symbols long"
    types = pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((n, pa.int64()) for n in ("doc_id", "within", "n_tokens", "ids_crc32", "symbols"))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column("payload")[row].as_py())
                doc_ids = batch.column("doc_ids")[row].values
                n = shard.documents
                ids = shard.expand(shard.symbols()).astype("<u4")
                b = shard.id_bounds
                crc = [zlib.crc32(ids[b[k] : b[k + 1]]) for k in range(n)]
                fixed = [pa.array(np.full(n, batch.column(c)[row].as_py(), np.int32)) for c in ("part", "shard")]
                yield pa.RecordBatch.from_arrays([*fixed, doc_ids, pa.array(b[:-1]), pa.array(np.diff(b)), pa.array(crc, pa.int64()), pa.array(np.diff(shard.symbol_bounds))], schema=types)

    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before_part"))
    inside = sizes.withColumn("before_shard", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    starts = inside.join(before, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("base"))
    found = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(tidy(unpack), schema)
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "symbols", "part", "shard")


def grammar_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, DataFrame]:
    """Writes the shards and reads them back: (shard table, one row per document)."""
    scratch = Scratch(docs.sparkSession, "repair")
    shards = write_shards(docs, tokenizer_path, scratch, end_id, shard_ids)
    return shards, read_documents(shards)
