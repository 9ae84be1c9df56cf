"""Benchmark decontamination by a distributed positional inverted index.

Training text is indexed in blocks of whole documents. A block's index holds, for each term, the sorted
places of the term in the block. Test phrases go to every block, as queries do in a search engine whose
index is split by documents: the lists of a phrase's terms are intersected from the rarest term on,
each shifted by the term's offset, so what is left are the places where the phrase begins.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters; a term is a 64-bit hash of a word.

Cases: null and empty texts have no words and no hits; an item without words or without an id matches
nothing; items that repeat an id add their phrases to it; a document's own repeated rows are documents of
their own; an empty benchmark marks nothing; an empty table gives an empty table; other columns
are ignored (kept as they are by ``drop_contaminated``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_words, pick, slices, spread, string_bytes, tidy, word_values

WINDOW = 10
#: Words of a block of the index; a document is never split, so a longer one is a block of its own.
BLOCK_WORDS = 1 << 20
#: Text of test items that goes to all tasks at once; more items are searched in several passes, one after another.
PASS_BYTES = 16 << 20
#: Places that a search holds at once.
CANDIDATES = 1 << 17

VALUES = word_values("alnum")


def text_terms(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, bounds of rows) of runs of rows."""
    buf, offsets = string_bytes(column)
    for low, high in slices(offsets, limit):
        yield low, *hash_words(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], VALUES)


def invert(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order, bounds of their lists, and all places, list after list."""
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first], np.append(first, len(ranked)), order


def build_index(docs: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The written index: (part, block, doc_ids, starts, terms, lists, places), one row a block.

    Nothing is shuffled; a task holds one block. ``starts`` are the documents' bounds among the block's words.
    """
    schema = "part int, block int, doc_ids array<long>, starts binary, terms binary, lists binary, places binary"
    types = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("starts", "terms", "lists", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        held, sizes, names, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            terms, lists, places = invert(np.concatenate(held))
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            row = [part, block, [x for n in names for x in n], starts.astype("<i8").tobytes(), terms.astype("<u8").tobytes(), lists.astype("<i8").tobytes(), places.astype("<i4" if starts[-1] < 2**31 else "<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types.types, strict=True)], schema=types)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, terms, bounds in text_terms(batch.column("text")):
                low, n = 0, len(bounds) - 1
                while low < n:
                    high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + block_words - total, "right")) - 1))
                    held.append(terms[bounds[low] : bounds[high]])
                    sizes.append(np.diff(bounds[low : high + 1]))
                    names.append(doc_ids[first + low : first + high])
                    total += int(bounds[high] - bounds[low])
                    low = high
                    if total >= block_words or low < n:
                        yield close()
                        held, sizes, names, total, block = [], [], [], 0, block + 1
        if held:
            yield close()

    return scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(tidy(run), schema))


class Block:
    """Reader of one block."""

    def __init__(self, starts: bytes, terms: bytes, lists: bytes, places: bytes):
        self.starts = np.frombuffer(starts, "<i8")
        self.terms = np.frombuffer(terms, "<u8")
        self.lists = np.frombuffer(lists, "<i8")
        wide = self.starts[-1] >= 2**31
        self.places = np.frombuffer(places, "<i8" if wide else "<i4")

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The list number of each term, -1 for terms that the block lacks."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(terms.shape, -1)

    def postings(self, number: int) -> np.ndarray:
        return self.places[self.lists[number] : self.lists[number + 1]]

    def near(self, numbers: np.ndarray, reach: int) -> np.ndarray:
        """Places of the rarest term that have all other terms within ``reach`` words, in the same document."""
        size = self.lists[numbers + 1] - self.lists[numbers]
        order = np.argsort(size, kind="stable")
        at = self.postings(numbers[order[0]]).astype(np.int64)
        doc = np.searchsorted(self.starts, at, "right")
        low, high = np.maximum(at - reach, self.starts[doc - 1]), np.minimum(at + reach + 1, self.starts[doc])
        for k in order[1:]:
            have = self.postings(numbers[k])
            ok = np.searchsorted(have, low) < np.searchsorted(have, high)
            at, low, high = at[ok], low[ok], high[ok]
        return at


class Phrases:
    """All windows of some test items, held as places in the items' terms: 16 bytes for each of their words.

    ``numbers`` are the words as numbers of ``terms`` (distinct, sorted), item after item. For each length, ``groups`` has the
    places where the windows of that length begin, and the items that they belong to.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        owners = [i for i, (item, _) in enumerate(items) if item is not None]
        column = pa.array([items[i][1] for i in owners], pa.large_string())
        found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, terms, bounds in text_terms(column):
            found.append(terms)
            sizes.append(np.diff(bounds))
        sizes = np.concatenate(sizes)
        self.terms, numbers = np.unique(np.concatenate(found), return_inverse=True)
        self.numbers = numbers.astype(np.int32)
        self.items = np.array([items[i][0] for i in owners], np.int64)
        starts = np.cumsum(sizes) - sizes
        lengths = np.minimum(sizes, window)
        self.groups = []
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            count = sizes[own] - n + 1
            self.groups.append((n, spread(starts[own], count).astype(np.int64), np.repeat(own, count).astype(np.int32)))

    def search(self, block: Block, at_once: int = CANDIDATES) -> tuple[np.ndarray, list[set[int]]]:
        """Hit words of the block, and the items found in each document.

        Windows with a term that the block lacks are out. Each other one begins where its rarest term's list says, shifted by
        the term's offset; these places are intersected with the shifted lists of its other terms, from the next rarest on,
        for many windows together, ``at_once`` places at a time.
        """
        words = int(block.starts[-1])
        edge = np.zeros(words + 1, np.int64)
        docs, pairs = len(block.starts) - 1, []
        lists = block.find(self.terms)  # of each distinct term
        sizes = np.where(lists >= 0, np.diff(block.lists)[np.maximum(lists, 0)] if len(block.terms) else 0, 0)
        holder = None
        for n, begins, owners in self.groups:
            here = np.concatenate([[0], np.cumsum(sizes[self.numbers] > 0)])
            live = np.flatnonzero(here[begins + n] - here[begins] == n)
            for low in range(0, len(live), at_once // (8 * n)):
                some = live[low : low + at_once // (8 * n)]
                inside = self.numbers[begins[some][:, None] + np.arange(n)]
                order = np.argsort(sizes[inside], axis=1, kind="stable")
                rarest = np.take_along_axis(inside, order[:, :1], 1)[:, 0]
                count = sizes[rarest]
                ends = np.cumsum(count)
                if holder is None:  # the list that each place is in
                    holder = np.empty(words, np.int32)
                    holder[block.places] = np.repeat(np.arange(len(block.terms), dtype=np.int32), np.diff(block.lists))
                first = 0
                while first < len(some):
                    last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")))
                    part = np.arange(first, last)
                    window = np.repeat(part, count[part])
                    begin = block.places[spread(block.lists[lists[rarest[part]]], count[part])].astype(np.int64) - order[window, 0]
                    keep = (begin >= 0) & (begin + n <= words)
                    window, begin = window[keep], begin[keep]
                    for k in range(1, n):
                        offset = order[window, k]
                        keep = holder[begin + offset] == lists[inside[window, offset]]
                        window, begin = window[keep], begin[keep]
                    doc = np.searchsorted(block.starts, begin, "right") - 1
                    keep = begin + n <= block.starts[doc + 1]
                    window, begin, doc = window[keep], begin[keep], doc[keep]
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + n, -1)
                    if len(doc):
                        pairs.append(np.unique(np.stack([doc, self.items[owners[some[window]]]], 1), axis=0))
                    first = last
        items: list[set[int]] = [set() for _ in range(docs)]
        for d, item in np.concatenate(pairs).tolist() if pairs else ():
            items[d].add(item)
        return np.cumsum(edge[:-1]) > 0, items


class Passes:
    """The test items, in passes of about ``pass_bytes``: their size is measured first, and decides on the number of passes."""

    def __init__(self, items: DataFrame, pass_bytes: int = PASS_BYTES):
        self.rows = pick(items, item_id="long", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
        size = self.rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.count = -(-size // pass_bytes) or 1

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        for k in range(self.count):
            part = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count)) == k) if self.count > 1 else self.rows
            yield [(r["item_id"], r["text"]) for r in part.distinct().toArrow().to_pylist()]


def search_index(index: DataFrame, items: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    spark = index.sparkSession
    schema = "part int, block int, row int, doc_id long, n_words long, hit binary, items array<long>"
    types = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])
    out_schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"
    out_types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64()))])

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    block = Block(*(batch.column(c)[r].as_py() for c in ("starts", "terms", "lists", "places")))
                    hit, found = shared.value.search(block)
                    n, b = len(found), block.starts
                    marks = [np.packbits(hit[b[k] : b[k + 1]]).tobytes() if found[k] else None for k in range(n)]
                    fixed = [pa.array(np.full(n, batch.column(c)[r].as_py(), np.int32)) for c in ("part", "block")]
                    arrays = [*fixed, pa.array(np.arange(n, dtype=np.int32)), batch.column("doc_ids")[r].values, pa.array(np.diff(b)), pa.array(marks, pa.binary()), pa.array([sorted(x) for x in found], types.types[-1])]
                    yield pa.RecordBatch.from_arrays(arrays, schema=types)

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one document follow each other: one from each pass."""
        last: dict | None = None

        def row(r: dict) -> tuple:
            items = sorted(set(r["items"]))
            n_hit = int(np.unpackbits(np.frombuffer(r["hit"], np.uint8)).sum()) if r["hit"] else 0
            return r["doc_id"], r["n_words"], n_hit, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n_hit > 0, items

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types.types, strict=True)], schema=out_types)

        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                if last is not None and all(last[c] == r[c] for c in ("part", "block", "row")):
                    both = [x["hit"] for x in (last, r) if x["hit"]]
                    last["hit"] = bytes(a | b for a, b in zip(*both, strict=True)) if len(both) == 2 else both[0] if both else None
                    last["items"] += r["items"]
                    continue
                if last is not None:
                    rows.append(row(last))
                last = r
            if len(rows) > 4096:
                yield out(rows)
                rows = []
        if last is not None:
            rows.append(row(last))
        if rows:
            yield out(rows)

    found, scratch = None, Scratch(spark, "passes")
    passes = Passes(items, pass_bytes)
    for part in passes:
        shared = spark.sparkContext.broadcast(Phrases(part, window))  # ``pass_bytes`` of text: four bytes for each of them at most
        more = index.mapInArrow(tidy(searcher(shared)), schema)
        if passes.count > 1:  # of several passes: each is searched before the next one is read
            more = scratch.keep(more)
            shared.destroy()
        found = more if found is None else found.unionByName(more)
    if passes.count > 1:
        found = found.repartition("part", "block", "row").sortWithinPartitions("part", "block", "row")
    return found.mapInArrow(tidy(finish), out_schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    index = build_index(docs, Scratch(docs.sparkSession, "phrases"), block_words)
    return search_index(index, items, window, pass_bytes)


def proximity(index: DataFrame, phrases: list[str], reach: int) -> DataFrame:
    """(doc_id, phrase, place): where the rarest word of a phrase stands with all its other words within ``reach`` words."""
    queries = [np.unique(t[b[0] : b[1]]) for p in phrases for _, t, b in text_terms(pa.array([p], pa.large_string()))]
    types = pa.schema([("doc_id", pa.int64()), ("phrase", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(*(batch.column(c)[r].as_py() for c in ("starts", "terms", "lists", "places")))
                ids = batch.column("doc_ids")[r].values
                for k, terms in enumerate(queries):
                    numbers = block.find(terms)
                    if len(terms) and (numbers >= 0).all():
                        at = block.near(numbers, reach)
                        doc = np.searchsorted(block.starts, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(len(at), k, np.int32)), pa.array(at - block.starts[doc])], schema=types)

    return index.mapInArrow(tidy(run), "doc_id long, phrase int, place long")


def drop_contaminated(docs: DataFrame, items: DataFrame, least_words: int = 1, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that have at least ``least_words`` hit words. Only their ids are joined."""
    bad = contamination(docs, items, window).where(F.col("n_hit") >= least_words).select(F.col("doc_id").alias("__ls_bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__ls_bad"), "left_anti")


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
p AS (SELECT item_id, least(len(words), 10) AS n, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM p),
s AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM w, s WHERE len(words) >= n),
h AS (SELECT doc_id, g.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM g) AS g JOIN q ON g.n = q.n AND g.phrase = q.phrase),
t AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""
