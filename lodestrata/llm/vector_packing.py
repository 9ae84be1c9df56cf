"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Documents are cut into pieces of a whole sequence each and a rest. Rests are placed by the
dot-product heuristic: into the open sequence goes the rest, among those that fit in every dimension,
whose demand has the largest dot product with what the sequence has left. The emptiest sequences are
then taken apart and cut to fill the others' gaps.

Cases: null text is empty; an empty document is its end id alone; rows that repeat are packed one by one;
ties go to the rest that came first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, tidy, tokenized


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


def place(demand: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins (lists of item numbers) for items with demands [items, 3], each of which fits an empty bin."""
    size = demand / limits.vector()
    weight = size.mean(0) if len(size) else np.ones(3)
    order = np.argsort(-(size * weight).sum(1), kind="stable")
    size = size[order]
    left = np.ones(len(size), bool)
    bins, first = [], 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            return bins
        held, room = [int(order[first])], 1 - size[first]
        left[first] = False
        while True:
            rest = np.flatnonzero(left[first:]) + first
            fit = rest[(size[rest] <= room + 1e-12).all(1)]
            if not len(fit):
                break
            best = fit[np.argmax(size[fit] @ (weight * room))]
            held.append(int(order[best]))
            left[best] = False
            room = room - size[best]
        bins.append(held)
        if first > 512 and left.mean() < 0.5:  # the placed ones go, so that picks stay cheap
            size, order, left, first = size[left], order[left], left[left], 0


def fill_gaps(bins: list[list[tuple]], limits: Limits, least: int) -> list[list[tuple]]:
    """Takes apart the emptiest bins to fill gaps of at least ``least`` tokens in the fuller ones.

    A piece is (document, start, length, loss), where loss counts its tokens from its end.
    """
    used = [sum(p[2] for p in b) for b in bins]
    loss = [sum(p[3] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-used[k], k))
    low, high = 0, len(order) - 1
    while low < high:
        into, source = order[low], order[high]
        if not bins[source]:
            high -= 1
            continue
        room = limits.tokens - used[into]
        if room < least or len(bins[into]) >= limits.segments:
            low += 1
            continue
        k = max(range(len(bins[source])), key=lambda i: (bins[source][i][2] <= room, bins[source][i][2]))
        doc, start, length, bearing = bins[source][k]
        take = min(length, room)
        took = max(0, take - (length - bearing))  # of its tokens that bear loss, which are its last ones
        if loss[into] + took > limits.loss or (take < length and (take < least or length - take < 1)):
            low += 1
            continue
        bins[into].append((doc, start, take, took))
        used[into] += take
        loss[into] += took
        used[source] -= take
        loss[source] -= took
        if take == length:
            bins[source].pop(k)
        else:
            bins[source][k] = (doc, start + take, length - take, bearing - took)
    return [b for b in bins if b]


def padded_size(used: int, limits: Limits) -> int:
    """A sequence is padded to the token limit, but not where its length is a power of two."""
    return used if used & (used - 1) == 0 else limits.tokens


class Packer:
    """Packs documents as they come, ``window`` rests at a time; what the last sequence of a window holds waits for the next one."""

    def __init__(self, limits: Limits, window: int = 4096, least: int = 8):
        self.limits, self.window, self.least = limits, window, least
        self.rests: list[tuple] = []  # (document, start, length, loss)
        self.docs: dict[int, tuple] = {}  # document: (doc_id, ids, tokens), while a rest of it waits
        self.n = self.made = 0

    def add(self, doc_id, ids: np.ndarray, no_loss: int) -> Iterator[tuple]:
        """Rows (doc_id, start, ids, tokens, sequence, offset, loss) of sequences that are complete."""
        total, step = len(ids), min(self.limits.tokens, self.limits.loss)
        start = 0
        while total - start >= step:
            bearing = max(0, min(step, start + step - no_loss))
            yield doc_id, start, ids[start : start + step], total, self.made, 0, bearing
            self.made += 1
            start += step
        if start < total:
            self.docs[self.n] = (doc_id, ids[start:].copy(), total, start)
            self.rests.append((self.n, start, total - start, max(0, total - max(start, no_loss))))
            self.n += 1
            if len(self.rests) >= self.window:
                yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        demand = np.array([(p[2], 1, p[3]) for p in self.rests], np.float64).reshape(-1, 3)
        bins = [[self.rests[k] for k in b] for b in place(demand, self.limits)]
        bins = fill_gaps(bins, self.limits, self.least)
        self.rests = []
        if not last and bins:
            emptiest = min(range(len(bins)), key=lambda k: (sum(p[2] for p in bins[k]), k))
            self.rests = bins.pop(emptiest)
        for b in bins:
            offset = 0
            for doc, start, length, bearing in b:
                doc_id, ids, total, base = self.docs[doc]
                yield doc_id, start, ids[start - base : start - base + length], total, self.made, offset, bearing
                offset += length
            self.made += 1
        waiting = {p[0] for p in self.rests}
        self.docs = {k: v for k, v in self.docs.items() if k in waiting}


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, no_loss: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, padded (and ids).

    ``no_loss`` names a column with the number of a document's first tokens that bear no loss (a prompt);
    without it all do. Each task packs the documents it reads: no shuffle, and at most one
    sequence of a task is far from full. A sequence_id is the task's number times 2**40 plus a running number.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padded long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "padded"]
    types = pa.schema([*((n, pa.int64()) for n in names), *[("ids", pa.list_(pa.int32()))] * with_ids])
    columns = {"doc_id": "long", "text": "string"} | ({no_loss: "long"} if no_loss else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, rows = Packer(limits), []

        def out() -> pa.RecordBatch:
            used: dict[int, int] = {}
            for r in rows:
                used[r[4]] = used.get(r[4], 0) + len(r[2])
            made = [(d, s, len(i), zlib.crc32(i.astype("<u4")), t, base + q, o, b, padded_size(used[q], limits)) for d, s, i, t, q, o, b in rows]
            arrays = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)]
            if with_ids:
                arrays.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=types)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            free = batch.column(no_loss).fill_null(0).to_pylist() if no_loss else [0] * len(doc_ids)
            for first, ids, bounds in tokenized(batch, tokenizer_path):
                for k in range(len(bounds) - 1):
                    rows.extend(packer.add(doc_ids[first + k], np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)), free[first + k]))
                if len(rows) >= 4096:  # only whole sequences are in it
                    yield out()
        rows.extend(packer.flush())
        if rows:
            yield out()

    return pick(docs, **columns).mapInArrow(tidy(run), schema)


def instruction_examples(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text, prompt_tokens): each assistant turn behind the turn before it, whose tokens bear no loss.

    A doc_id is conv_id times 2**20 plus the turn. Turns are joined by conversation and number, so a conversation of any length is
    dealt to many tasks. A first turn, or one whose number before is missing, has no prompt; of several prompts with one
    number the text that sorts last counts; turns without conversation or number are left out.
    """
    rows = pick(turns, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    replies = rows.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("reply"))
    prompts = rows.where("role <> 'assistant'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("text").alias("prompt"))
    paired = replies.join(prompts, ["conv_id", "turn"], "left").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("doc_id"), F.coalesce("prompt", F.lit("")).alias("text"), "reply")
    types = pa.schema([("doc_id", pa.int64()), ("prompt", pa.string()), ("reply", pa.string()), ("prompt_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(bounds) for _, _, bounds in tokenized(batch, tokenizer_path)]
            arrays = [batch.column("doc_id"), batch.column("text").cast(pa.string()), batch.column("reply").cast(pa.string()), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=types)

    counted = paired.mapInArrow(tidy(run), "doc_id long, prompt string, reply string, prompt_tokens long")
    return counted.select("doc_id", F.when(F.col("prompt") == "", F.col("reply")).otherwise(F.concat("prompt", F.lit("\n"), "reply")).alias("text"), "prompt_tokens")


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(2048, 16, 1536), end_id: int = 1) -> DataFrame:
    """Instruction data (conv_id, turn, role, text) packed under all three limits; columns as in ``pack_documents``."""
    return pack_documents(instruction_examples(turns, tokenizer_path), tokenizer_path, limits, end_id, no_loss="prompt_tokens")
