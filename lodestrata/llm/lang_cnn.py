"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the one-hot bytes of fixed-length windows; each filter keeps its
largest value in the window (max pooling), and a softmax layer turns these into languages. The logits of
all windows of a text are averaged by their lengths.

Training sees bounded numbers of documents and of windows (drawn at random from whole texts), so what comes to the driver is bounded
whatever the lengths of the texts; a prediction uses all of a text's windows.

Cases: a text that is null or has no letter gets ``und`` with score 0; ties go to the language that
sorts first; rows that repeat a doc_id get one prediction each, equal ones count once in training; without labelled rows every text is
``und``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashes, pick, string_bytes, tidy

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
#: Labelled documents that the network is fitted on, at most: of each language, and in all.
PER_LANGUAGE = 600
MOST_DOCUMENTS = 4800
#: Stochastic steps draw windows from anywhere in a whole text: so many of each document in an epoch, others in the next one.
EPOCHS = 8
WINDOWS_PER_EPOCH = 4
#: A document whose likeliest language has less than this probability is in no language: all others together are likelier.
LEAST_SCORE = 0.5
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    taps: np.ndarray  # [widest, 256, filters]: a filter's weight for each byte at each of its places
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Pooled values [windows, filters] of windows x [places, windows], and the place of each."""
        places, n = x.shape
        reach, f = len(self.taps), len(self.bias)
        best = np.full((n, f), -np.inf, np.float32)
        at = np.zeros((n, f), np.int32) if where else None
        value, part = np.empty((n, f), np.float32), np.empty((n, f), np.float32)
        for t in range(places - reach + 1):
            np.take(self.taps[0], x[t], axis=0, out=value, mode="clip")
            for j in range(1, reach):
                np.take(self.taps[j], x[t + j], axis=0, out=part, mode="clip")
                value += part
            if where:
                better = value > best
                at[better] = t
            np.maximum(best, value, out=best)
        return np.maximum(best + self.bias, 0), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[0] @ self.out + self.out_bias


def windows(buf: np.ndarray, offsets: np.ndarray, length: int = WINDOW, reach: int = max(WIDTHS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, [length + reach - 1, windows] with zeros behind a row's end; their rows and their lengths.

    A window also sees the first bytes of the next one, so no sequence is cut.
    """
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // length))
    row = np.repeat(np.arange(len(sizes)), count)
    start = offsets[row] + length * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    index = start[None, :] + np.arange(length + reach - 1)[:, None]
    x = np.zeros(index.shape, np.uint8)
    inside = index < offsets[row + 1][None, :]
    x[inside] = buf[index[inside]]
    return x, row, np.minimum(length, offsets[row + 1] - start)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def draw(column: pa.Array, most: int = EPOCHS * WINDOWS_PER_EPOCH, seed: int = 7) -> Iterator[np.ndarray]:
    """For each text up to ``most`` of its windows, drawn without looking at others: [windows, length + reach - 1] bytes.

    What is drawn depends on the text alone. Only drawn windows are built.
    """
    buf, offsets = string_bytes(column)
    reach, places = max(WIDTHS), np.arange(WINDOW + max(WIDTHS) - 1)
    for low, high in itertools.pairwise(offsets.tolist()):
        count = -(-(high - low) // WINDOW)
        rng = np.random.default_rng([seed, zlib.crc32(buf[low:high])])
        at = low + WINDOW * (np.arange(count) if count <= most else rng.choice(count, most, replace=False))
        index = at[:, None] + places[None, :]
        out = np.zeros((len(at), WINDOW + reach - 1), np.uint8)
        inside = index < high
        out[inside] = buf[index[inside]]
        yield out


def train(texts: list[np.ndarray], labels: list[str], seed: int = 7, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the cross entropy of windows (of each text some drawn ones, see ``draw``); a fixed seed and order give the same network again."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    f, reach = FILTERS * len(WIDTHS), max(WIDTHS)
    net = Network(languages, rng.normal(0, 0.15, (reach, 256, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.2, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    live = np.zeros((reach, 1, f), np.float32)
    for k, width in enumerate(WIDTHS):
        live[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    net.taps *= live
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(languages) < 2 or not sizes.sum():
        return net
    x = np.ascontiguousarray(np.concatenate(texts).T)
    goal = np.repeat([languages.index(v) for v in labels], sizes)
    # each text's windows in a random order; an epoch takes the next few of them, and begins anew at their end
    first = np.cumsum(sizes) - sizes
    order = np.concatenate([first[k] + rng.permutation(n) for k, n in enumerate(sizes)])
    each = np.minimum(sizes, WINDOWS_PER_EPOCH)
    begin, turn = np.repeat(first, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    cycle = np.repeat(sizes, each)
    params = [net.taps, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-4
        chosen = rng.permutation(order[begin + (turn + epoch * WINDOWS_PER_EPOCH) % cycle])
        for part in np.array_split(chosen, max(1, len(chosen) // batch)):
            xb, n = x[:, part], len(part)
            h, at = net.hidden(xb, where=True)
            p = softmax(h @ net.out + net.out_bias)
            p[np.arange(n), goal[part]] -= 1
            p /= n
            back = (p @ net.out.T) * (h > 0)
            taps = np.zeros_like(net.taps)
            cols = np.broadcast_to(np.arange(f), at.shape)
            for j in range(reach):
                np.add.at(taps[j], (xb[at + j, np.arange(n)[:, None]], cols), back)
            grads = [taps * live, back.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for value, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, column: pa.Array, limit: int = 2 << 20) -> tuple[list[str], np.ndarray]:
    """Language and probability of each row, from all its windows, in bounded memory."""
    n = len(column)
    if not net.languages:
        return ["und"] * n, np.zeros(n)
    total, weight = np.zeros((n, max(1, len(net.languages)))), np.zeros(n)
    buf, offsets = string_bytes(column)
    for low in range(0, len(buf), limit):  # windows that begin in these bytes; a long text spans many turns
        high = min(len(buf), low + limit)
        first, last = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high, "left"))
        bounds = offsets[first : last + 1].copy()
        begin = max(low, int(bounds[0]))
        begin = int(bounds[0]) + -(-(begin - int(bounds[0])) // WINDOW) * WINDOW
        bounds[0] = min(begin, int(bounds[1]))  # the first row may have no window that begins here
        if len(bounds) == 2 and begin >= high:
            continue
        end = int(bounds[-1])
        if end > high:
            start = int(bounds[-2]) if len(bounds) > 2 else begin
            end = start + -(-(high - start) // WINDOW) * WINDOW
            end = min(end, int(bounds[-1]))
        tail = min(len(buf), int(bounds[-1]), end + max(WIDTHS) - 1)
        bounds[-1] = max(int(bounds[-2]), tail)
        x, row, size = windows(buf, bounds)
        if bounds[-1] > end:  # the last bytes are only looked at, from the window before
            drop = (row == len(bounds) - 2) & (np.arange(len(row)) >= len(row) - 1) & (size < max(WIDTHS))
            x, row, size = x[:, ~drop], row[~drop], size[~drop]
        size = np.minimum(size, WINDOW)
        for a in range(0, len(row), 256):
            z = net.logits(x[:, a : a + 256])
            np.add.at(total, first + row[a : a + 256], z * size[a : a + 256, None])
        np.add.at(weight, first + row, size)
    mean = total / np.maximum(weight, 1)[:, None]
    p = softmax(mean)
    letters = [v.as_py() is not None and LETTER.search(v.as_py()) is not None for v in column]
    best = p.argmax(1)
    names = [net.languages[b] if ok and net.languages else "und" for b, ok in zip(best, letters, strict=True)]
    return names, np.where([x != "und" for x in names], p[np.arange(n), best], 0.0)


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def fit(docs: DataFrame, held_out: int | None = 1, per_language: int = PER_LANGUAGE, most: int = MOST_DOCUMENTS) -> Network:
    """Fits a network on at most ``per_language`` documents of each language and ``most`` in all, chosen by a hash of the id.

    The ids are chosen first, without any text; only drawn windows come to the driver. Rows whose crc32 modulo 3 is ``held_out`` are left out.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    if held_out is not None:
        rows = rows.where(remainder("doc_id", 3) != held_out)
    languages = rows.select("lang").distinct().count()
    per_language = max(1, min(per_language, most // max(1, languages)))
    chosen = lowest_hashes(rows.select("doc_id", "lang"), per_language, "doc_id", group="lang")
    few = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # per_language ids of a language at most
    types = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([w.tobytes() for w in draw(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang").cast(pa.string()), made], schema=types)

    drawn = few.where("text IS NOT NULL").select("doc_id", "lang", "text").mapInArrow(tidy(run), "doc_id long, lang string, windows binary").distinct()
    got = sorted(drawn.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["lang"], r["windows"]))
    return train([np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW + max(WIDTHS) - 1) for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, and the columns named in ``keep``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # a fixed size: 5 x 256 x filters
    schema = "doc_id long, lang_pred string, score double"
    types = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema=types)

    return pick(docs, doc_id="long", text="string").mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, net: Network, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose text the network finds to be in a language with at least this score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = predict(shared.value, batch.column("text"))
            yield batch.filter(pa.array([a != "und" and b >= least for a, b in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def language_report(docs: DataFrame, held_out: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the rows that aren't held out; per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs, fit(docs, held_out, per_language))
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
