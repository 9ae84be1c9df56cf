"""Document quality by supervised subword embeddings, trained by numpy stochastic gradient descent.

Learned vectors of hashed n-grams are averaged per document, in two averages: over all its words' parts (the hashed
word and its hashed character n-grams), and over its hashed word bigrams with one end mark a document. A softmax layer
turns the averages and their squares, both scaled by what they are on the training documents, into class
probabilities. Case and marks are kept: words are what stands between blanks.

Cases: null and empty texts have no parts and only the end mark; rows that repeat
a doc_id get one score each, and equal ones count once in training; labels of a doc_id that disagree all count; null labels don't; with no
labels or one class only, every score is that class's share (0.5 without labels); an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lowest_hashes, mix64, pick, slices, spread, string_bytes, tidy
from .lang_cnn import remainder, softmax

BUCKETS = 1 << 17
END = BUCKETS  # the bigram bucket of the end mark
DIMENSION = 8
NGRAMS = (2, 3, 4)
#: Labelled documents that the model is fitted on, at most; and how many different parts these may have in all, so that
#: the driver's memory is bounded whatever the lengths of the texts. Whole documents are taken as long as both bounds hold.
MOST_ROWS = 5000
MOST_PARTS = 8_000_000
THRESHOLD = 0.3
FURTHEST = 8.0  # standard deviations that a scaled input may be from its mean


def word_parts(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of all words, worked out some at a time to bound the memory."""
    done = [_word_parts(words[k : k + at_once]) for k in range(0, len(words), at_once)]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _word_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's parts (its n-grams with < and > at its ends, and the word), how many each word has, and the words' hashes."""
    text = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(code))  # characters from here to the word's end
    step = np.uint64(0x100000001B3)
    value = (code + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
    found, owners, rolling = [], [], value.copy()
    for n in range(2, max(NGRAMS) + 1):
        rolling = rolling[:-1] * step + value[n - 1 :] if len(rolling) > 1 else rolling[:0]
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(rolling)] >= n)
            found.append(mix64(rolling[at] + np.uint64(n)))
            owners.append(owner[at])
    position = np.arange(len(code)) - np.repeat(start, size)
    weighted = mix64(value + position.astype(np.uint64))
    whole = mix64(np.add.reduceat(weighted, start) if len(words) else weighted)
    found.append(whole)
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(words)), whole


def split_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the index of every word of every row, and each row's bounds."""
    flat = column.cast(pa.large_string()).fill_null("")
    for mark in "\n\t\r":
        flat = pc.replace_substring(flat, mark, " ")
    parts = pc.split_pattern(flat, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    words = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def pairs_of(index: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word bigrams, row after row, each row's followed by the end mark; and how many each row has."""
    sizes = np.maximum(np.diff(bounds) - 1, 0) + 1
    out = np.full(int(sizes.sum()), END, np.int64)
    first = np.ones(len(index), bool)
    inner = np.flatnonzero(np.diff(bounds) > 0)
    last = first.copy()
    first[:] = last[:] = False
    first[bounds[:-1][inner]] = True
    last[bounds[1:][inner] - 1] = True
    left, right = index[~last], index[~first]
    key = mix64(hashes[left] * np.uint64(0x9E3779B97F4A7C15) + hashes[right]) % np.uint64(BUCKETS)
    place = np.ones(len(out), bool)
    place[np.cumsum(sizes) - 1] = False
    out[place] = key.astype(np.int64)
    return out, sizes


#: A document's parts: ids and weights (they add up to 1) of its words' parts, then of its bigrams.
Bag = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def bags(column: pa.Array, limit: int = 4 << 20) -> Iterator[Bag]:
    """The different parts of each whole text."""
    column = column.cast(pa.large_string())
    _, offsets = string_bytes(column)
    for low, high in slices(offsets, limit):
        words, index, bounds = split_words(column.slice(low, high - low))
        parts, count, hashes = word_parts(words)
        begin = np.cumsum(count) - count
        pairs, sizes = pairs_of(index, bounds, hashes)
        ends = np.cumsum(sizes)
        for k in range(high - low):
            word, times = np.unique(index[bounds[k] : bounds[k + 1]], return_counts=True)
            ids, place = np.unique(parts[spread(begin[word], count[word])], return_inverse=True)
            weight = np.bincount(place, np.repeat(times, count[word]), minlength=len(ids))
            two, often = np.unique(pairs[ends[k] - sizes[k] : ends[k]], return_counts=True)
            yield ids.astype(np.int32), (weight / max(1, weight.sum())).astype(np.float32), two.astype(np.int32), (often / sizes[k]).astype(np.float32)


@dataclass
class Model:
    classes: list[int]
    vectors: list[np.ndarray]  # of words' parts, and of bigrams
    out: np.ndarray
    bias: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def inputs(self, means: np.ndarray) -> np.ndarray:
        """What the softmax layer sees of averages [rows, 2 x dimension]."""
        return np.clip((np.concatenate([means, means * means], 1) - self.middle) / self.spread, -FURTHEST, FURTHEST)

    def _sums(self, parts: np.ndarray, count: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """The sum of each word's parts."""
        first = np.cumsum(count) - count
        out = np.empty((len(count), DIMENSION), np.float32)
        for k in range(0, len(count), at_once):
            begin, end = first[k], first[k + at_once] if k + at_once < len(count) else len(parts)
            out[k : k + at_once] = np.add.reduceat(self.vectors[0][parts[begin:end]], first[k : k + at_once] - begin)
        return out

    def score(self, column: pa.Array, limit: int = 4 << 20) -> np.ndarray:
        """Probabilities [rows, classes]; every word of every text counts."""
        done = []
        column = column.cast(pa.large_string())
        _, offsets = string_bytes(column)
        for low, high in slices(offsets, limit):
            words, index, bounds = split_words(column.slice(low, high - low))
            means = np.zeros((high - low, 2 * DIMENSION), np.float32)
            parts, count, hashes = word_parts(words)
            filled = np.flatnonzero(np.diff(bounds) > 0)
            if len(filled):
                row = np.repeat(np.arange(high - low), np.diff(bounds))
                size = np.bincount(row, count[index], minlength=high - low)[filled, None]
                means[filled, :DIMENSION] = np.add.reduceat(self._sums(parts, count)[index], bounds[:-1][filled]) / size
            pairs, sizes = pairs_of(index, bounds, hashes)
            means[:, DIMENSION:] = np.add.reduceat(self.vectors[1][pairs], np.cumsum(sizes) - sizes) / sizes[:, None]
            done.append(softmax(self.inputs(means) @ self.out + self.bias))
        return np.concatenate(done) if done else np.zeros((0, len(self.classes)))


def _held(ids: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different parts of some documents, and each part's weight in each document [parts, documents]."""
    sizes = [len(x) for x in ids]
    ids = np.concatenate(ids)
    place = np.zeros(BUCKETS + 1, np.int32)
    place[ids] = 1
    parts = np.flatnonzero(place)
    place[parts] = np.arange(len(parts), dtype=np.int32)
    out = np.zeros((len(parts), len(sizes)), np.float32)
    out[place[ids], np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate(weights)
    return parts, out


def train(texts: list[Bag], labels: list[int], seed: int = 3, epochs: int = 3, rate: float = 0.03, vector_rate: float = 0.1, per_step: int = 32) -> Model:
    """Stochastic gradient descent on small batches of whole documents, with a falling rate; Adam on the softmax layer."""
    classes = sorted(set(labels)) or [0, 1]
    rng = np.random.default_rng(seed)
    share = np.array([max(1, labels.count(c)) for c in classes], float)
    vectors = [rng.normal(0, 1, (n, DIMENSION)).astype(np.float32) for n in (BUCKETS, BUCKETS + 1)]
    inputs = 4 * DIMENSION
    model = Model(classes, vectors, np.zeros((inputs, len(classes)), np.float32), np.log(share / share.sum()).astype(np.float32), np.zeros(inputs, np.float32), np.ones(inputs, np.float32))
    if len(classes) < 2 or not labels:
        return model
    means = np.array([np.concatenate([t[2 * s + 1] @ vectors[s][t[2 * s]] for s in (0, 1)]) for t in texts], np.float32)
    means = np.concatenate([means, means * means], 1)
    model.middle, model.spread = means.mean(0), means.std(0) + 1e-6
    goal = np.searchsorted(classes, labels)
    epochs = max(epochs, min(40, 10_000 // len(texts)))  # few documents are seen more often
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.out, model.bias)]
    steps, step = epochs * max(1, len(texts) // per_step), 0
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // per_step)):
            falling = 1 - step / steps
            step += 1
            held = [_held([texts[d][2 * s] for d in docs], [texts[d][2 * s + 1] for d in docs]) for s in (0, 1)]
            means = np.concatenate([weight.T @ vectors[s][parts] for s, (parts, weight) in enumerate(held)], 1)
            x = model.inputs(means)
            p = softmax(x @ model.out + model.bias)
            p[np.arange(len(docs)), goal[docs]] -= 1
            back = (p @ model.out.T) * (np.abs(x) < FURTHEST) / model.spread
            back = back[:, : 2 * DIMENSION] + 2 * means * back[:, 2 * DIMENSION :]
            for value, grad, (m, v) in zip((model.out, model.bias), (x.T @ p / len(docs), p.mean(0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (falling * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            back = (falling * vector_rate * back).astype(np.float32)
            for s, (parts, weight) in enumerate(held):
                vectors[s][parts] -= weight @ back[:, s * DIMENSION : (s + 1) * DIMENSION]
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", held_out: int | None = 0, most: int = MOST_ROWS, most_parts: int = MOST_PARTS) -> Model:
    """Fits on at most ``most`` labelled documents, the ones whose ids have the lowest hashes; only their parts come to the driver."""
    marked = pick(labels, **{"doc_id": "long", target: "int"}).where(f"doc_id IS NOT NULL AND {target} IS NOT NULL")
    if held_out is not None:
        marked = marked.where(remainder("doc_id", 5) != held_out)
    chosen = lowest_hashes(marked, most, "doc_id", target)
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "place", target, "text")  # ``most`` rows on the small side
    kinds = ["ids", "weights", "pairs", "pair_weights"]
    types = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), (target, pa.int32()), ("parts", pa.int64()), *((c, pa.binary()) for c in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(bags(batch.column("text"), 1 << 20))
            arrays = [batch.column(c).cast(t) for c, t in zip(("doc_id", "place", target), types.types[:3], strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x[0]) + len(x[2]) for x in made], pa.int64()), *(pa.array([x[k].tobytes() for x in made], pa.binary()) for k in range(4))], schema=types)

    made = texts.mapInArrow(tidy(run), f"doc_id long, place int, {target} int, parts long, ids binary, weights binary, pairs binary, pair_weights binary")
    table = Scratch(docs.sparkSession, "bags").keep(made.distinct())
    order = ["place", "doc_id", target, F.md5("pairs")]
    so_far = F.sum("parts").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over ``most`` documents
    got = table.withColumn("so_far", so_far).where(F.col("so_far") <= most_parts).orderBy(*order).toArrow()
    columns = [got.column(c).to_pylist() for c in kinds]
    held = [tuple(np.frombuffer(x, k) for x, k in zip(row, (np.int32, np.float32) * 2, strict=True)) for row in zip(*columns, strict=True)]
    return train(held, got.column(target).to_pylist())


def score_documents(docs: DataFrame, model: Model, good: int = 1, threshold: float = THRESHOLD, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score (probability of class ``good``), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x dimension
    schema = "doc_id long, score double"
    types = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.score(batch.column("text"))
            score = p[:, m.classes.index(good)] if good in m.classes else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64))], schema=types)

    scored = pick(docs, doc_id="long", text="string").mapInArrow(tidy(run), schema)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
