"""Near-duplicate documents by SetSketch registers over word shingles.

A register is 1 - log_b of the least of many exponential variables (one for each shingle), rounded down and
truncated: registers of a union are the maxima of the parts' registers. Bands of register values give
candidates; a pair's similarity is estimated from its registers and exact set sizes by maximum
likelihood; what the estimate can't rule out is checked on the full shingle sets.

All links of a candidate group are found without all its pairs:

1. Documents of equal sets, told by a 128-bit hash, are one class. Its number has 64 bits; classes never share one.
2. In each bucket (band, register values) every member is compared with the bucket's smallest class only; the
   three likeliest of a class's pairs are checked.
3. Links give components. Buckets whose members are all in one component are done.
4. In the others, members of different components are compared by registers, block by block. Of each document's
   likely partners in other components a block's 4 likeliest go on to the check on full sets.
5. What is still split then is settled in one exact round: the documents that have a likely partner in another
   component meet in blocks with their full sets, and each block gives one link for each two components that
   it joins, not its pairs.

Every candidate pair across two components is checked in the end, so no link between components is lost.

Cases: no words or null text: an empty set that links with nothing; fewer words than a shingle: the whole
sequence is one shingle; rows that repeat a doc_id: each row is reported, all with the component that the
text's set has; a null doc_id links with nothing and has a null component; ties go to the smaller
number; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hash_words, mix64, pick, slices, string_bytes, tidy, word_values

BASE = 1.001
RATE = 20.0
TOP = 65535
ROWS = 5
BANDS = 26
REGISTERS = ROWS * BANDS
#: Standard deviations by which an estimate may lie below the threshold: registers are nearly independent, and
#: for a similarity s the share of equal ones varies by sqrt(s (1 - s) / registers).
DEVIATIONS = 4.0
#: Graphs of at most so many edges are settled in one task, larger ones in rounds over all tasks.
FEW_EDGES = 1 << 20

VALUES = word_values("space")
_RNG = np.random.default_rng(20211105)
_FACTORS = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


# --- sets and registers --------------------------------------------------------------------


def shingle_sets(column: pa.Array, width: int, limit: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of runs of rows."""
    buf, offsets = string_bytes(column)
    for low, high in slices(offsets, limit):
        words, bounds = hash_words(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], VALUES)
        mixed = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(mixed[a : b - width + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    h = mix64(h * np.uint64(0xDA942042E4DD58B5) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        yield low, out


def registers(sets: list[np.ndarray], limit: int = 1 << 16) -> np.ndarray:
    """SetSketch registers [sets, registers]; 0 for empty sets. A large set is taken in parts and merged."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    least = np.full((len(sets), REGISTERS), 0xFFFFFFFF, np.uint32)
    low = 0
    while low < len(sets):
        high, n = low, 0
        while high < len(sets) and (n == 0 or n + len(sets[high]) <= limit):
            n += len(sets[high])
            high += 1
        full = [k for k in range(low, high) if len(sets[k])]
        if full:
            flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
            for a in range(0, len(flat), limit):  # more than one turn only for a set larger than the limit
                part = flat[a : a + limit]
                starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]]) if len(full) > 1 else np.zeros(1, np.int64)
                hashed = np.empty_like(part)
                for i in range(REGISTERS):
                    np.multiply(part, _FACTORS[i], out=hashed)
                    np.add(hashed, _SHIFTS[i], out=hashed)
                    got = np.minimum.reduceat(hashed, starts)
                    least[full, i] = np.minimum(least[full, i], got)
        low = high
    filled = [k for k in range(len(sets)) if len(sets[k])]
    if filled:
        x = -np.log1p(-(least[filled].astype(np.float64) + 0.5) / 4294967296.0) / RATE
        out[filled] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key [sets, bands] for the register values of each band."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, given how many registers of a are greater and less than b's, and both set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    same = REGISTERS - more - less
    grid = np.linspace(0, 1, 61)

    def likelihood(j):
        up, down = _step(u[:, None] - v[:, None] * j), _step(v[:, None] - u[:, None] * j)
        return more[:, None] * np.log(np.maximum(up, 1e-12)) + less[:, None] * np.log(np.maximum(down, 1e-12)) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))

    j = most[:, None] * grid
    best = likelihood(j).argmax(1)
    width = most / 60
    fine = np.clip(j[np.arange(len(j)), best][:, None] + width[:, None] * np.linspace(-1, 1, 21), 0, most[:, None])
    return fine[np.arange(len(j)), likelihood(fine).argmax(1)]


def least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


# --- components ----------------------------------------------------------------------------


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) in ascending order, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        u, v = parent[u], parent[v]
        apart = u != v
        if not apart.any():
            return nodes, nodes[parent]
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(parent, u, v)  # a root only ever gets a smaller one
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node reachable.

    Up to ``few`` edges are settled in one task, some 100 bytes an edge. More take large-star and small-star steps in
    turn, each a minimum by node and a join; every step is written, so
    a lost executor costs one step at most, and so both sides of a join are dealt out afresh and a hub's
    edges can be split by AQE. It ends when every node has one parent and no parent has one itself.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[b.column(c).to_numpy() for c in "uv"] for b in batches if b.num_rows]
        if ends:
            found = smallest_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "comp"])

    if now.count() <= few:
        return now.coalesce(1).mapInArrow(tidy(settle), "node long, comp long")
    for _ in range(rounds):
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(now.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        found = roles.groupBy("node").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
        if found.where("children > 1 OR (children > 0 AND parent > 0)").isEmpty():
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.distinct())
        scratch.drop(now, least, large, low)
        now = after
    raise RuntimeError("components did not settle")


def join_components(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` (node, comp) after more links (a, x): only the components that these join are worked on."""

    def end(name: str) -> DataFrame:
        return comps.select(F.col("node").alias(name), F.col("comp").alias(f"of_{name}"))

    named = links.join(end("a"), "a", "left").join(end("x"), "x", "left")
    moved = scratch.keep(components(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_x", "x").alias("b")), scratch))
    to = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = comps.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.keep(old.unionAll(moved.join(comps.select("node"), "node", "left_anti")))


# --- the operator --------------------------------------------------------------------------


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set: documents of equal sets are one class."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))


def _classes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Both halves of each set's class, null for empty sets."""
    found = [class_of(x) if len(x) else (None, None) for x in sets]
    return [pa.array([c[k] for c in found], pa.int64()) for k in (0, 1)]


def sketch_documents(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch), one row a document; h1 and h2 are the class, null for empty sets."""
    types = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                sketch = registers(sets)
                arrays = [batch.column("doc_id").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *_classes(sets), pa.array([k.tobytes() if len(s) else None for s, k in zip(sets, sketch, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return scratch.keep(pick(docs, doc_id="long", text="string").mapInArrow(tidy(run), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"))


def numbered(classes: DataFrame) -> DataFrame:
    """``classes`` (h1, h2, ...) with rep: h1, and the numbers behind it for the few classes that share their h1 with another one."""
    return classes.withColumn("rep", F.col("h1") + F.row_number().over(Window.partitionBy("h1").orderBy("h2")) - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _likely(pairs: DataFrame, sketches: DataFrame, cut: float) -> DataFrame:
    """The pairs (a, x) whose estimate reaches ``cut``, with the estimate."""
    both = pairs.join(sketches.select(F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("s_x")), "x").join(
        sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a"
    )
    types = pa.schema([("a", pa.int64()), ("x", pa.int64()), ("est", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                b = batch.slice(low, 4096)
                left, right = _matrix(b.column("s_a")), _matrix(b.column("s_x"))
                n_a, n_x = (b.column(c).to_numpy().astype(float) for c in ("n_a", "n_x"))
                est = estimate((left > right).sum(1), (left < right).sum(1), n_a, n_x)
                ok = pa.array(est >= cut)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("x").filter(ok), pa.array(est[est >= cut])], schema=types)

    return both.select("a", "x", "n_a", "n_x", "s_a", "s_x").mapInArrow(tidy(run), "a long, x long, est double")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, x) with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("x"), F.col("shingles").alias("s_x")), "x").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
    types = pa.schema([("a", pa.int64()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("s_a"), batch.column("s_x"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "x")], schema=types)

    return both.select("a", "x", "s_a", "s_x").mapInArrow(tidy(run), "a long, x long")


def _cells(live: DataFrame, rows: int = 384, shingles: int = 1 << 20) -> DataFrame:
    """The members of buckets with several components, dealt to cells (key, kind, i, j).

    ``live`` has (key, rep, comp, n, main, main_rows, main_n, other_rows, other_n): main is the bucket's largest
    component. Its members are dealt to blocks of bounded rows and shingles, the others to blocks too, and each block of
    others meets each block of all; two members of main never meet. A cell holds two blocks.
    """

    def blocks(name: str):
        return F.greatest(F.lit(1), F.ceil(F.col(f"{name}_rows") / F.lit(rows)), F.ceil(F.col(f"{name}_n") / F.lit(shingles))).cast("int")

    salt = F.xxhash64(F.lit(11), "rep")
    marked = live.withColumns({"is_main": F.col("comp") == F.col("main"), "mb": blocks("main"), "ob": blocks("other")})
    own = F.when(F.col("is_main"), F.pmod(salt, F.col("mb"))).otherwise(F.pmod(salt, F.col("ob"))).cast("int")
    others, mains = F.sequence(F.lit(0), F.col("ob") - 1), F.sequence(F.lit(0), F.col("mb") - 1)
    with_main = F.when(F.col("is_main"), F.transform(others, lambda j: F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), j.alias("j")))).otherwise(
        F.transform(mains, lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    )
    among = F.when(
        ~F.col("is_main") & (F.col("ob") > 1),
        F.transform(F.filter(others, lambda j: j != F.col("own")), lambda j: F.struct(F.lit(1).alias("kind"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"))),
    ).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    dealt = marked.withColumn("own", own).withColumn("cell", F.explode(F.concat(with_main, among)))
    return dealt.select("key", "cell.kind", "cell.i", "cell.j", "rep", "comp", "n", "is_main")


CELL = ["key", "kind", "i", "j"]


def _by_cell(dealt: DataFrame, work, types: pa.Schema, ddl: str) -> DataFrame:
    """``work`` on the rows (an Arrow table) of each cell of at least two rows; a task streams its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def cells(table: pa.Table, last: bool) -> tuple[list, pa.Table]:
            ids = np.stack([table.column(c).to_numpy() for c in CELL], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)])) if len(ids) else np.zeros(0, int)
            ends = np.append(cuts[1:], len(ids))
            out = []
            for a, b in zip(cuts if last else cuts[:-1], ends if last else ends[:-1], strict=True):
                if b - a > 1:
                    out += work(table.slice(a, b - a))
            return out, table.slice(cuts[-1] if len(cuts) and not last else len(ids))

        def give(found: list) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), types.types, strict=True)], schema=types)

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            found, held = cells(held, False)
            yield from give(found)
        if held is not None:
            yield from give(cells(held, True)[0])

    return dealt.repartition(*CELL).sortWithinPartitions(*CELL, "rep").mapInArrow(tidy(run), ddl)


def _numbers(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return (*(rows.column(c).to_numpy() for c in ("rep", "comp", "n")), rows.column("is_main").to_numpy(zero_copy_only=False))


def _likely_across(rows: pa.Table, cut: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows of other components that are likely partners, their estimates), each pair once."""
    rep, comp, n, main = _numbers(rows)
    m = _matrix(rows.column("sketch").combine_chunks())
    for k in np.flatnonzero(~main):
        to = np.flatnonzero((comp != comp[k]) & (main | (rep > rep[k])))
        same = (m[to] == m[k]).sum(1)
        to = to[same >= 0.35 * REGISTERS]  # far below what an estimate at the cut can have
        if len(to):
            est = estimate((m[to] > m[k]).sum(1), (m[to] < m[k]).sum(1), n[to].astype(float), np.full(len(to), float(n[k])))
            if (est >= cut).any():
                yield k, to[est >= cut], est[est >= cut]


def likeliest(dealt: DataFrame, most: int, cut: float) -> DataFrame:
    """Pairs (a, x): for each document a cell's ``most`` likeliest partners in other components."""

    def work(rows: pa.Table) -> list[tuple[np.ndarray, ...]]:
        rep, out = rows.column("rep").to_numpy(), []
        for k, to, est in _likely_across(rows, cut):
            to = to[np.lexsort((rep[to], -est))[:most]]
            out.append((np.minimum(rep[to], rep[k]), np.maximum(rep[to], rep[k])))
        return out

    return _by_cell(dealt, work, pa.schema([("a", pa.int64()), ("x", pa.int64())]), "a long, x long").distinct()


def undecided(dealt: DataFrame, cut: float) -> DataFrame:
    """The rows of cells that have a likely partner in another component there."""

    def work(rows: pa.Table) -> list[tuple[np.ndarray, ...]]:
        hit = np.zeros(len(rows), bool)
        for k, to, _ in _likely_across(rows, cut):
            hit[k] = True
            hit[to] = True
        at = np.flatnonzero(hit)
        return [tuple(rows.column(c).to_numpy(zero_copy_only=False)[at] for c in (*CELL, "rep", "comp", "is_main"))] if len(at) else []

    types = pa.schema([("key", pa.int64()), *((c, pa.int32()) for c in CELL[1:]), ("rep", pa.int64()), ("comp", pa.int64()), ("is_main", pa.bool_())])
    return _by_cell(dealt, work, types, "key long, kind int, i int, j int, rep long, comp long, is_main boolean")


def links_across(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, x) found on the full sets of all rows of a cell: one for each two components that meet a link joins."""

    def work(rows: pa.Table) -> list[tuple[np.ndarray, ...]]:
        rep, main = rows.column("rep").to_numpy(), rows.column("is_main").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("shingles").combine_chunks()]
        size = np.array([len(x) for x in sets])
        _, terms = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        _, local = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
        mark = np.zeros(int(terms.max()) + 1, np.int32)
        out = []
        for k in np.flatnonzero(~main):
            if not (local != local[k]).any():
                break
            own = terms[starts[k] : starts[k] + size[k]]
            mark[own] = 1
            common = np.add.reduceat(mark[terms], starts)
            mark[own] = 0
            to = np.flatnonzero((100 * common >= percent * (size + size[k] - common)) & (local != local[k]))
            for t in to:
                if local[t] != local[k]:
                    out.append((np.minimum(rep[[t]], rep[k]), np.maximum(rep[[t]], rep[k])))
                    local[local == local[t]] = local[k]
        return out

    return _by_cell(dealt, work, pa.schema([("a", pa.int64()), ("x", pa.int64())]), "a long, x long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    s = Scratch(docs.sparkSession, "setsketch")
    cut = least_estimate(percent / 100)
    every = sketch_documents(docs, width, s)
    real = every.where("doc_id IS NOT NULL AND h1 IS NOT NULL")
    classes = s.keep(numbered(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"))))
    # one row for each class: the sketch that its smallest document has (all of the class have the same)
    own = real.select("h1", "h2", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch")
    sketches = s.keep(classes.join(own, ["h1", "h2", "doc"]).select("rep", "n", "sketch").groupBy("rep", "n").agg(F.min("sketch").alias("sketch")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                b = batch.slice(low, 4096)
                k = band_keys(_matrix(b.column("sketch")))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), *(pa.array(np.repeat(b.column(c).to_numpy(), BANDS)) for c in ("rep", "n"))], schema=types)

    banded = sketches.mapInArrow(tidy(keys), "key long, rep long, n long")
    buckets = s.keep(banded.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a"))
    members = s.keep(banded.join(buckets, "key").select("key", "rep", "n", "a"))
    star = members.where("rep <> a").select("a", F.col("rep").alias("x")).distinct()
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("est"), "a"))
    first = s.keep(_likely(star, sketches, cut).withColumn("place", best).where("place <= 3").select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("x")).distinct())
    s.drop(buckets)

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.binary())])
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), width):
                full = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([*_classes(full), pa.array([x.tobytes() for x in full], pa.binary())], schema=types)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("x").alias("rep"))).distinct()

    def full_sets(reps: DataFrame) -> DataFrame:
        """Shingle sets, made from the texts again, of the documents that are checked."""
        wanted = classes.join(reps, "rep", "left_semi")
        texts = pick(docs, doc_id="long", text="string").join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        found = texts.mapInArrow(tidy(set_rows), "h1 long, h2 long, shingles binary").groupBy("h1", "h2").agg(F.max("shingles").alias("shingles"))
        return s.keep(found.join(wanted.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "shingles"))

    def live() -> DataFrame:
        named = s.keep(members.join(comps, members["rep"] == comps["node"], "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
        sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        split = sizes.groupBy("key").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        split = s.keep(split.selectExpr("key", "top.comp AS main", "top.c AS main_rows", "top.s AS main_n", "c - top.c AS other_rows", "s - top.s AS other_n"))
        return _cells(named.join(split, "key"))

    by_rep = sketches.select("rep", "sketch")
    sets, comps = full_sets(ends(first)), None
    comps = s.keep(components(_verified(first, sets, percent).select("a", F.col("x").alias("b")), s))
    more = s.keep(likeliest(live().join(by_rep, "rep"), 4, cut).join(first, ["a", "x"], "left_anti"))
    if not more.isEmpty():
        sets = sets.unionAll(full_sets(ends(more).join(sets, "rep", "left_anti")))
        comps = join_components(comps, _verified(more, sets, percent), s)
    rest = s.keep(undecided(live().join(by_rep, "rep"), cut))
    if not rest.isEmpty():
        sets = sets.unionAll(full_sets(rest.select("rep").distinct().join(sets, "rep", "left_anti")))
        comps = join_components(comps, links_across(rest.join(sets, "rep"), percent), s)
    named = classes.join(comps, classes["rep"] == comps["node"], "left").select("h1", "h2", "doc", F.coalesce("comp", "rep").alias("comp"))
    least = s.keep(named.groupBy("comp").agg(F.min("doc").alias("component_id")))
    by_class = s.keep(named.join(least, "comp").select("h1", "h2", "component_id"))
    s.drop(members)
    rows = every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    out = rows.join(by_class, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, without the documents of each group but its smallest doc_id. Only ids are joined."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("__ls_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__ls_gone"), "left_anti")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents AS d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
