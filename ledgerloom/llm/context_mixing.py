"""Language-model scoring by logistic context mixing.

A word is spelled bit by bit, with a terminator. Several predictors, each a table hashed by the last few
bytes and the bits so far, give the log odds of the next bit; a mixer adds them up with weights that a gate
chooses (how many orders know their context, and which bit it is), trained online by gradient steps; an
adaptive map refines the sum. So a word's spelling has a probability of its own, whether it was ever seen.
Across a document the words are told by bits of their own, which are mixed in the same way with contexts of
the corpus, of the document's kind (one of KINDS clusters of byte pairs, whose number is paid for once), of the
word before and of the document so far (see `text_mixing`); only words that training has not met are spelled.
The score is log10 of the product over the document's words and its end.

The tables get as many slots as the counted contexts of the training words ask for, and the counts of all of
them go in; the mixer and the map learn from all training words, in shards whose results are averaged by how
often each cell was met; the kinds' centres are means over all training documents.
Texts move once, as packed word numbers: a chunk of documents sends its distinct words to their buckets,
where corpus counts are formed and new words' spellings are scored once, and gets the words' numbers back. The
numbers are kept by chunk: one map counts words after words in them, and one scores them.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_mixing
from .common import Scratch, batch_of, chunks, fold, hashed_spans, mix, runs, table, utf8, words
from .text_mixing import CLASSES, UNKNOWN, Code, Scorer, class_of_count

ORDERS = (1, 2, 3, 4, 6)
BLOCKS = (1, 16, 16, 32, 32)
"""Blocks of RANGE slots by order, at least; a larger vocabulary gets more (see `table_blocks`). Order 1 is exact with one."""
SLOTS_PER_PAIR = 16
"""Slots for each counted pair of context and byte, which fills eight of them at most."""
PIECE = 64
"""Words are spelled in pieces of at most so many bytes; contexts begin anew in each."""
CHUNK = 4 << 20
SHARD_BUCKETS = 16
"""The words of so many buckets train one copy of the mixer and the map."""
TRAIN_PIECES = 2048
"""The inputs of so many pieces are held at once while the mixer learns."""
STEP = 2048
"""The mixer and the map take a step after so many bits."""
AT_ONCE = 40
TABLE_TASKS = 8
"""Words are counted in so many tasks for every 64 buckets; see `train`."""
RANGE = 1 << 16
SKETCH_BITS = 12
RATE = 0.02
KINDS = 8
KIND_SAMPLE = 1500
"""The kinds' centres start from at most so many training documents, of KIND_BYTES each at most, and are then moved to the means of all."""
KIND_BYTES = 20_000
KIND_PASSES = 3
PAIRS = 512
START = (0.05, 0.1, 0.6, 0.25)
"""First weights of the experts of `adapt`: spelling, corpus, kind, document so far."""
ADAPT = 0.03
MAP_CELLS = 33
FEW = 6
"""So few documents that are still running are followed one by one."""

SLOTS = sum(BLOCKS) * RANGE


# --- spelling -------------------------------------------------------------------------------------

class Spelling:
    """Pieces of words as rows of bytes with a terminator, longest first."""

    def __init__(self, blob: np.ndarray, size: np.ndarray):
        pieces = np.maximum(1, -(-size // PIECE))
        self.word = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(self.word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = (np.cumsum(size) - size)[self.word] + k * PIECE
        left = size[self.word] - k * PIECE
        # A piece of PIECE bytes that others follow has no terminator.
        self.n = np.where(left > PIECE, PIECE, left + 1)
        self.bytes = np.minimum(left, PIECE)
        order = np.argsort(-self.n, kind="stable")
        self.word, self.start, self.n, self.bytes = self.word[order], self.start[order], self.n[order], self.bytes[order]
        self.blob = np.append(blob, np.uint8(32))

    def part(self, k: int, of: int) -> Spelling:
        """Every so many-th piece, from the k-th on."""
        out = copy.copy(self)
        out.word, out.start, out.n, out.bytes = self.word[k::of], self.start[k::of], self.n[k::of], self.bytes[k::of]
        return out

    def contexts(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]]:
        """By place: the pieces that reach it, their byte there, the context by order (hashed but for order 1), the place."""
        most = int(self.n[0]) if len(self.n) else 0
        last = np.zeros(len(self.n), np.uint64)
        for j in range(most):
            live = int(np.searchsorted(-self.n, -j, side="left"))
            own = slice(0, live)
            c = np.where(j < self.bytes[own], self.blob[np.minimum(self.start[own] + j, len(self.blob) - 1)], np.uint8(32))
            seen = []
            for i, order in enumerate(ORDERS):
                h = last[own] & np.uint64((1 << (8 * order)) - 1)
                # The longest order also knows how far into the word it is.
                seen.append(h if order == 1 else mix(h + np.uint64((i + 1) * 0x51ED2701) + (np.uint64(min(j, 7)) << np.uint64(56) if order == max(ORDERS) else np.uint64(0))))
            yield np.arange(live), c, seen, j
            last[own] = (last[own] << np.uint64(8)) | c.astype(np.uint64)

    def steps(self, blocks: tuple[int, ...] = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]]:
        """As `contexts`, with a slot base by order instead: a context's nodes are the 256 slots from there on, all in one
        block. Windows of different contexts overlap, so a slot is wasted only if no node of any of them falls on it."""
        first = np.cumsum((0, *blocks)) * RANGE
        for live, c, seen, j in self.contexts():
            yield live, c, [_base(h, order, n) + int(f) for h, order, n, f in zip(seen, ORDERS, blocks, first, strict=False)], j


def _base(h: np.ndarray, order: int, blocks: int) -> np.ndarray:
    if order == 1:
        return (h << np.uint64(8)).astype(np.int64)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64) * RANGE + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(RANGE - 255)).astype(np.int64)


def byte_nodes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `bit_nodes` gives, as arrays of eight rows end to end."""
    c, b = c.astype(np.int64)[None, :], np.arange(8)[:, None]
    return ((1 << b) | (c >> (8 - b))).ravel(), ((c >> (7 - b)) & 1).ravel(), np.repeat(b, c.shape[1])


def bit_nodes(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Node (the bits so far after a leading one), bit and number for the eight bits of bytes."""
    c = c.astype(np.int64)
    for b in range(8):
        yield (1 << b) | (c >> (8 - b)), (c >> (7 - b)) & 1, b


def _spelled(blob: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, Spelling]]:
    """Runs of words with a bounded number of bytes, spelled."""
    ends = np.concatenate(([0], np.cumsum(size)))
    for group in _groups(size):
        yield group, Spelling(blob[ends[group.start] : ends[group.stop]], size[group])


def _add_up(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(key, return_inverse=True)
    return u, np.bincount(back, w, len(u))


def count_pairs(blob: np.ndarray, size: np.ndarray, weight: np.ndarray, blocks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The words' pairs of context and byte (slot base * 256 + byte, ascending) and how often they come."""
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    for group, spelled in _spelled(blob, size):
        w, key, n = weight[group][spelled.word], [], []
        for live, c, bases, _ in spelled.steps(blocks):
            key += [base * 256 + c for base in bases]
            n += [w[live]] * len(bases)
        for kept, new in zip((keys, sums), _add_up(np.concatenate(key), np.concatenate(n)), strict=True):
            kept.append(new)
    return _add_up(np.concatenate(keys), np.concatenate(sums))


def sketch_pairs(blob: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> None:
    """Adds the words' pairs of context and byte to a HyperLogLog sketch (orders x registers)."""
    for _, spelled in _spelled(blob, size):
        for _, c, seen, _ in spelled.contexts():
            for i, h in enumerate(seen):
                x = mix(h + (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                rank = 64 - np.floor(np.log2((x << np.uint64(SKETCH_BITS) | np.uint64(1)).astype(np.float64)))
                np.maximum.at(sketch[i], (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), rank.astype(np.uint8))


def sketched(registers: np.ndarray) -> float:
    """How many different things a sketch has met, within some two hundredths."""
    m = len(registers)
    n = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(np.float64)).sum()
    free = int((registers == 0).sum())
    return m * math.log(m / free) if n <= 2.5 * m and free else float(n)


def table_blocks(pairs: list[float]) -> tuple[int, ...]:
    """Blocks by order for so many pairs of context and byte, without a limit."""
    return tuple(1 if order == 1 else max(least, math.ceil(SLOTS_PER_PAIR * n / RANGE)) for order, least, n in zip(ORDERS, BLOCKS, pairs, strict=True))


def _groups(size: np.ndarray, most: int = 20_000) -> Iterator[slice]:
    """Runs of words with a bounded number of bytes."""
    ends = np.cumsum(size + 1)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 8 * most, side="right")))
        yield slice(start, stop)
        start = stop


def stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


_EXACT = 32


def code_of(n: np.ndarray) -> np.ndarray:
    """Counts as a byte: below 32 as they are, then in eighths of a doubling."""
    return np.where(n < _EXACT, np.round(n), np.minimum(_EXACT + np.round(8 * np.log2(np.maximum(n, _EXACT) / _EXACT)), 255)).astype(np.uint16)


def pack_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return code_of(zeros) << np.uint16(8) | code_of(ones)


_COUNTS = np.where(np.arange(256.0) < _EXACT, np.arange(256.0), _EXACT * np.exp2((np.arange(256.0) - _EXACT) / 8))
"""Counts by their bytes."""


def _inputs() -> tuple[np.ndarray, np.ndarray]:
    """By packed counts: the predictor's input, and whether it knows its context."""
    zeros, ones = np.repeat(_COUNTS, 256), np.tile(_COUNTS, 256)
    total = zeros + ones
    sure = np.minimum(np.ceil(np.log2(total + 1)), 15)
    return (np.clip(stretch((ones + 0.05) / (total + 0.1)), -7.99, 7.99) * (sure > 0) * (0.5 + 0.05 * sure)).astype(np.float32), (sure > 1).astype(np.int64)


_INPUT, _KNOWN = _inputs()


def _once_less() -> np.ndarray:
    """By the bit that comes and packed counts: the packed counts as if it had come once less."""
    v = np.arange(1 << 16)
    return np.concatenate([v - np.where((n > 0) & (n < _EXACT), step, 0) for n, step in ((v >> 8, 256), (v & 255, 1))])


_INPUT_LESS, _KNOWN_LESS = _INPUT[_once_less()], _KNOWN[_once_less()]


class Mixer:
    """Predictor tables (packed counts of zeros and ones), gated weights, adaptive map."""

    inputs = len(ORDERS) + 1

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, blocks: tuple[int, ...] = BLOCKS):
        self.packed, self.blocks = pack_counts(zeros, ones), blocks
        self.weights = np.full(((len(ORDERS) + 1) * 8, self.inputs), 0.25, np.float32)
        self.map = np.tile(squash(np.linspace(-8, 8, MAP_CELLS)).astype(np.float32), (256, 1))

    def look(self, slots: list[np.ndarray], bit: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (rows x inputs) and gates from table entries; with the bits that come, as if these had come once less."""
        x = np.empty((len(slots[0]), self.inputs), np.float32)
        known = np.zeros(len(slots[0]), np.int64)
        input_, known_ = (_INPUT, _KNOWN) if own is None else (_INPUT_LESS, _KNOWN_LESS)
        for i, s in enumerate(slots):
            v = self.packed[s].astype(np.int64)
            if own is not None:
                v += own << 16
            x[:, i] = input_[v]
            known += known_[v]
        x[:, -1] = 0.3
        return x, known * 8 + bit

    def refine(self, s: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The map's probability, the cell below and how far above it."""
        place = (np.clip(s, -7.999, 7.999) + 8) * ((MAP_CELLS - 1) / 16)
        cell = place.astype(np.int64)
        far = (place - cell).astype(np.float32)
        return self.map[node, cell] * (1 - far) + self.map[node, cell + 1] * far, cell, far

    def probability(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.einsum("ij,ij->i", x, self.weights[gate])
        return s, np.clip((squash(s) + self.refine(s, node)[0]) / 2, 1e-5, 1 - 1e-5)

    def train(self, blob: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Online, over all of the words: each bit is predicted as if its own word had come once less.

        Gives how often each gate and each cell of the map was met.
        """
        met, cells = np.zeros(len(self.weights)), np.zeros(self.map.size)
        weights, table = self.weights.astype(np.float64), self.map.astype(np.float64)
        self.map, flat = table, table.reshape(-1)
        for _, spelled in _spelled(blob, size):
            parts = -(-len(spelled.word) // TRAIN_PIECES)
            for k in range(parts):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for live, c, bases, _ in spelled.part(k, parts).steps(self.blocks):
                    node, bit, b = byte_nodes(c)
                    x, gate = self.look([np.tile(base, 8) + node for base in bases], b, bit)
                    for kept, value in zip(rows, (np.tile(live, 8), x, gate, node, bit), strict=True):
                        kept.append(value)
                order = np.argsort(np.concatenate(rows[0]).astype(np.uint16), kind="stable")  # fewer than TRAIN_PIECES
                x, gate, node, bit = (np.concatenate(r)[order] for r in rows[1:])
                met += np.bincount(gate, minlength=len(met))
                at = gate[:, None] * self.inputs + np.arange(self.inputs)
                for step in range(0, len(order), STEP):
                    own = slice(step, step + STEP)
                    xs, y = x[own], bit[own]
                    s = np.einsum("ij,ij->i", xs, weights[gate[own]])
                    # Many bits of one gate or cell in a step count as AT_ONCE of their mean.
                    rate = RATE / np.maximum(np.bincount(gate[own], minlength=len(weights)) / AT_ONCE, 1)
                    weights += np.bincount(at[own].ravel(), ((y - squash(s))[:, None] * xs).ravel(), weights.size).reshape(weights.shape) * rate[:, None]
                    p, cell, far = self.refine(s, node[own])
                    cell = node[own] * MAP_CELLS + cell
                    cell, part, off = np.append(cell, cell + 1), np.append(1 - far, far), y - p
                    n = np.bincount(cell, part, flat.size)
                    flat += np.bincount(cell, part * np.append(off, off), flat.size) * (RATE / np.maximum(n / AT_ONCE, 1))
                    cells += n
        self.weights, self.map = weights.astype(np.float32), np.clip(table, 1e-4, 1 - 1e-4).astype(np.float32)
        return met, cells.reshape(self.map.shape)

    def costs(self, blob: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits of each word's spelling."""
        out = np.zeros(len(size))
        for group, spelled in _spelled(blob, size):
            total = np.zeros(len(spelled.word))
            for live, c, bases, _ in spelled.steps(self.blocks):
                node, bit, b = byte_nodes(c)
                x, gate = self.look([np.tile(base, 8) + node for base in bases], b)
                p = self.probability(x, gate, node)[1]
                total[live] -= np.log2(np.where(bit == 1, p, 1 - p).reshape(8, -1).astype(np.float64).prod(axis=0))
            out[group] = np.bincount(spelled.word, total, group.stop - group.start)
        return out


# --- the corpus -----------------------------------------------------------------------------------

def _cut(a: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [a[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]


def _gather(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not size.sum():
        return np.zeros(0, np.uint8)
    return blob[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


_PAIRS = "r long, at binary, byte binary, w binary"
_PACKED = "g long, block long, ends long, hash binary, blob binary, size binary, n binary, idx binary"


def pair_profiles(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x PAIRS: roots of the shares of hashed letter pairs (lower case) by text."""
    rows = len(at) - 1
    if len(data) < 2:
        return np.zeros((rows, PAIRS))
    c = data | np.uint8(32)
    pair = (c[:-1].astype(np.uint16) * np.uint16(131) + c[1:].astype(np.uint16) * np.uint16(29)) & np.uint16(PAIRS - 1)
    counts, begin = np.zeros((rows, PAIRS), np.int64), 0
    while begin < rows:  # some rows at a time, so that their counts stay near
        end = min(max(begin + 1, int(np.searchsorted(at, at[begin] + (1 << 17), side="right")) - 1), rows)
        own = pair[at[begin] : at[end]]
        place = np.repeat(np.arange(end - begin, dtype=np.int32) * np.int32(PAIRS), np.diff(at[begin : end + 1]))[: len(own)]
        counts[begin:end] = np.bincount(place + own, minlength=(end - begin) * PAIRS).reshape(-1, PAIRS)
        begin = end
    x = np.sqrt(counts.astype(np.float64))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def find_kinds(docs: DataFrame) -> np.ndarray:
    """Centres of KINDS clusters (k-means) of the training documents; fewer documents: fewer centres.

    A bounded sample gives the places to start from; each further pass moves the centres to the means of all documents.
    """
    some = docs.where(F.col("train") & F.octet_length("text").between(200, KIND_BYTES))
    ids = [r[0] for r in some.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").select("doc_id").limit(KIND_SAMPLE).collect()]
    if not ids:
        return _all_kinds(docs, np.ones((1, PAIRS)) / PAIRS**0.5)
    rows = some.where(F.col("doc_id").isin(ids)).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text").select("text").limit(KIND_SAMPLE).toArrow().combine_chunks()
    x = pair_profiles(*utf8(rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text")))
    centres = x[:1]
    for _ in range(1, min(KINDS, len(x))):
        centres = np.concatenate((centres, x[[int((x @ centres.T).max(axis=1).argmin())]]))
    for _ in range(20):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.array([x[own == k].sum(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return _all_kinds(docs, centres)


def _all_kinds(docs: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after KIND_PASSES passes over all training documents. Sums are of integers, so their order is all one."""

    def add(rows: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sums = np.zeros((len(centres), PAIRS), np.int64)
        for k, x in rows:
            sums[k] += x
        return batch_of(k=np.arange(len(sums)), sums=pa.array([x.tobytes() for x in sums], pa.binary()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def profiles() -> Iterator[tuple[int, np.ndarray]]:
            for _, data, at in chunks(_joined(batches), "text", CHUNK):
                x = pair_profiles(data, at)
                own, x = (x @ centres.T).argmax(axis=1), np.round(x * (1 << 30)).astype(np.int64)
                for k in np.unique(own).tolist():
                    yield k, x[own == k].sum(axis=0)

        yield add(profiles())

    def whole(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in part.column("sums").to_pylist()], axis=0)
        return pa.table({"k": part.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.where("train").select("text")
    for _ in range(KIND_PASSES):
        moved = centres.copy()
        for k, x in rows.mapInArrow(near, "k long, sums binary").groupBy("k").applyInArrow(whole, "k long, sums binary").collect():
            x = np.frombuffer(x, np.int64).astype(np.float64)
            if x.any():
                moved[k] = x / np.linalg.norm(x)
        centres = moved
    return centres


def pack_words(docs: DataFrame, buckets: int, centres: np.ndarray) -> DataFrame:
    """Of rows (doc_id, text, train): by chunk and kind one row with its documents' word numbers (g null), and one for each
    bucket its distinct words fall in. The kind is the block's number modulo KINDS."""

    def pack(block: int, batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        lower, start, end, first = words(data, at)
        h = hashed_spans(lower, start, end)
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        count = np.diff(first)
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(back, np.repeat(train, count), len(u)).astype(np.int64)
        size = (end - start)[one]
        bucket = (u >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        size, h = size[order], u[order]
        blob = _gather(lower, start[one][order], size)
        place = np.concatenate(([0], np.cumsum(size)))
        there, begin, stop = runs(bucket[order])
        docs_ = pa.RecordBatch.from_arrays([batch.column(0), pa.array(train), pa.array(count), pa.array(np.diff(at))], names=["doc_id", "train", "count", "bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs_.schema) as w:
            w.write_batch(docs_)
        code = pa.compress(back.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
        binary = lambda x, last: pa.array([*x, last], pa.binary())
        return batch_of(
            g=pa.array([*there.astype(np.int64).tolist(), None], pa.int64()),
            block=np.full(len(there) + 1, block),
            ends=np.append(np.zeros(len(there), np.int64), train.sum()),
            hash=binary(_cut(h, begin, stop), code),
            blob=binary(_cut(blob, place[begin], place[stop]), sink.getvalue().to_pybytes()),
            size=binary(_cut(size.astype(np.uint32), begin, stop), len(back).to_bytes(8, "little")),
            n=binary([_short(n[order][x:y]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], None),
            idx=binary([_gaps(order[x:y]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], None),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch, data, at in chunks(_joined(batches), "text", CHUNK):
            kind = (pair_profiles(data, at) @ centres.T).argmax(axis=1)
            for k in np.unique(kind).tolist():
                own = batch.take(pa.array(np.flatnonzero(kind == k)))
                yield pack(block * KINDS + k, own, *utf8(own.column(1)))
            block += 1

    return docs.select("doc_id", "text", "train").mapInArrow(run, _PACKED)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that a chunk's distinct words are few against its words."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            size += b.nbytes
        if size > CHUNK // 2:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def vocabulary(packed: DataFrame) -> DataFrame:
    """Per bucket one row (g, words, total, classes, blob, size, n) with its distinct words and training counts by kind, and one per chunk (g, block, idx, pos).

    `classes` holds its training words by class of frequency, then their tokens.
    """

    def run(part: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x, t) for x in part.column(c).to_pylist()]
        hashes, sizes = get("hash", np.uint64), get("size", np.uint32)
        u, one, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        kind = np.repeat(part.column("block").to_numpy() % KINDS, [len(x) for x in hashes])
        n = np.bincount(back * KINDS + kind, np.concatenate([_ints(x, len(h)) for x, h in zip(part.column("n").to_pylist(), hashes, strict=True)]), len(u) * KINDS).astype(np.int64).reshape(-1, KINDS)
        size = np.concatenate(sizes).astype(np.int64)
        blob = _gather(np.concatenate(get("blob", np.uint8)), (np.cumsum(size) - size)[one], size[one])
        stop = np.cumsum([len(x) for x in hashes])
        g = part.column("g")[0].as_py()
        every = n.sum(axis=1)
        known = every[every > 0]
        of = class_of_count(known)
        classes = [*np.bincount(of, minlength=CLASSES).tolist(), *np.bincount(of, known, CLASSES).astype(np.int64).tolist()]
        rows = part.num_rows
        none = [None] * rows
        return pa.table({
            "g": pa.array([g] * (rows + 1), pa.int64()),
            "block": pa.array([None, *part.column("block").to_pylist()], pa.int64()),
            "words": pa.array([len(known), *none], pa.int64()),
            "total": pa.array([n.sum(axis=0).tolist(), *none], pa.list_(pa.int64())),
            "classes": pa.array([classes, *none], pa.list_(pa.int64())),
            "blob": pa.array([blob.tobytes(), *none], pa.binary()),
            "size": pa.array([size[one].astype(np.uint32).tobytes(), *none], pa.binary()),
            "n": pa.array([_short(n), *none], pa.binary()),
            "idx": pa.array([None, *part.column("idx").to_pylist()], pa.binary()),
            "pos": pa.array([None, *(_gaps(back[x - len(h) : x]) for x, h in zip(stop.tolist(), hashes, strict=True))], pa.binary()),
        })

    return packed.where("g IS NOT NULL").groupBy("g").applyInArrow(run, "g long, block long, words long, total array<long>, classes array<long>, blob binary, size binary, n binary, idx binary, pos binary")


def _unpack(blob: bytes, size: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(blob, np.uint8), np.frombuffer(size, np.uint32).astype(np.int64), _ints(n, len(size) // 4 * KINDS).reshape(-1, KINDS)


def _short(n: np.ndarray) -> bytes:
    """Counts in four bytes each where they fit, else in eight; all first bytes, then all second ones and so on, as shuffles
    press runs of zeros well."""
    n = np.ascontiguousarray(n, np.int32 if n.max(initial=0) < 1 << 31 else np.int64).ravel()
    return n.view(np.uint8).reshape(-1, n.itemsize).T.tobytes()


def _ints(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    width = len(data) // n
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(np.int32 if width == 4 else np.int64).ravel().astype(np.int64)


def _gaps(x: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them, behind a byte that tells how many bytes each has."""
    d = np.diff(x.astype(np.int64), prepend=0)
    width = next(w for w in (1, 2, 4, 8) if d.max(initial=0) < 1 << 8 * w - (w == 8))
    return bytes([width]) + d.astype(f"u{width}").tobytes()


def _ascending(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"u{data[0]}", offset=1), dtype=np.int64)


def train(vocab: DataFrame, ends: int) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray]]:
    """The tables, and the weights and the map, from all words with a training count.

    The different pairs of context and byte are counted first, by a sketch; the tables get their size by them. A task adds
    up its words' pairs; they are added up again by block of slots, and what reaches the driver is the packed tables, two
    bytes a slot. Then every shard of the words trains a copy of the mixer and the map, which are averaged.
    """
    rows = vocab.where("block IS NULL").select("g", "blob", "size", "n")
    buckets = max(rows.count(), 1)
    tasks = TABLE_TASKS * max(1, buckets // 64)

    def trained(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for blob, size, n in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
            blob, size, n = _unpack(blob, size, n)
            n = n.sum(axis=1)
            own = n > 0
            yield _gather(blob, (np.cumsum(size) - size)[own], size[own]), size[own], n[own].astype(np.float64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registers = np.zeros((len(ORDERS), 1 << SKETCH_BITS), np.uint8)
        for b in batches:
            for blob, size, _ in trained(b):
                sketch_pairs(blob, size, registers)
        yield batch_of(i=np.arange(len(ORDERS)), registers=pa.array([x.tobytes() for x in registers], pa.binary()))

    def most(part: pa.Table) -> pa.Table:
        top = np.max([np.frombuffer(x, np.uint8) for x in part.column("registers").to_pylist()], axis=0)
        return pa.table({"i": part.column("i").slice(0, 1), "registers": pa.array([top.tobytes()], pa.binary())})

    pairs = dict(rows.coalesce(tasks).mapInArrow(sketch, "i long, registers binary").groupBy("i").applyInArrow(most, "i long, registers binary").collect())
    blocks = table_blocks([sketched(np.frombuffer(pairs[i], np.uint8)) if i in pairs else 0 for i in range(len(ORDERS))])

    def by_block(key: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        there, begin, end = runs(key // (256 * RANGE))
        binary = lambda x: pa.array(_cut(x, begin, end), pa.binary())
        return batch_of(r=there, at=binary((key // 256 % RANGE).astype(np.uint16)), byte=binary((key % 256).astype(np.uint8)), w=binary(w.astype(np.float32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in batches:
            for part in trained(b):
                for kept, new in zip((keys, sums), count_pairs(*part, blocks), strict=True):
                    kept.append(new)
        key, w = _add_up(np.concatenate(keys), np.concatenate(sums))
        if len(key):
            yield by_block(key, w)

    # Each document's end is a word without bytes.
    end = by_block(*count_pairs(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.array([float(ends)]), blocks)) if ends else None
    end = {r: x for r, *x in zip(*end.to_pydict().values(), strict=True)} if end else {}

    def add(part: pa.Table) -> pa.Table:
        r = part.column("r")[0].as_py()
        zeros, ones = np.zeros(RANGE), np.zeros(RANGE)
        for at, byte, w in [*zip(*(part.column(c).to_pylist() for c in ("at", "byte", "w")), strict=True), *([end[r]] if r in end else [])]:
            at, w = np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(w, np.float32).astype(np.float64)
            for node, bit, _ in bit_nodes(np.frombuffer(byte, np.uint8)):
                np.add.at(ones, at + node, w * bit)
                np.add.at(zeros, at + node, w * (1 - bit))
        return pa.table({"r": pa.array([r], pa.int64()), "packed": pa.array([pack_counts(zeros, ones).tobytes()], pa.binary())})

    model = Mixer(np.zeros(0), np.zeros(0), blocks)
    model.packed = np.zeros(sum(blocks) * RANGE, np.uint16)
    spark = vocab.sparkSession
    # A row of nothing for each block that the ends' counts fall in, so that it is there without words too.
    kept = rows.coalesce(tasks).mapInArrow(count, _PAIRS)
    if end:
        kept = kept.union(spark.createDataFrame([(r, b"", b"", b"") for r in end], _PAIRS))
    for r, x in kept.groupBy("r").applyInArrow(add, "r long, packed binary").toLocalIterator():
        model.packed[r * RANGE : (r + 1) * RANGE] = np.frombuffer(x, np.uint16)
    shared = spark.sparkContext.broadcast(model)

    def learn(part: pa.Table) -> pa.Table:
        own = copy.copy(shared.value)
        met, cells = np.zeros(len(own.weights)), np.zeros(own.map.shape)
        for blob, size, _ in trained(part.sort_by("g")):
            a, b = own.train(blob, size)
            met, cells = met + a, cells + b
        sums = np.concatenate([x.ravel() for x in (own.weights * met[:, None], met, own.map * cells, cells)])
        return pa.table({"k": np.arange(8), "sums": pa.array([x.tobytes() for x in np.array_split(sums, 8)], pa.binary())})

    def average(part: pa.Table) -> pa.Table:
        # Sorted, so that the order of the shards is all one.
        total = np.sort([np.frombuffer(x, np.float64) for x in part.column("sums").to_pylist()], axis=0).sum(axis=0)
        return pa.table({"k": part.column("k").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    shards = rows.withColumn("shard", F.col("g") % max(1, buckets // SHARD_BUCKETS)).groupBy("shard").applyInArrow(learn, "k long, sums binary")
    total = dict(shards.groupBy("k").applyInArrow(average, "k long, sums binary").collect())
    weights, table = model.weights, model.map
    if total:
        ends_ = np.cumsum([weights.size, len(weights), table.size])
        w, met, m, cells = np.split(np.concatenate([np.frombuffer(total[k], np.float64) for k in range(8)]), ends_)
        met, cells = met[:, None], cells.reshape(table.shape)
        weights = np.where(met > 0, w.reshape(weights.shape) / np.maximum(met, 1e-9), weights).astype(np.float32)
        table = np.where(cells > 0, m.reshape(table.shape) / np.maximum(cells, 1e-9), table).astype(np.float32)
    return shared, (weights, table)


def numbers_of(code: Code, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of a bucket's words by their training counts; `start`: how many words of each class are in the buckets before."""
    out = np.full(len(n), UNKNOWN, np.int64)
    own = np.flatnonzero(n > 0)
    k = class_of_count(n[own])
    order = np.argsort(k, kind="stable")
    own, k = own[order], k[order]
    there, begin, end = runs(k)
    rank = np.arange(len(k)) - np.repeat(begin, end - begin)
    first = np.zeros(CLASSES, np.int64)
    first[code.classes] = code.first[2:]
    out[own] = first[k] + start[k] + rank
    return out


def _summed(parts: DataFrame, size: int, dtype: type) -> Iterator[tuple[int, np.ndarray]]:
    """Arrays that tasks have cut into ranges (r, x: int64, compressed), added up by range."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in part.column("x").to_pylist():
            total += np.frombuffer(pa.decompress(x, size * 8, codec="zstd", asbytes=True), np.int64)
        x = pack_counts(total[0::2], total[1::2]) if dtype is np.uint16 else total
        return pa.table({"r": part.column("r").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary())})

    for r, x in parts.groupBy("r").applyInArrow(add, "r long, x binary").toLocalIterator():
        yield r, np.frombuffer(x, dtype)


def _ranges(x: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for r in range(-(-len(x) // size)):
        own = x[r * size : (r + 1) * size].astype(np.int64)
        if own.any():
            yield batch_of(r=np.array([r]), x=pa.array([pa.compress(np.append(own, np.zeros(size - len(own), np.int64)).tobytes(), codec="zstd", asbytes=True)], pa.binary()))


def corpus_tables(code: Code, heads: DataFrame, starts: Broadcast, kind_ends: np.ndarray) -> np.ndarray:
    """Packed counts of the code's nodes: of the corpus, then by kind."""
    size = RANGE * KINDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((code.groups, KINDS), np.int64)
        for b in batches:
            for g, n, words_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = _ints(n, len(words_) // 4 * KINDS).reshape(-1, KINDS)
                np.add.at(out, code.group_of(numbers_of(code, n.sum(axis=1), starts.value[g])), n)
        yield from _ranges(out.ravel(), size)

    counts = np.zeros((-(-code.groups // RANGE) * RANGE, KINDS), np.int64)
    tasks = TABLE_TASKS * max(1, len(starts.value) // 64)
    for r, x in _summed(heads.select("g", "n", "size").coalesce(tasks).mapInArrow(count, "r long, x binary"), size, np.int64):
        counts[r * RANGE : (r + 1) * RANGE] = x.reshape(-1, KINDS)
    counts = counts[: code.groups]
    counts[0] = kind_ends
    once = np.flatnonzero(code.classes == 0)
    # A word that was not met is as likely as words met once are.
    counts[1] = counts[code.group0[2 + once[0]] :].sum(axis=0) if len(once) else 0
    zeros, ones = code.tables(np.column_stack((counts.sum(axis=1), counts)))
    return pack_counts(zeros, ones)


def pair_table(code: Code, chunks_: DataFrame) -> np.ndarray:
    """Packed counts of the training documents' bits after the word before; behind them an empty slot, then those of words that come again."""
    slots = code.pair_slots + 1 + text_mixing.AGAIN
    size = 2 * min(code.pair_slots, 4 * RANGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * slots, np.uint32)
        for _, about, number in _sequences(batches):
            n, train = about.column("count").to_numpy() + 1, about.column("train").to_numpy(zero_copy_only=False)
            text_mixing.count_pairs(code, number[np.repeat(train, n)], n[train], lambda at: np.add.at(out, at, np.uint32(1)))
        yield from _ranges(out, size)

    packed = np.zeros(-(-2 * slots // size) * size // 2, np.uint16)
    for r, x in _summed(chunks_.mapInArrow(count, "r long, x binary"), size, np.uint16):
        packed[r * size // 2 : (r + 1) * size // 2] = x
    return packed[:slots]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """Kind, documents and words' numbers of chunks."""
    for b in batches:
        for i in range(b.num_rows):
            about = pa.ipc.open_stream(b.column(1)[i].as_py()).read_all().combine_chunks()
            n = int(about.column("count").to_numpy().sum()) + about.num_rows
            yield b.column(0)[i].as_py() % KINDS, about, np.frombuffer(pa.decompress(b.column(2)[i].as_py(), n * 4, codec="zstd", asbytes=True), np.uint32).astype(np.int64)


def _alone(p: np.ndarray, weights: list[float], t: int) -> float:
    """The rest of one document, whose word t comes next: what `adapt` does, without arrays."""
    total, product = 0.0, 1.0
    a, b, c, d = weights
    for w, x, y, z in p.tolist():
        w, x, y, z = a * w, b * x, c * y, d * z
        whole = w + x + y + z
        if whole < 1e-200 or product < 1e-100:
            total += math.log10(product)
            product = 1.0
            total += math.log10(whole)
        else:
            product *= whole
        rate = max(ADAPT, 1 / (t + 20))
        a, b, c, d = max(a + rate * (w / whole - a), 0.01), b + rate * (x / whole - b), c + rate * (y / whole - c), d + rate * (z / whole - d)
        e = a + b + c + d
        a, b, c, d = a / e, b / e, c / e, d / e
        t += 1
    return total + math.log10(product)


def adapt(count: np.ndarray, spelled: np.ndarray, experts: list[np.ndarray], start: tuple) -> np.ndarray:
    """log10 probability of documents whose words lie end to end: `count` words each, bits of spelling and the other experts' probabilities by word.

    A linear mixture of words' probabilities, for experts that give no bits. The query's scores don't come from it but from `text_mixing`. A document's weights begin at `start`; after every word they move towards each expert's part in its probability.
    """
    order = np.argsort(-count, kind="stable")
    n, begin = count[order], (np.cumsum(count) - count)[order]
    most = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(most), side="left").tolist()
    p = np.column_stack((np.exp2(-np.minimum(spelled, 900.0)), *experts))
    weights, total = np.tile(np.array(start), (len(n), 1)), np.zeros(len(n))
    for t, k in enumerate(live):
        if k <= FEW:
            for i in range(k):
                total[i] += _alone(p[begin[i] + t : begin[i] + n[i]], weights[i].tolist(), t)
            break
        at = begin[:k] + t
        part = weights[:k] * p[at]
        whole = part.sum(axis=1)
        total[:k] += np.log10(whole)
        weights[:k] += max(ADAPT, 1 / (t + 20)) * (part / whole[:, None] - weights[:k])
        weights[:k, 0] = np.maximum(weights[:k, 0], 0.01)
        weights[:k] /= weights[:k].sum(axis=1, keepdims=True)
    # Spellings beyond what a double holds: what was cut off of them.
    far = spelled > 900
    if far.any():
        doc = np.repeat(np.arange(len(count)), count)
        total -= (np.bincount(doc[far], spelled[far] - 900, len(count)) * np.log10(2))[order]
    out = np.empty(len(n))
    out[order] = total
    return out


def mixing_scores(docs: DataFrame) -> DataFrame:
    """Scores of rows (doc_id, text, train): doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows with train; null and empty texts are their end alone. Repeated rows stay. Without a
    training row all counts are 0: base_score is 0 and the score that of untrained tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    buckets = max(64, 4 * docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    packed = scratch.keep(pack_words(rows, buckets, find_kinds(rows)))
    vocab = scratch.keep(vocabulary(packed))
    blocks = scratch.keep(packed.where("g IS NULL").drop("g"))
    scratch.drop(packed)
    scratch.sweep()
    heads = vocab.where("block IS NULL")
    distinct = heads.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    totals, kind_ends = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for k, n in heads.select(F.posexplode("total")).groupBy("pos").sum("col").collect():
        totals[k] = n
    for k, n in blocks.select((F.col("block") % KINDS).alias("k"), "ends").groupBy("k").sum("ends").collect():
        kind_ends[k] = n
    ends = int(kind_ends.sum())
    distinct, total = distinct + (ends > 0), int(totals.sum()) + ends
    totals = totals + kind_ends
    prior = np.log10((kind_ends + 1) / (ends + KINDS))
    shared, learned = train(vocab, ends)
    own = sorted(heads.select("g", "classes").collect())
    classes = np.array([r["classes"] for r in own], np.int64).reshape(-1, 2, CLASSES)
    code = Code(*classes.sum(axis=0), ends)
    before = np.cumsum(classes[:, 0], axis=0) - classes[:, 0]
    starts = spark.sparkContext.broadcast({r["g"]: x for r, x in zip(own, before, strict=True)})
    scratch.sweep()

    def costs(blob: np.ndarray, size: np.ndarray) -> np.ndarray:
        model = copy.copy(shared.value)
        model.weights, model.map = learned
        return model.costs(blob, size)

    def spell(part: pa.Table) -> pa.Table:
        head = part.filter(pa.compute.is_null(part.column("block")))
        blob, size, n = _unpack(*(head.column(c)[0].as_py() for c in ("blob", "size", "n")))
        every = n.sum(axis=1)
        number, cost, new = numbers_of(code, every, starts.value[part.column("g")[0].as_py()]), np.zeros(len(size), np.float32), every == 0
        cost[new] = costs(_gather(blob, (np.cumsum(size) - size)[new], size[new]), size[new])
        rest = part.filter(pa.compute.is_valid(part.column("block")))
        pos = [_ascending(x) for x in rest.column("pos").to_pylist()]
        # Only new words have a cost.
        return pa.table({"block": rest.column("block"), "idx": rest.column("idx"), "n": pa.array([_short(np.concatenate((every[p], number[p]))) for p in pos], pa.binary()), "cost": pa.array([cost[p[new[p]]].tobytes() for p in pos], pa.binary()), "docs": pa.nulls(rest.num_rows, pa.binary())})

    floor = np.log10(total + 0.1 * (distinct + 1)) if total else 0.0

    def assemble(part: pa.Table) -> pa.Table:
        head = part.filter(pa.compute.is_valid(part.column("docs")))
        rest = part.filter(pa.compute.is_null(part.column("docs")))
        about = pa.ipc.open_stream(head.column("docs")[0].as_py()).read_all().combine_chunks()
        place = np.frombuffer(pa.decompress(head.column("idx")[0].as_py(), int.from_bytes(head.column("n")[0].as_py(), "little") * 4, codec="zstd", asbytes=True), np.uint32)
        count = about.column("count").to_numpy()
        parts = [_ascending(x) for x in rest.column("idx").to_pylist()]
        distinct_ = sum(map(len, parts))
        n, cost = np.zeros((distinct_ + 1, 2), np.int64), np.zeros(distinct_ + 1)
        for i, x, y in zip(parts, rest.column("n").to_pylist(), rest.column("cost").to_pylist(), strict=True):
            n[i] = _ints(x, 2 * len(i)).reshape(2, -1).T
            cost[i[n[i, 0] == 0]] = np.frombuffer(y, np.float32)
        n[-1] = ends, text_mixing.END
        # The end stands after each document's words.
        every = np.insert(place.astype(np.int64), np.cumsum(count), distinct_)
        doc = np.repeat(np.arange(len(count)), count + 1)
        c = n[every, 0]
        about = about.append_column("known", pa.array(np.bincount(doc, c > 0, len(count)).astype(np.int64)))
        about = about.append_column("base", pa.array(np.bincount(doc, np.log10(c + 0.1) - floor, len(count)) if total else np.zeros(len(count))))
        about = about.append_column("spelled", pa.array(np.bincount(doc, cost[every], len(count)) * np.log10(2)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as w:
            w.write_table(about)
        return pa.table({"block": part.column("block").slice(0, 1), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "words": pa.array([pa.compress(n[every, 1].astype(np.uint32).tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    spelled = vocab.groupBy("g").applyInArrow(spell, "block long, idx binary, n binary, cost binary, docs binary")
    texts = blocks.select("block", F.col("hash").alias("idx"), F.col("size").alias("n"), F.lit(None).cast("binary").alias("cost"), F.col("blob").alias("docs"))
    kept = scratch.keep(spelled.union(texts).groupBy("block").applyInArrow(assemble, "block long, docs binary, words binary"))
    packed = corpus_tables(code, heads, starts, kind_ends)
    for x in (vocab, blocks):
        scratch.drop(x)
    scratch.sweep()
    scorer = spark.sparkContext.broadcast(Scorer(code, packed, pair_table(code, kept), _COUNTS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, about, number in _sequences(batches):
            size = about.column("count").to_numpy() + 1
            out = scorer.value.score(number, size, kind) + prior[kind] - about.column("spelled").to_numpy()
            nbytes = about.column("bytes").to_numpy()
            columns = {"doc_id": about.column("doc_id"), "n_bytes": nbytes, "n_tokens": size, "n_known": about.column("known"), "train_tokens": np.full(len(size), total), "base_score": about.column("base"), "score": out, "bits_per_byte": -out * np.log2(10) / np.maximum(nbytes, 1)}
            yield from pa.table(columns).to_batches()

    return kept.mapInArrow(score, "doc_id long, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) != 0).alias("train"))
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return mixing_scores(docs).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
