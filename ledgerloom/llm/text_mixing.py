"""Logistic mixing of a text's bits, with contexts that reach across its words.

A word is told by bits: first its class (words of nearly the same count; the end and words not met in training are
classes of their own) along a Huffman tree, then its number in the class, highest bit first, down to a group of words.
Where the document has had a word of this group, one more bit tells whether it is that one again; the others of a group
are equally likely. A word that was not met is spelled behind its class (see `context_mixing.Mixer`).

Every bit is predicted in four contexts: the corpus, the document's kind, the corpus after the word before, and the
document so far; whether a word comes again also depends on whether the word before is the same as the last time. Their
log odds are added up with weights that a gate chooses (class or number), and an adaptive map refines the sum. Weights
and map begin alike in every document and learn online, after every block of its words (see `blocks_of`).

A group holds about sqrt(N) / SPARE of the N training tokens, or one word that holds more: the tables grow as sqrt(N).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np

from .common import mix

END, UNKNOWN = 0, 1
CLASSES = 64
SPARE = 64
LEADING = 256
"""So many of the most frequent words are contexts of their own for the number of the next word; others are by class."""
PAIR_SLOTS = 16
WINDOW = 1 << 15
"""Documents are read together up to about so many words; longer ones alone, in windows of so many words."""
LANES = 1 << 12
GAPS = 8
AGAIN = 2 * GAPS
"""Contexts of whether a word comes again: how far back the last of its group is, and whether the word before is the same."""
GATES = 2
CELLS = 33
RATE = 0.05
MAP_RATE = 0.01
NEAR = (20.0, 100.0, 150.0)
"""How many words a context's parent weighs: kind, after a word, document."""
START = np.array([[0.0, 0.4, 0.3, 0.3]] * GATES, np.float32)
"""First weights by gate: corpus, kind, corpus after a word, document."""


def class_of_count(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(np.int64)


def _huffman(mass: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code lengths, inner nodes and bits (classes x depth)."""
    heap = [(m, i, i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    k = len(mass)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (k, 0), (k, 1)
        heapq.heappush(heap, (a[0] + b[0], k, k))
        k += 1
    paths = []
    for i in range(len(mass)):
        path = []
        while i in up:
            i, bit = up[i]
            path.append((i - len(mass), bit))
        paths.append(path[::-1])
    depth = np.array([len(p) for p in paths])
    node, bit = np.zeros((2, len(mass), max(1, depth.max())), np.int64)
    for i, p in enumerate(paths):
        for j, (n, b) in enumerate(p):
            node[i, j], bit[i, j] = n, b
    return depth, node, bit


class Code:
    """Numbers and bits of words. Number 0 is the end, 1 a word not met, then words by class, frequent ones first."""

    def __init__(self, words: np.ndarray, mass: np.ndarray, ends: int):
        """Words and tokens by `class_of_count`, and how many documents end."""
        own = np.flatnonzero(words)[::-1]
        self.classes = own
        self.size = np.concatenate(([1, 1], words[own])).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        tokens = np.concatenate(([max(ends, 0.5), max(int(words[0]), 0.5)], mass[own])).astype(np.float64)
        self.depth, self.node, self.bit = _huffman(tokens.tolist())
        bits = np.ceil(np.log2(self.size)).astype(np.int64)
        least = max(1.0, math.sqrt(tokens.sum()) / SPARE)
        self.held = np.minimum(bits, np.maximum(np.floor(np.log2(np.maximum(tokens / least, 1))), 0).astype(np.int64))
        self.rest = bits - self.held
        self.slot0 = len(self.size) + np.cumsum(1 << self.held) - (1 << self.held)
        self.slots = int(self.slot0[-1] + (1 << self.held[-1]))
        self.group0 = np.cumsum(1 << self.held) - (1 << self.held)
        self.groups = int(self.group0[-1] + (1 << self.held[-1]))
        self.pair_slots = 1 << max(12, math.ceil(math.log2(PAIR_SLOTS * self.slots)))
        # The way to each group: its nodes' slots, twice, plus the bits (none where all words are on one side). How many words it has.
        ways, length, self.words = [], [], np.zeros(self.groups, np.int64)
        for c, d in enumerate(self.held.tolist()):
            i = np.arange(1 << d)
            self.words[self.group0[c] + i] = np.clip(self.size[c] - (i << self.rest[c]), 0, 1 << self.rest[c])
            way = [np.full(1 << d, 2 * n + x) for n, x in zip(self.node[c, : self.depth[c]].tolist(), self.bit[c, : self.depth[c]].tolist(), strict=True)]
            for k in range(d):
                other = ((i >> (d - k)) * 2 + 1) << (self.rest[c] + d - k - 1)
                way.append(np.where(other < self.size[c], 2 * (self.slot0[c] + (1 << k) + (i >> (d - k))) + (i >> (d - k - 1) & 1), -1))
            way = np.column_stack(way)
            ways.append(way[way >= 0])
            length.append((way >= 0).sum(axis=1))
        self.ways, self.length = np.concatenate(ways), np.concatenate(length)
        self.begin = np.cumsum(self.length) - self.length

    def class_of(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, number, side="right") - 1

    def group_of(self, number: np.ndarray) -> np.ndarray:
        c = self.class_of(number)
        return self.group0[c] + ((number - self.first[c]) >> self.rest[c])

    def tables(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones by column and slot, of counts by group and column."""
        zeros, ones = np.zeros((2, counts.shape[1], self.slots), np.float64)
        whole = np.zeros((len(self.size), counts.shape[1]))
        for c, d in enumerate(self.held.tolist()):
            g = counts[self.group0[c] : self.group0[c] + (1 << d)]
            while d:
                d -= 1
                at = self.slot0[c] + (1 << d)
                zeros[:, at : at + (1 << d)], ones[:, at : at + (1 << d)] = g[0::2].T, g[1::2].T
                g = g[0::2] + g[1::2]
            whole[c] = g[0]
        for c, d in enumerate(self.depth.tolist()):
            for node, bit in zip(self.node[c, :d].tolist(), self.bit[c, :d].tolist(), strict=True):
                (ones if bit else zeros)[:, node] += whole[c]
        return zeros, ones


class Words:
    """What is to be told of the words of documents that lie end to end, `size` words each."""

    def __init__(self, code: Code, number: np.ndarray, size: np.ndarray):
        self.code = code
        c = code.class_of(number)
        self.group = code.group0[c] + ((number - code.first[c]) >> code.rest[c])
        before = np.concatenate(([END], number[:-1])) if len(number) else number.copy()
        before[(np.cumsum(size) - size)[size > 0]] = END
        # The whole word before tells of the class, a leading word or its class of the number.
        few = np.where(before < LEADING, before, LEADING + code.class_of(before))
        self.context = mix(before.astype(np.uint64) << np.uint64(1)), mix(few.astype(np.uint64) << np.uint64(1) | np.uint64(1))
        self.again = np.full(len(number), -1, np.int8)  # twice its context, plus the bit
        many = code.words[self.group]
        self.even = -np.log(np.maximum(many, 1))
        own = np.flatnonzero(many > 1)
        key = np.repeat(np.arange(len(size)), size)[own] * code.groups + self.group[own]
        order = np.argsort(key, kind="stable")
        at, same = own[order], np.zeros(len(own), bool)
        same[1:] = key[order][1:] == key[order][:-1]
        now, last = at[same], at[np.flatnonzero(same) - 1]
        hit = number[now] == number[last]
        gap = np.minimum(np.log2(now - last).astype(np.int64), GAPS - 1)
        self.again[now] = 2 * (2 * gap + (before[now] == before[last])) + hit
        self.even[now] = np.where(hit, 0, -np.log(np.maximum(many[now] - 1, 1)))

    def bits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words: how many bits each has; by bit its slot, the bit, and its slot after the word before (from `pair_slots` on: none)."""
        code, group, again = self.code, self.group[at], self.again[at]
        length = code.length[group]
        n = length + (again >= 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        way = code.ways[np.minimum(np.arange(total) + np.repeat(code.begin[group] - (ends - n), n), len(code.ways) - 1)]
        last = ends[again >= 0] - 1
        way[last] = 2 * code.slots + again[again >= 0].astype(np.int64)
        slot, bit = way >> 1, way & 1
        of_class = slot < len(code.size)
        h = np.where(of_class, np.repeat(self.context[0][at], n), np.repeat(self.context[1][at], n))
        h = ((h ^ slot.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - code.pair_slots.bit_length())
        pair = h.astype(np.int64)
        pair[last] = code.pair_slots + 1 + (slot[last] - code.slots)
        return n, slot, bit, pair


def blocks_of(place: np.ndarray) -> np.ndarray:
    """After which words weights and map learn: every 32 of the first 256, then every 128 up to 2048, then every 512."""
    return np.where(place < 256, place // 32, np.where(place < 2048, 6 + place // 128, 18 + place // 512))


def slices(size: np.ndarray, most: int = WINDOW) -> Iterator[np.ndarray]:
    """Documents of like lengths together, about `most` words in each."""
    order = np.argsort(size, kind="stable")
    ends, start = np.cumsum(size[order]), 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        stop = min(stop, start + LANES)
        yield order[start:stop]
        start = stop


def _so_far(key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key has come before each place, and the ones of these."""
    bits = np.uint64(max(1, int(len(key) - 1).bit_length()))
    packed = np.sort(key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64))
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    packed >>= bits
    new = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    size = np.diff(np.append(new, len(key)))
    y = bit[at].astype(np.int32)
    before = np.cumsum(y, dtype=np.int32) - y
    before -= np.repeat(before[new], size)
    rank = np.arange(len(key), dtype=np.int32) - np.repeat(new.astype(np.int32), size)
    ones, all_ = np.empty(len(key), np.float32), np.empty(len(key), np.float32)
    ones[at], all_[at] = before, rank
    return all_, ones


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _toward(total: np.ndarray, ones: np.ndarray, parent: np.ndarray, weight: np.ndarray | float) -> np.ndarray:
    return np.clip((ones + weight * parent) / (total + weight), np.float32(1e-5), np.float32(1 - 1e-5))


def _rows_of(table: np.ndarray) -> np.ndarray:
    """Rows of two or four floats as one value each, which are taken in one go."""
    return np.ascontiguousarray(table, np.float32).view(np.complex64 if table.shape[1] == 2 else np.complex128).ravel()


def _taken(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(rows, at).view(np.float32).reshape(len(at), -1)


class Scorer:
    """What every document is scored by: the code, and counts of the corpus, by kind, and after words."""

    def __init__(self, code: Code, packed: np.ndarray, pairs: np.ndarray, decode: np.ndarray):
        """Packed counts: (1 + kinds) x slots, and by pair slot, then of words that come again; `decode` gives the counts of a byte."""
        self.code, self.packed, self.pairs = code, packed, pairs
        zeros, ones = np.repeat(decode.astype(np.float32), 256), np.tile(decode.astype(np.float32), 256)
        self._decoded = _rows_of(np.column_stack((zeros + ones, ones)))
        self._kinds: dict[int, np.ndarray] = {}

    def _counts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often, and the ones of these."""
        return tuple(_taken(self._decoded, v).T)

    def _reached(self, p: np.ndarray) -> np.ndarray:
        """Probability of each node, of its slots' probabilities of a one."""
        code, out = self.code, np.zeros(len(p), np.float32)
        for c, d in enumerate(code.held.tolist()):
            here = 1.0
            for n, x in zip(code.node[c, : code.depth[c]].tolist(), code.bit[c, : code.depth[c]].tolist(), strict=True):
                out[n] = here
                here *= float(p[n] if x else 1 - p[n])
            level = np.array([here], np.float32)
            for k in range(d):
                at = code.slot0[c] + (1 << k)
                out[at : at + (1 << k)] = level
                q = p[at : at + (1 << k)]
                level = np.column_stack((level * (1 - q), level * q)).ravel()
        return out

    def _kind(self, kind: int) -> np.ndarray:
        """Rows by slot: log odds of the corpus and of the kind, the kind's probability of a one, that of its node."""
        if kind not in self._kinds:
            p = _toward(*self._counts(self.packed[0]), np.float32(0.5), np.float32(0.1))
            q = _toward(*self._counts(self.packed[1 + kind]), p, np.maximum(np.float32(NEAR[0]) * self._reached(p), np.float32(1e-3)))
            again = _toward(*self._counts(self.pairs[self.code.pair_slots + 1 :]), np.float32(0.5), np.float32(1))
            node = np.append(self._reached(q), np.full(AGAIN, 0.1, np.float32))
            p, q = np.append(p, again), np.append(q, again)
            self._kinds[kind] = _rows_of(np.column_stack((_odds(p), _odds(q), q, np.maximum(node, np.float32(1e-5)))))
        return self._kinds[kind]

    def score(self, number: np.ndarray, size: np.ndarray, kind: int) -> np.ndarray:
        """log10 probability of the numbers of documents that lie end to end, of `size` words each."""
        out, begin = np.zeros(len(size)), np.cumsum(size) - size
        words = Words(self.code, number, size)
        for own in slices(size):
            mixer = Online(len(own))
            if len(own) == 1:
                i, carry = int(own[0]), np.zeros(2 * (self.code.slots + AGAIN), np.float32)
                for t in range(0, int(size[i]), WINDOW):
                    place = np.arange(t, min(t + WINDOW, int(size[i])))
                    self._read(mixer, words, begin[i] + place, np.zeros(len(place), np.int64), blocks_of(place), kind, carry)
            else:
                lane = np.repeat(np.arange(len(own)), size[own])
                place = np.arange(len(lane)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
                block = blocks_of(place)
                order = np.argsort(block, kind="stable")
                self._read(mixer, words, (np.repeat(begin[own], size[own]) + place)[order], lane[order], block[order], kind)
            out[own] = mixer.total
        return out / math.log(10)

    def _read(self, mixer: Online, words: Words, at: np.ndarray, lane: np.ndarray, block: np.ndarray, kind: int, carry: np.ndarray | None = None) -> None:
        """Words by block, those of a document in their order; `carry`: what the document has had before, by bit and slot."""
        n, slot, bit, pair = words.bits(at)
        x = _taken(self._kind(kind), slot)
        parent, node = x[:, 2].copy(), x[:, 3].copy()
        x[:, 2] = _odds(_toward(*self._counts(self.pairs[np.minimum(pair, self.code.pair_slots)]), parent, np.float32(NEAR[1]) * node))
        lanes = np.repeat(lane, n)
        total, ones = _so_far(lanes * (self.code.slots + AGAIN) + slot, bit)
        if carry is not None:
            total, ones = total + (carry[2 * slot] + carry[2 * slot + 1]), ones + carry[2 * slot + 1]
            np.add.at(carry, 2 * slot + bit, np.float32(1))
        x[:, 3] = _odds(_toward(total, ones, parent, np.float32(NEAR[2]) * node))
        even = np.bincount(lane, words.even[at], len(mixer.total))
        mixer.read(x, slot >= len(self.code.size), bit, lanes, np.repeat(block, n))
        mixer.total += even


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Online:
    """Weights and map of documents side by side, and the natural logarithms of their probabilities so far."""

    def __init__(self, lanes: int):
        self.weights = np.tile(START, (lanes, 1))
        self.map = np.tile(squash(np.linspace(-8, 8, CELLS)).astype(np.float32), lanes * GATES)
        self.total = np.zeros(lanes)

    def read(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, lane: np.ndarray, block: np.ndarray) -> None:
        """Bits by block; all bits of a block are predicted before weights and map learn from them."""
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(block)), bool), block[1:] != block[:-1])))
        unit_, y_, n = lane * GATES + gate, bit.astype(np.float32), len(self.weights)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            xs, y, unit = x[a:b], y_[a:b], unit_[a:b]
            s = np.einsum("ij,ij->i", xs, _taken(_rows_of(self.weights), unit))
            np.clip(s, -7.999, 7.999, out=s)
            place = (s + 8) * np.float32((CELLS - 1) / 16)
            cell = place.astype(np.int64)
            far = place - cell.astype(np.float32)
            cell += unit * CELLS
            low = self.map[cell]
            mapped = low + (self.map[cell + 1] - low) * far
            p = squash(s)
            whole = np.abs(1 - y - (p + mapped) / 2)
            self.total += np.bincount(lane[a:b], np.log(whole), len(self.total))
            # Many bits of one gate or cell in a block count as 40 of their mean.
            off = y - p
            rate = (RATE / np.maximum(np.bincount(unit, minlength=n) / 40, 1)).astype(np.float32)
            for i in range(xs.shape[1]):
                self.weights[:, i] += rate * np.bincount(unit, off * xs[:, i], n)
            cell += far > 0.5
            met = np.bincount(cell, minlength=len(self.map))
            self.map += np.bincount(cell, y - mapped, len(self.map)) * (MAP_RATE / np.maximum(met / 40, 1))


def count_pairs(code: Code, number: np.ndarray, size: np.ndarray, add: Callable[[np.ndarray], None]) -> None:
    """Calls add(twice the pair slots, plus the bits) for the words of documents."""
    words = Words(code, number, size)
    for t in range(0, len(number), WINDOW):
        _, _, bit, pair = words.bits(np.arange(t, min(t + WINDOW, len(number))))
        add(2 * pair + bit)
