"""Token counts by a compiled finite-state tokenizer.

A byte-fallback BPE vocabulary is turned into a deterministic weighted transducer. Two facts carry it:
a sequence of pieces is the BPE segmentation of its text exactly when every two neighbours are the
segmentation of their concatenation, and then every prefix of the sequence is the segmentation of its own
text. So the last piece of each prefix is unique, and a left-to-right machine that remembers, for every
start from which a vocabulary entry may still be running, the piece that ended there and the count up to
there, is deterministic once counts are taken relative to the present one. Its transitions carry the
change of the token count. States and transitions are compiled when first met, into sorted tables.

No piece holds a blank after a non-blank, so there the machine is back in its start state: a text is a row of
chunks whose maps (count, end state) begin there. The different chunks of a slice of texts run through the
transition tables side by side, a character at a time; a prefix sum over all chunks composes their maps, and its
values at the texts' ends give their counts. Long chunks are cut into pieces, whose maps form a small monoid
(head, count behind it, end state) and are composed pairwise.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, hashed_spans, table

BLANK = "▁"
SLICE = 4 << 20
"""Bytes of texts whose chunks run side by side."""
SIDE_BY_SIDE = 64
"""Chunks of more characters run one by one."""
KEPT_STEPS = 600_000
"""So many transitions are kept in a worker."""
CHUNK_CHARS = 1 << 14


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        odd = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(size) if i not in set(odd)}
        if not any(model.is_byte(i) for i in range(size)):
            raise ValueError("a model with byte fallback is needed")
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("pieces with inner blanks are not provided for")
        self.starts = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.joined = {c for p in self.score if len(p) > 1 for c in p}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()
        if wrong := [t for t in _PROBES if self.tokens(t) != len(model.encode(t))]:
            raise ValueError(f"the model's normalisation or its own pieces are not provided for: {wrong}")

    def reset(self) -> None:
        self.states: list[tuple] = [(("", "", 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.keys, self.to, self.gain = np.full(1, -1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def settle(self) -> None:
        """Puts the transitions compiled so far into the sorted tables (key: state and character)."""
        if len(self.steps) > KEPT_STEPS:
            self.reset()
        if len(self.steps) >= len(self.keys):
            keys = np.fromiter(((s << 21) | ord(c) for s, c in self.steps), np.int64, len(self.steps))
            both = np.array(list(self.steps.values()), np.int64)
            order = np.argsort(keys)
            self.keys, self.to, self.gain = (np.append(x, y) for x, y in ((-1, keys[order]), (0, both[order, 0]), (0, both[order, 1])))

    def segment(self, text: str) -> list[str]:
        """BPE as the library defines it: join the best-scored neighbours, leftmost first."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        score, queue = self.score, []
        for i in range(len(parts) - 1):
            if (s := score.get(parts[i] + parts[i + 1])) is not None:
                queue.append((-s, i, parts[i], parts[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := score.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(queue, (-s, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def follows(self, a: str, b: str) -> bool:
        """Whether b may stand right after a; a is empty at the start."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[a, b] = self.segment(a + b) == ([a, b] if a else [b])
            if len(self.pairs) > KEPT_STEPS:
                self.pairs.clear()
        return known

    def weight(self, piece: str) -> int:
        return 1 if piece in self.score else len(piece.encode("utf-8", "surrogatepass"))

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition from a state on a character: next state, change of the count."""
        running, ended = [], None
        for last, part, n in self.states[state]:
            word = part + c
            if word in self.starts or not part:
                if (word in self.score or not part) and self.follows(last, word):
                    ended = (word, n + self.weight(word))
                if word in self.starts:
                    running.append((last, word, n))
        piece, n = ended
        key = tuple(sorted((a, b, k - n) for a, b, k in running)) + ((piece, "", 0),)
        to = self.ids.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        self.steps[state, c] = (to, n)
        return to, n

    def run(self, state: int, text: str) -> tuple[int, int]:
        total, steps = 0, self.steps
        for c in text:
            state, n = steps.get((state, c)) or self.compile(state, c)
            total += n
        return state, total

    def run_all(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of chunks of code points, from the start state, all of them a character further at each step."""
        order = np.argsort(-size, kind="stable")
        begin, n = start[order], size[order]
        state, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for t, k in enumerate(np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left").tolist()):
            key = state[:k] << 21 | code[begin[:k] + t]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to, gain = self.to[at], self.gain[at]
            if len(new := np.flatnonzero(self.keys[at] != key)):
                met, back = np.unique(key[new], return_inverse=True)
                found = np.array([self.steps.get((s, c)) or self.compile(s, c) for s, c in ((x >> 21, chr(x & 0x1FFFFF)) for x in met.tolist())], np.int64)
                to[new], gain[new] = found[back, 0], found[back, 1]
            state[:k] = to
            total[:k] += gain
        out = np.empty(len(n), np.int64)
        out[order] = total
        return out

    def count_rows(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pieces of whole texts (UTF-8 end to end, offsets); a very long one goes in stretches."""
        if len(at) == 2 and len(data) > 2 * SLICE:
            edges = [0, *_stretches(data, SLICE), len(data)]
            return np.array([sum(int(self._count(data[a:b], np.array([0, b - a]), not a)[0]) for a, b in zip(edges, edges[1:], strict=False))])
        return self._count(data, at, True)

    def _count(self, data: np.ndarray, at: np.ndarray, leading: bool) -> np.ndarray:
        """leading: texts get the model's leading blank; else they begin with a blank where the machine starts anew."""
        some = np.diff(at) > 0
        row = np.flatnonzero(some)
        if not len(row):
            return np.zeros(len(at) - 1, np.int64)
        text = np.insert(data, at[:-1][some], 32) if leading else data
        first = at[:-1][some] + (np.arange(len(row)) if leading else 0)
        blank = text == 32
        after = np.concatenate(([True], blank[:-1]))
        cut = blank & ~after
        for p in np.flatnonzero(cut & (np.concatenate(([0], text[:-1])) == _MARK[2])).tolist():
            cut[p] = not (text[max(p - 3, 0) : p].tobytes() == _MARK)  # a blank mark in the text itself is a blank before
        if "\n" not in self.joined:
            line = text == 10
            cut |= line
            cut[1:] |= line[:-1]
        cut[first] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(text))
        _, one, back = np.unique(hashed_spans(text, start, end), return_index=True, return_inverse=True)
        chunk = b"".join(memoryview(text)[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True))
        width = end[one] - start[one]
        lead = (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80
        size = np.add.reduceat(lead, np.cumsum(width) - width).astype(np.int64)
        code = np.frombuffer(chunk.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 32] = ord(BLANK)
        place = np.cumsum(size) - size
        counts = np.empty(len(one), np.int64)
        short = size <= SIDE_BY_SIDE
        self.settle()
        counts[short] = self.run_all(code, place[short], size[short])
        for i in np.flatnonzero(~short).tolist():
            word = code[place[i] : place[i] + size[i]].astype(np.uint32).tobytes().decode("utf-32-le")
            counts[i] = self.scan([word[k : k + CHUNK_CHARS] for k in range(0, len(word), CHUNK_CHARS)])
        upto = np.concatenate(([0], np.cumsum(counts[back])))
        bounds = np.append(np.searchsorted(start, first), len(start))
        out = np.zeros(len(at) - 1, np.int64)
        out[row] = upto[bounds[1:]] - upto[bounds[:-1]]
        return out

    # A chunk's map is (head, None, None) if no reset lies in it, else (head, count after the head, end state).

    def cut(self, text: str) -> tuple:
        """The map of a chunk of blank-marked text."""
        marks = [m.start() for m in _RESET.finditer(text)]
        if not marks:
            return (text, None, None)
        count, state = 0, 0
        for a, b in zip(marks, [*marks[1:], len(text)], strict=True):
            state, n = self.run(0, text[a:b])
            count += n
        return (text[: marks[0]], count, state)

    def compose(self, x: tuple, y: tuple) -> tuple:
        if x[1] is None:
            return (x[0] + y[0], y[1], y[2])
        state, n = self.run(x[2], y[0])
        return (x[0], x[1] + n, state) if y[1] is None else (x[0], x[1] + n + y[1], y[2])

    def scan(self, parts: list[str]) -> int:
        """Tokens of the parts put together: their maps are composed pairwise, as a prefix scan's up-sweep does."""
        maps = [self.cut(p) for p in parts]
        maps[0] = self.compose(("", 0, 0), maps[0])
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1]

    def tokens(self, text: str) -> int:
        """Pieces of a whole text, with the model's leading blank."""
        data = np.frombuffer(text.encode(), np.uint8)
        return int(self.count_rows(data, np.array([0, len(data)]))[0])


#: Where a chunk surely starts anew: a blank after a non-blank.
_RESET = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def _stretches(data: np.ndarray, size: int) -> Iterator[int]:
    """Places about `size` bytes apart at which a blank surely starts a chunk."""
    p = size
    while p < len(data):
        window = data[p - 1 : p + size]
        found = np.flatnonzero((window[1:] == 32) & (window[:-1] != 32) & (window[:-1] != _MARK[2]))
        if len(found):
            yield p + int(found[0])
            p += int(found[0])
        p += size


_MARK = BLANK.encode()
#: Texts on which a model that normalises, or holds pieces of its own making, would differ.
_PROBES = ("ﬁne Ａ e\u0301 ①", " two  blanks ", "tab\tand\r\nline\n\n", "▁mark ▁ x", "日本語 😀 naïve", "\x00\x07", "\u3000\u00a0wide", "<s> </s> <unk> <pad> <0x0A> <|endoftext|>")


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, whole; null and empty texts count 0 tokens.

    Very long texts are a slice of their own; rows that repeat stay; `limit` tokens are not over it; an empty table gives no
    rows; further columns are not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_path)
        for b, data, at in chunks(batches, "text", SLICE):
            n = m.count_rows(data, at)
            yield batch_of(doc_id=b.column(0), n_bytes=np.diff(at), n_tokens=n, over_limit=n > limit)

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
