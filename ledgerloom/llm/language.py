"""Language identification by n-gram filters that hold a bitmask of languages.

Learning counts the letter n-grams of all training texts by language. An n-gram belongs to a language if
it makes up at least RARE of that language's n-grams, so a language has at most 1 / RARE of them, whatever
the corpus. They go into one bit-sliced Bloom filter: every slot is a mask with one bit a language, an
insertion sets the language's bit in HASHES slots, and a look-up ANDs the slots' masks, which gives all
languages that hold the n-gram at once. A text's evidence for a language is the number of its n-grams whose
mask has the bit, less the share that the filter's false positives explain; the evidence is weighed by how
often the language's own training texts find theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_of, fold, mix, table, text_pieces, texts

SIZES = (2, 3, 4)
HASHES = 3
SLOTS = 1 << 20
RARE = 2e-5
"""Least share of an n-gram in its language."""
UNKNOWN = "und"
CHUNK_CHARS = 1 << 20

_SPACE = re.compile(r"\s")
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 if it is no letter."""
    global _LETTER
    if _LETTER is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTER = out
    return _LETTER


def _points(text: str) -> np.ndarray:
    return _letters()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10FFFF)]


def _keys(c: np.ndarray, row: np.ndarray | None = None, new: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By size: keys of the n-grams of letters (0: a boundary), and where they start. None crosses rows; at most one place
    is a boundary; of the n-grams only those that end at `new` or later."""
    c = c.astype(np.uint64)
    letter = (c > 0).view(np.int8)
    key, inside, start = c.copy(), letter, np.arange(len(c))
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):  # a longer n-gram's key comes from that of its first letters
            m = len(c) - n + 1
            if m <= 0:
                return
            key = key[:m] * np.uint64(0x1F1F3) + c[n - 1 :]
            inside = inside[:m] + letter[n - 1 :]
            if n not in SIZES:
                continue
            ok = inside >= n - 1
            if row is not None:
                ok &= row[:m] == row[n - 1 :]
            if new >= n:
                ok[: new - n + 1] = False
            yield (key[ok] + np.uint64(n * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15), start[:m][ok]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of the letter n-grams of texts (a boundary of words, begin and end count as a letter), the text each is from, letters by text."""
    c = _points("".join(f"\n{t}\n" for t in parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    row = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    letters = np.bincount(row, c > 0, len(parts)).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0) | (row[1:] != row[:-1])  # runs of other characters count as one boundary
    c, row = c[keep], row[keep]
    found = list(_keys(c, row))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    return np.concatenate([k for k, _ in found]), np.concatenate([row[at] for _, at in found]), letters


def long_grams(text: str, size: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """The same keys of one text, and its letters, piece by piece; the last letters of a piece are carried to the next."""
    size = size or CHUNK_CHARS
    carried, before = np.zeros(0, np.uint32), 1
    for i in range(0, len(text), size):
        c = _points(("" if i else "\n") + text[i : i + size] + ("" if i + size < len(text) else "\n"))
        keep = (c > 0) | (np.concatenate(([before], c[:-1])) > 0)
        before = c[-1]
        letters, c = int((c > 0).sum()), c[keep]
        whole = np.concatenate((carried, c))
        found = [k for k, _ in _keys(whole, None, len(carried))]
        carried = whole[-(max(SIZES) - 1) :]
        yield np.concatenate(found) if found else np.zeros(0, np.uint64), letters


def _groups(parts: list[str]) -> Iterator[slice]:
    """Runs of texts with a bounded number of characters; a longer text is one of its own."""
    start, size = 0, 0
    for i, t in enumerate(parts):
        if size and size + len(t) > CHUNK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(parts):
        yield slice(start, len(parts))


def _is_long(parts: list[str]) -> bool:
    return len(parts) == 1 and len(parts[0]) > 2 * CHUNK_CHARS


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, np.concatenate(n), len(u))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text). Tasks count distinct words first, then the n-grams of those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in seen.items():
                names, times = list(found), np.fromiter(found.values(), np.int64, len(found))
                keys, n = [], []
                for s in _groups(names):
                    some = ((k, None) for k, _ in long_grams(names[s.start])) if _is_long(names[s]) else (grams(names[s])[:2],)
                    for key, row in some:
                        u, back = np.unique(key, return_inverse=True)
                        keys.append(u)
                        n.append(np.bincount(back, times[s][row if row is not None else np.zeros(len(key), np.int64)], len(u)))
                    if len(keys) > 64:
                        keys, n = ([x] for x in _added(keys, n))
                if keys:
                    u, n = _added(keys, n)
                    yield batch_of(lang=pa.array([lang] * len(u), pa.string()), gram=u.view(np.int64), n=n.astype(np.int64))
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for piece in text_pieces(text, _SPACE):
                    seen.setdefault(lang, Counter()).update(piece.split())
                    if len(text) > len(piece) and len(seen[lang]) > 500_000:
                        yield from out()
            if sum(map(len, seen.values())) > 500_000:
                yield from out()
        yield from out()

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


class Filter:
    """The bit-sliced filter: masks of eight languages each by slot, as many as the languages ask for."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        """slots: a power of two."""
        self.languages, self.masks = languages, np.zeros((max(1, -(-len(languages) // 8)), slots), np.uint8)
        self.found = np.ones(len(languages))  # share of a language's own n-grams that it holds
        self.false = np.zeros(len(languages))

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys)
        most = np.uint64(self.masks.shape[1] - 1)
        with np.errstate(over="ignore"):
            step = (h >> np.uint64(40)) * np.uint64(2) + np.uint64(1)
            for k in range(HASHES):
                yield ((h + np.uint64(k) * step) & most).view(np.int64)

    def add(self, language: int, keys: np.ndarray) -> None:
        for p in self.places(keys):
            self.masks[language // 8, p] |= np.uint8(1 << language % 8)

    def masks_of(self, keys: np.ndarray) -> np.ndarray:
        """The languages that hold each key, eight to a row."""
        out = None
        for p in self.places(keys):
            found = self.masks[:, p]
            out = found if out is None else out & found
        return out

    def holds(self, masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[language // 8] >> np.uint8(language % 8)) & np.uint8(1)

    def settle(self) -> None:
        """A key that no language holds hits a bit with the power of that bit's share of the slots."""
        for i in range(len(self.languages)):
            self.false[i] = self.holds(self.masks, i).mean() ** HASHES

    def hits(self, keys: np.ndarray, row: np.ndarray, many: int) -> np.ndarray:
        """By text: its n-grams, and by language how many of them the language holds (texts are counted by mask first)."""
        place = row.astype(np.int64) << 8
        counts = [np.bincount(place + m, minlength=many * 256).reshape(many, 256) for m in self.masks_of(keys)]
        return np.column_stack((counts[0].sum(axis=1), *(c @ _BITS for c in counts)))[:, : len(self.languages) + 1]

    def decide(self, parts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of texts. No letter: `und`, score 0; no n-gram that any language holds: the first language, 1 / languages."""
        if _is_long(parts):
            found, letters = np.zeros((1, len(self.languages) + 1)), np.zeros(1, np.int64)
            for keys, n in long_grams(parts[0]):
                found += self.hits(keys, np.zeros(len(keys), np.int64), 1)
                letters += n
        else:
            keys, row, letters = grams(parts)
            found = self.hits(keys, row, len(parts))
        total = np.maximum(found[:, 0], 1)
        share = np.empty((len(parts), len(self.languages)))
        for i in range(len(self.languages)):
            true = np.maximum((found[:, i + 1] / total - self.false[i]) / (1 - self.false[i] + 1e-9), 0.0)
            share[:, i] = true / max(self.found[i], 1e-9)
        strength = np.exp(np.minimum(share, 4) * np.log1p(total)[:, None] * 4)
        p = strength / strength.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters > 0, p[np.arange(len(parts)), best], 0.0)


def fit(docs: DataFrame) -> Filter | None:
    """From rows (lang, text) with a language. What reaches the driver is bounded by 1 / RARE n-grams a language and size."""
    counts = Scratch(docs.sparkSession, "language").keep(gram_counts(docs))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    if not totals:
        return None
    out = Filter(sorted(totals))
    least = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(max(1.0, RARE * v)))])
    rows = counts.where(F.col("n") >= least[F.col("lang")]).toArrow()
    lang, gram, n = rows.column("lang").to_pandas(), rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    for i, name in enumerate(out.languages):
        own = (lang == name).to_numpy()
        out.add(i, gram[own].view(np.uint64))
        out.found[i] = n[own].sum() / totals[name]
    out.settle()
    return out


def languages(docs: DataFrame, model: Filter | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` and 0 for null texts, texts without letters, and where nothing was learned.

    Very long texts are read piece by piece, to the same hits. Languages that tie: the first by name. Rows that
    repeat stay; an empty table gives no rows; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS masks, whatever the input

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = texts(batch.column(1))
            for s in _groups(rows):
                part = rows[s]
                names, score = m.decide(part) if m else ([UNKNOWN] * len(part), np.zeros(len(part)))
                yield batch_of(doc_id=batch.column(0).slice(s.start, len(part)), lang_pred=pa.array(names, pa.string()), score=score)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(decide, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1)))
    out = languages(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
