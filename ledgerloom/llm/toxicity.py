"""Toxicity: a linear-chain conditional random field over words tags toxic spans.

Labels are by document, so the labelled tokens that the field is trained on come from them: on a bounded
sample of labelled documents, words are picked one after another that best tell the toxic documents not
yet explained from the clean ones (log-likelihood ratio), and their occurrences in toxic documents are the
positive tokens. The field (states other, toxic; hashed features of the word, its prefix, suffix and shape, of
the words before and behind it, and a transition matrix) is trained by gradient ascent on the forward-backward marginals. Scoring runs
forward-backward over every whole text; marginals above one half form spans with character offsets, and a
logistic function of the marginals' noisy-or, maximum and expected count gives the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, fold, table, text_pieces, texts

SAMPLE = 1500
"""At most so many documents of each class (those with the smallest hashes of id and text) train the model."""
SAMPLE_BYTES = 6 << 20
"""The sample's documents of a class have at most so many bytes together; one that no longer fits is passed over."""
BUCKETS = 1 << 18
WINDOW = 64
KEPT_WORDS = 300_000
CHUNK = 8 << 20
BLOCK = 1 << 16
FEW = 4
"""So few documents that are still running are followed one by one."""
LEAST_GAIN = 12.0
EXPLAINED = 0.5

_WORD = re.compile(r"\w+")
_OTHER = re.compile(r"\W")


def lowered(text: str) -> str:
    """Lower case in which every character stays in its place (the few that would become several stay as they are)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _hashed(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace"))


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself, prefix, suffix, shape; then as the word before and as the word behind another."""
    shape = f"{min(len(word), 12)}{word.isascii():d}{word.isalpha():d}{word.isdigit():d}"
    return [_hashed(x) % BUCKETS for x in ("w" + word, "p" + word[:4], "s" + word[-4:], "h" + shape, "b" + word, "a" + word)]


OWN = 4
"""So many of a word's features are its own; one each is its neighbours'."""


def in_context(own: np.ndarray, before: np.ndarray, behind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of words from their own part and their neighbours'; a row's ends have no neighbour beyond."""
    out = own.astype(np.float64)
    if len(out) > 1:
        inner = np.ones(len(out), bool)  # has a word before it in its row
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        inner[starts] = False
        inner = inner[1:]
        out[1:] += np.where(inner, before[:-1], 0)
        out[:-1] += np.where(inner, behind[1:], 0)
    return out


def _weights(docs: list[set[int]], hashes: list[int]) -> list[float]:
    """One over the number of documents with the same smallest word hash: copies count as about one document."""
    family = [min((hashes[w] for w in d), default=0) for d in docs]
    size = Counter(family)
    return [1 / size[f] for f in family]


def toxic_words(toxic: list[set[int]], clean: list[set[int]], names: list[str]) -> list[int]:
    """Words (numbers of names) picked greedily: each has the largest likelihood-ratio gain of toxic over clean documents.

    Copies count once; a document that an earlier word explains counts EXPLAINED times as much. Sums are kept and
    changed by the documents that a picked word explains.
    """

    def tally(docs: list[set[int]], weights: list[float]) -> np.ndarray:
        out = np.zeros(len(names))
        for d, w in zip(docs, weights, strict=True):
            out[list(d)] += w
        return out

    def gains(a: np.ndarray, n1: float, b: np.ndarray, n0: float) -> np.ndarray:
        p = (a + b) / (n1 + n0)

        def part(k: np.ndarray, n: float) -> np.ndarray:
            r = np.clip(k / n, 0, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(k > 0, k * np.log(r / p), 0.0) + np.where(r < 1, (n - k) * np.log((1 - r) / (1 - p)), 0.0)

        return np.where((a >= 2) & (a / n1 > 3 * (b + 0.5) / n0), 2 * (part(a, n1) + part(b, n0)), 0.0)

    if not toxic or not clean:
        return []
    hashes = [_hashed(w) for w in names]
    light = _weights(clean, hashes)
    in_clean, n0 = tally(clean, light), sum(light)
    weights, out = _weights(toxic, hashes), []
    found = tally(toxic, weights)
    by_name = np.argsort(np.argsort(names)) if names else np.zeros(0)
    while True:
        gain = gains(found, sum(weights), in_clean, n0)
        gain[out] = 0.0
        best = max(np.flatnonzero(gain == gain.max()).tolist(), key=lambda w: by_name[w]) if len(gain) else 0
        if not len(gain) or gain[best] < LEAST_GAIN:
            return out
        out.append(best)
        for i, d in enumerate(toxic):
            if best in d:
                found[list(d)] -= weights[i] * (1 - EXPLAINED)
                weights[i] *= EXPLAINED


def forward_backward(e: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of equal length: P(toxic) by position, expected transitions (2 x 2), log partition by row.

    e: score of toxic over other by position (NaN-free, rows x length); transition: log potentials."""
    a = np.exp(transition)
    s, n = e.shape
    x = np.exp(np.clip(e, -30, 30))
    alpha, scale = np.empty((n, 2, s)), np.empty((n, s))
    beta = np.ones((n, 2, s))
    now = np.stack((np.ones(s), x[:, 0]))
    for t in range(n):
        if t:
            now = np.stack((alpha[t - 1, 0] * a[0, 0] + alpha[t - 1, 1] * a[1, 0], (alpha[t - 1, 0] * a[0, 1] + alpha[t - 1, 1] * a[1, 1]) * x[:, t]))
        scale[t] = now.sum(axis=0)
        alpha[t] = now / scale[t]
    pairs = np.zeros((2, 2))
    for t in range(n - 2, -1, -1):
        own = np.stack((beta[t + 1, 0], beta[t + 1, 1] * x[:, t + 1])) / scale[t + 1]
        beta[t, 0] = a[0, 0] * own[0] + a[0, 1] * own[1]
        beta[t, 1] = a[1, 0] * own[0] + a[1, 1] * own[1]
        pairs += np.einsum("is,ij,js->ij", alpha[t], a, own)
    return (alpha[:, 1] * beta[:, 1]).T, pairs, np.log(scale).sum(axis=0)


class Field:
    def __init__(self):
        self.weights = np.zeros(BUCKETS, np.float32)
        self.bias, self.transition = -6.0, np.zeros((2, 2))
        self.calibration = np.array([0.0, 0.0, 0.0, 0.0])
        self.prior = 0.5
        self.trained = False

    def parts(self, word: str) -> tuple[float, float, float]:
        """A word's own score, and what it adds to the word behind it and to the one before it."""
        f = word_features(word)
        return self.bias + float(self.weights[f[:OWN]].sum()), float(self.weights[f[OWN]]), float(self.weights[f[OWN + 1]])

    def train(self, docs: list[np.ndarray], tags: list[np.ndarray], names: list[str], steps: int = 60) -> None:
        """Adam on the conditional log likelihood of windows of WINDOW words (the last of a document is filled up with neutral
        words). Documents are word numbers; `none` stands where a document has no neighbour."""
        none = len(names)
        rows, gold, real, before, behind = [], [], [], [], []
        for k, t in zip(docs, tags, strict=True):
            last, next_ = np.append(none, k[:-1]), np.append(k[1:], none)
            for i in range(0, len(k), WINDOW):
                n = min(WINDOW, len(k) - i)
                fill = lambda x, v=0, i=i, n=n: np.pad(x[i : i + n], (0, WINDOW - n), constant_values=v)
                rows.append(fill(k))
                gold.append(fill(t))
                real.append(np.pad(np.ones(n), (0, WINDOW - n)))
                before.append(fill(last, none))
                behind.append(fill(next_, none))
        rows, gold, real, before, behind = np.array(rows), np.array(gold, float), np.array(real), np.array(before), np.array(behind)
        features = np.array([word_features(w) for w in names])
        seen = np.bincount(rows.ravel(), real.ravel(), len(names))
        gold_pairs = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                gold_pairs[i, j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j)).sum()
        w = np.zeros(BUCKETS)
        m, v = np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)
        scale = max(gold.sum(), 1.0)
        for step in range(1, steps + 1):
            by_word = self.bias + w[features[:, :OWN]].sum(axis=1)
            e = by_word[rows] + np.append(w[features[:, OWN]], 0)[before] + np.append(w[features[:, OWN + 1]], 0)[behind]
            p, pairs, _ = forward_backward(np.where(real > 0, e, self.bias), self.transition)
            off = (gold - p) * real
            g = np.zeros(BUCKETS + 5)
            for k, ids in enumerate((*[rows] * OWN, before, behind)):
                if k == 0 or k >= OWN:
                    by = np.bincount(ids.ravel(), off.ravel(), none + 1)[:none]
                g[:BUCKETS] += np.bincount(features[:, k], by, BUCKETS)
            g[:BUCKETS] -= 0.05 * w
            g[BUCKETS] = off.sum()
            g[BUCKETS + 1 :] = (gold_pairs - pairs).ravel() - 0.5 * self.transition.ravel()
            g /= scale
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            up = 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w += up[:BUCKETS]
            self.bias += up[BUCKETS]
            self.transition = self.transition + up[BUCKETS + 1 :].reshape(2, 2)
        self.weights, self.trained = w.astype(np.float32), seen.sum() > 0

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(toxic) of every word of ragged rows, in place order. Rows advance side by side, longest first."""
        a = np.exp(self.transition)
        order = np.argsort(-sizes, kind="stable")
        n = sizes[order]
        start = (np.cumsum(sizes) - sizes)[order]
        most = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(most), side="left").tolist()
        x = np.exp(np.clip(e, -30, 30))
        p = np.empty_like(x)  # first P(toxic | words so far), then the marginal
        one = np.zeros(len(n))
        tail = most  # from this place on documents are followed one by one
        for t, k in enumerate(live):
            if k <= FEW:
                tail = t
                break
            at = start[:k] + t
            if t:
                q = one[:k]
                u, o = (q * a[1, 1] + (1 - q) * a[0, 1]) * x[at], q * a[1, 0] + (1 - q) * a[0, 0]
            else:
                u, o = x[at], 1.0
            one[:k] = u / (u + o)
            p[at] = one[:k]
        ratio = np.ones(len(n))  # beta(toxic) / beta(other)
        for i in range(live[tail] if tail < most else 0):
            own = slice(start[i] + tail, start[i] + n[i])
            p[own], ratio[i] = self._alone(x[own], float(one[i]) if tail else None)
        for t in range(tail - 1, -1, -1):
            k = live[t]
            at = start[:k] + t
            if t + 1 < tail and (j := live[t + 1]):
                own = ratio[:j] * x[start[:j] + t + 1]
                ratio[:j] = (a[1, 0] + a[1, 1] * own) / (a[0, 0] + a[0, 1] * own)
            q = p[at] * ratio[:k]
            p[at] = q / (q + 1 - p[at])
        return p

    def _alone(self, x: np.ndarray, q: float | None) -> tuple[np.ndarray, float]:
        """The rest of one document: its marginals, and beta(toxic) / beta(other) of the word before it. q: P(toxic) of that word so far."""
        (oo, ot), (to, tt) = np.exp(self.transition).tolist()
        out = np.empty(len(x))
        for i in range(0, len(x), BLOCK):
            kept = []
            for v in x[i : i + BLOCK].tolist():
                u, o = (v, 1.0) if q is None else ((q * tt + (1 - q) * ot) * v, q * to + (1 - q) * oo)
                q = u / (u + o)
                kept.append(q)
            out[i : i + BLOCK] = kept
        ratio = 1.0
        for i in range((len(x) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            kept = []
            for v, f in zip(x[i : i + BLOCK].tolist()[::-1], out[i : i + BLOCK].tolist()[::-1], strict=True):
                s = f * ratio
                kept.append(s / (s + 1 - f))
                ratio = (to + tt * ratio * v) / (oo + ot * ratio * v)
            out[i : i + BLOCK] = kept[::-1]
        return out, ratio

    def summary(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By row: log odds of the noisy-or, of the largest marginal, log expected count."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        none = -np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), len(sizes))
        most = np.zeros(len(sizes))
        if some := (sizes > 0).sum():
            most[sizes > 0] = np.maximum.reduceat(p, (np.cumsum(sizes) - sizes)[sizes > 0])[:some]
        odds = np.log(np.expm1(np.clip(none, 1e-9, 30)))
        return np.column_stack((np.clip(odds, -12, 12), np.clip(np.log((most + 1e-6) / (1 - most + 1e-6)), -12, 12), np.log1p(np.bincount(row, p, len(sizes)))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps; weights undo the sample's class balance."""
        x = np.column_stack((x, np.ones(len(x))))
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
            w += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.3 * w), -2, 2)
        self.calibration = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ self.calibration, -30, 30)))


class _Emissions(dict):
    """Numbers of words, and a table of their scores."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.table = field, np.zeros((1 << 12, 3), np.float32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[n] = self.field.parts(word)
        self[word] = n
        return n

    def scores(self, text: str) -> np.ndarray:
        """Words x parts of a lower-cased text, which is read in pieces."""
        out = []
        for piece in text_pieces(text, _OTHER):
            if len(self) > KEPT_WORDS:
                self.clear()
            ids = [self[w] for w in _WORD.findall(piece)]
            out.append(self.table[ids] if ids else np.zeros((0, 3), np.float32))
        return out[0] if len(out) == 1 else np.concatenate(out)


def _sample(docs: DataFrame, own: DataFrame, label: int) -> list[str]:
    """Texts of at most SAMPLE labelled documents, of SAMPLE_BYTES together, in the order of a hash of their ids."""
    order = F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id"
    ids = [r[0] for r in own.where(F.col("label") == label).orderBy(*order).select("doc_id").limit(2 * SAMPLE).collect()]
    if not ids:
        return []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).withColumn("n", F.octet_length("text"))
    # Sizes first, so that no more texts move than the sample has.
    left, taken = SAMPLE_BYTES, []
    for doc_id, n in sized.orderBy(*order, "n").select("doc_id", "n").limit(SAMPLE).collect():
        if n <= left:
            left -= n
            taken.append((doc_id, n))
    if not taken:
        return []
    keys = F.broadcast(docs.sparkSession.createDataFrame(list(dict.fromkeys(taken)), "doc_id long, n int"))
    return sized.join(keys, ["doc_id", "n"]).orderBy(*order, "text").select("text").limit(len(taken)).toArrow().column("text").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Field:
    """Trains on a bounded sample of labelled rows: SAMPLE of each class and SAMPLE_BYTES of their texts at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("doc_id", folds) != held))
    totals = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    field = Field()
    n = totals.get(0, 0), totals.get(1, 0)
    field.prior = (n[1] + 1) / (sum(n) + 2)
    rows = [(label, t) for label in (0, 1) for t in _sample(docs, own, label)]
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return field
    ids: dict[str, int] = {}
    found = [np.array([ids.setdefault(w, len(ids)) for w in _WORD.findall(lowered(t))], np.int64) for _, t in rows]
    names, sets = list(ids), [set(d.tolist()) for d in found]
    marked = np.zeros(len(names), bool)
    marked[toxic_words([s for s, k in zip(sets, y, strict=True) if k], [s for s, k in zip(sets, y, strict=True) if not k], names)] = True
    tags = [(marked[d] & bool(k)).astype(np.int64) for d, k in zip(found, y, strict=True)]
    if not any(t.any() for t in tags):
        return field
    field.train(found, tags, names)
    parts = np.array([field.parts(w) for w in names])[np.concatenate(found)]
    sizes = np.array([len(d) for d in found])
    counts = np.bincount(y)
    field.calibrate(field.summary(field.marginals(in_context(*parts.T, sizes), sizes), sizes), y, (np.array(n) / sum(n) * len(y) / counts)[y])
    return field


def toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted, spans of every row; a span has start, end (characters) and its largest marginal.

    Null and empty texts and texts without words have no spans and the score of no toxic word. Very long texts are
    read in pieces that end between words, and followed word by word. Rows that repeat stay and score alike; a score
    of 0.5 is predicted 1; an empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # 1 MB of weights, whatever the input
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Emissions(model)
        for batch, _, _ in chunks(batches, "text", CHUNK):
            rows = texts(batch.column(1))
            found = [known.scores(lowered(t)) for t in rows]
            sizes = np.array([len(f) for f in found], np.int64)
            e = in_context(*np.concatenate(found).T, sizes)
            p = model.marginals(e, sizes) if model.trained else np.zeros(len(e))
            s = model.scores(model.summary(p, sizes))
            ends = np.cumsum(sizes)
            hot = np.unique(np.searchsorted(ends, np.flatnonzero(p > 0.5), side="right"))
            spans: list[list] = [[] for _ in rows]
            for i in hot.tolist():
                q = p[ends[i] - sizes[i] : ends[i]]
                open_ = None
                for m, v in zip(_WORD.finditer(lowered(rows[i])), q, strict=True):
                    if v > 0.5:
                        open_ = {"start": open_["start"], "end": m.end(), "p": max(open_["p"], float(v))} if open_ else {"start": m.start(), "end": m.end(), "p": float(v)}
                    elif open_:
                        spans[i].append(open_)
                        open_ = None
                if open_:
                    spans[i].append(open_)
            yield batch_of(doc_id=batch.column(0), score=s, predicted=(s >= 0.5).astype(np.int32), spans=pa.array(spans, span))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
