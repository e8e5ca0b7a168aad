"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts turns each into a fixed vector of transformed statistics (logs of counts, logits
of shares). The class means and covariances are sums over all labelled rows, added up on the executors
and by Spark; a few hundred numbers reach the driver, whatever the input. Each class covariance is
shrunk towards the pooled one and that towards a scaled identity. Scores are differences of Mahalanobis
log densities through Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_of, chunks, fold, hashed_spans, hashes_of, joined_sum, prefix_hashes, span_sums, table, words

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "letters", "digits", "marks", "stops", "blanks", "capitals",
    "distinct_words", "log_lines", "repeated_lines", "entropy", "short_words", "long_words", "single_words", "marked_words",
)

_KIND = np.full(256, 2, np.int64)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[48:58] = 1
_KIND[65:91] = 4
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[[33, 44, 46, 58, 59, 63]] = 5  # stops
_KINDS = np.zeros((256, 6))
_KINDS[np.arange(256), _KIND] = 1
_IS_MARK = (_KIND == 2).astype(np.uint8)
PART = 4 << 20


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, pulled in by half a count."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes by row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows)


def _assemble(n, hist, count, total, squares, distinct, marked, lines, unlike, short, far, single) -> np.ndarray:
    """Rows x FEATURES from sums by row."""
    kinds = hist @ _KINDS
    share = hist / np.maximum(n, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    some = np.maximum(count, 1)
    mean = total / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    return np.column_stack((
        np.log1p(n), np.log1p(count), np.log1p(mean), np.log1p(spread), _logit(kinds[:, 0] + kinds[:, 4], n), _logit(kinds[:, 1], n), _logit(kinds[:, 2], n), _logit(kinds[:, 5], n), _logit(kinds[:, 3], n), _logit(kinds[:, 4], n),
        _logit(distinct, count), np.log1p(lines), _logit(lines - unlike, lines), entropy, _logit(short, count), _logit(far, count), _logit(single, count), _logit(marked, count),
    ))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows x FEATURES of the texts in a chunk. An empty text has the statistics of no words and no bytes."""
    if len(at) == 2 and len(data) > 2 * PART:
        return long_statistics(data)
    rows = len(at) - 1
    n = np.diff(at).astype(np.float64)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))
    hist = sum(np.bincount(row[i : i + PART] * 256 + data[i : i + PART], minlength=rows * 256) for i in range(0, max(len(data), 1), PART)).reshape(rows, 256)
    lower, starts, ends, first = words(data, at)
    count = np.diff(first).astype(np.float64)
    word_row = np.repeat(np.arange(rows), np.diff(first))
    length = (ends - starts).astype(np.float64)
    distinct = _repeats(hashed_spans(lower, starts, ends), word_row, rows)
    # From one word's begin to the next there are blanks besides, which are no marks.
    marked = np.bincount(word_row, np.maximum.reduceat(_IS_MARK[data], starts) if len(starts) else (), rows)
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((at[:-1][n > 0], breaks[breaks + 1 < len(data)] + 1)))
    line_end = np.concatenate((line_start[1:], [len(data)])) if len(line_start) else line_start
    line_row = np.searchsorted(at, line_start, side="right") - 1
    lines = np.bincount(line_row, minlength=rows).astype(np.float64)
    unlike = _repeats(hashed_spans(data, line_start, line_end), line_row, rows)
    by = lambda x: np.bincount(word_row, x, rows)
    return _assemble(n, hist, count, by(length), by(length**2), distinct, marked, lines, unlike, by(length <= 3), by(length >= 12), by(length == 1))


class _Spans:
    """Sums over the spans of a text that comes in pieces: a span that a piece's end cuts is carried on."""

    def __init__(self):
        self.open: tuple[int, int, int] | None = None  # sum, size, marked
        self.keys = np.zeros(0, np.uint64)
        self.sums = np.zeros(7)  # spans, sizes, squares, marked, short, long, single

    def add(self, sums: np.ndarray, size: np.ndarray, marked: np.ndarray, begun: bool, ended: bool) -> None:
        """Spans in order; begun: the first goes on from the piece before; ended: the last ends in this piece."""
        size, marked = size.astype(np.int64), marked.astype(np.int64)
        if self.open:
            a, n, m = self.open
            if begun:
                sums, size, marked = sums.copy(), size.copy(), marked.copy()
                sums[0], size[0], marked[0] = np.uint64(joined_sum(a, n, int(sums[0]))), size[0] + n, max(marked[0], m)
            else:
                sums, size, marked = np.append(np.uint64(a), sums), np.append(n, size), np.append(m, marked)
            self.open = None
        if not ended and len(size):
            self.open = int(sums[-1]), int(size[-1]), int(marked[-1])
            sums, size, marked = sums[:-1], size[:-1], marked[:-1]
        self.keys = np.unique(np.concatenate((self.keys, hashes_of(sums, size) >> np.uint64(20))))
        x = size.astype(np.float64)
        self.sums += (len(x), x.sum(), (x**2).sum(), marked.sum(), (size <= 3).sum(), (size >= 12).sum(), (size == 1).sum())

    def end(self) -> np.ndarray:
        self.add(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), False, True)
        return self.sums


def long_statistics(data: np.ndarray, part: int = PART) -> np.ndarray:
    """The statistics of one text, piece by piece; what is held besides the text is its distinct words' and lines' hashes."""
    hist, own, lines = np.zeros(256), _Spans(), _Spans()
    for i in range(0, len(data), part):
        piece = data[i : i + part]
        hist += np.bincount(piece, minlength=256)
        lower, starts, ends, _ = words(piece, np.array([0, len(piece)]))
        last = i + part >= len(data)
        marked = np.maximum.reduceat(_IS_MARK[piece], starts) if len(starts) else np.zeros(0)
        own.add(span_sums(prefix_hashes(lower), starts, ends), ends - starts, marked, bool(len(starts)) and starts[0] == 0, last or not len(ends) or ends[-1] < len(piece))
        edges = np.unique(np.concatenate(([0], np.flatnonzero(piece == 10) + 1, [len(piece)])))
        lines.add(span_sums(prefix_hashes(piece), edges[:-1], edges[1:]), np.diff(edges), np.zeros(len(edges) - 1), True, last or piece[-1] == 10)
    (count, total, squares, marked, short, far, single), whole = own.end(), lines.end()[0]
    one = lambda x: np.array([float(x)])
    return _assemble(one(len(data)), hist[None], one(count), one(total), one(squares), one(len(own.keys)), one(marked), one(whole), one(len(lines.keys)), one(short), one(far), one(single))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array<double>, as FEATURES) of every whole text; null counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, "text", 2 << 20):
            x = statistics(data, at)
            yield batch_of(doc_id=batch.column(0), stats=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Discriminant:
    """Two Gaussian classes with shrunken covariances; scatter: sums of outer products of what rows differ from their class's mean."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, scatter: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.02):
        d = sums.shape[1]
        self.priors = (counts + 1.0) / (counts.sum() + 2.0)
        self.known = bool((counts >= 2).all())
        if not self.known:
            return
        self.means = sums / counts[:, None]
        covs = scatter / counts[:, None, None]
        pooled = np.einsum("c,cij->ij", counts / counts.sum(), covs)
        self.factors, self.logs = [], []
        for c in covs:
            s = (1 - to_pooled) * c + to_pooled * pooled
            s = (1 - to_identity) * s + to_identity * (np.trace(s) / d + 1e-9) * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1); the prior alone where a class has fewer than two rows."""
        if not self.known:
            return np.full(len(x), self.priors[1])
        dense = [np.log(p) - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * g for p, m, f, g in zip(self.priors, self.means, self.factors, self.logs, strict=True)]
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows (label 0 or 1, stats), in two passes: the classes' means, then the scatter about them, which so loses
    no digits. Sums are formed by partition, then by Spark; the driver gets 2 x (1 + d) and 2 x d^2 numbers."""
    d = len(FEATURES)

    def summed(of, k: int) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, k))
            for b in batches:
                label, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
                for c in (0, 1):
                    total[c] += of(c, x[label == c])
            yield batch_of(c=np.repeat([0, 1], k), i=np.tile(np.arange(k), 2), v=total.ravel())

        total = np.zeros((2, k))
        for c, i, v in rows.select(F.col("label").cast("int"), "stats").mapInArrow(add, "c long, i long, v double").groupBy("c", "i").agg(F.sum("v")).collect():
            total[c, i] = v
        return total

    first = summed(lambda c, x: np.append(len(x), x.sum(axis=0)), 1 + d)
    means = first[:, 1:] / np.maximum(first[:, :1], 1)
    scatter = summed(lambda c, x: ((x - means[c]).T @ (x - means[c])).ravel(), d * d)
    return Discriminant(first[:, 0], first[:, 1:], scatter.reshape(2, d, d))


def apply(stats: DataFrame, model: Discriminant) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(matrix(b.column(1)))
                yield batch_of(doc_id=b.column(0), score=s, predicted=(s >= 0.5).astype(np.int32))

    return stats.select("doc_id", "stats").mapInArrow(score, "doc_id long, score double, predicted int")


def training_rows(keyed: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """Labelled rows outside the held-out fold. Null ids and labels other than 0 and 1 never count; each pair of
    a document row and a label row of the same id counts once."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("doc_id", folds) != held))
    return keyed.join(own, "doc_id")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, score, predicted for every row of documents. Null text: as empty; no labels at all: score 0.5.

    Very long texts are measured piece by piece, to the same numbers. Rows that repeat stay, and get equal scores;
    an empty table gives no rows; scores that tie at 0.5 are predicted 1; further columns are not looked at.
    """
    scratch = Scratch(spark, "quality")
    stats = scratch.keep(document_statistics(docs))
    return apply(stats, fit(scratch.keep(training_rows(stats, labels, "quality", folds, held))))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
