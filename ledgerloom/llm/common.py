"""What the training-data operators share: reading, scratch tables, Arrow text views, hashing.

Conventions every operator follows, unless its docstring says otherwise:

* a null text is an empty text, a null id is kept and comes back null;
* a text of any length is taken whole, in pieces where it is long;
* repeated rows stay repeated (one result row per input row), and equal texts get equal values;
* an empty table gives an empty result with the full schema;
* further columns are ignored: inputs are first projected to the named columns, so clashing names
  cannot reach a join.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
"""Texts are worked on in chunks of about this many bytes, so that a task's memory does not follow its input."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


# --- scratch tables -------------------------------------------------------------------------------

def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of our own only where it is unset and Spark runs
    on this machine alone. A cluster without a shared folder is an error."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints/ledgerloom"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        if path.startswith("/tmp/checkpoints/"):
            shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables written to the shared folder, which survive the loss of an executor and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_remove, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows once and read them back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table that no later result reads."""
        if path := getattr(df, "_scratch_path", None):
            _remove(self.spark, path)

    def sweep(self) -> None:
        """Free what finished jobs have left in shuffles.

        Spark's cleaner removes shuffle files once their plan has been collected as garbage, which a driver with little
        to do may put off for long. Plans hang on references from Python and through the JVM, so one collection follows
        the other until they are gone.
        """
        for _ in range(3):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)


# --- Arrow views of texts -------------------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and n + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start), data[at[start] : at[end]], at[start : end + 1] - at[start]
            start = end


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def text_pieces(text: str, breaks: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """A text in stretches of about `size` characters that end where `breaks` begins to match (the whole rest if it doesn't)."""
    start = 0
    while len(text) - start > 2 * size and (m := breaks.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, begins and ends of the runs of equal values in a sorted array."""
    values, begin = np.unique(key, return_index=True)
    return values, begin, np.append(begin[1:], len(key)) if len(begin) else begin


# --- hashing --------------------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 running polynomial sums modulo 2**64 (random byte values, odd base)."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_sums(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial sums of the byte spans [start, end), as if each stood at 0."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * down[start]


def joined_sum(a: int, n: int, b: int) -> int:
    """The sum of n bytes of sum a with bytes of sum b behind them."""
    return (a + pow(_BASE, n, 1 << 64) * b) % (1 << 64)


def hashes_of(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes from spans' sums and sizes."""
    with np.errstate(over="ignore"):
        return mix(sums + size.astype(np.uint64) * _STEP)


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes wherever they stand."""
    return hashes_of(span_sums(sums, start, end), end - start)


def hashed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    """Hashes of ascending spans, in pieces of about `limit` bytes: the running sums and their powers take 32 bytes for each
    byte of a piece, which a worker doesn't give back."""
    if len(data) <= 2 * limit:
        return span_hashes(prefix_hashes(data), start, end)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + limit, side="right")))
        out[i:j] = span_hashes(prefix_hashes(data[base : end[j - 1]]), start[i:j] - base, end[i:j] - base)
        i = j
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: lower-cased bytes (A-Z only), starts and ends of words (runs without blanks), words before each row."""
    lower = _LOWER[data]
    blank = _BLANK[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return lower, none, none, np.zeros(len(at), np.int64)
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    open_ = ~blank
    starts = np.flatnonzero(open_ & (np.concatenate(([True], blank[:-1])) | first))
    last = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(open_ & (np.concatenate((blank[1:], [True])) | last)) + 1
    return lower, starts, ends, np.searchsorted(starts, at, side="left")
