"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere is removed.

Equal strings of SPAN bytes choose the same place inside them: the leftmost of their smallest K-byte
hashes. So only these anchors (about one in 85 bytes) are indexed. Anchors whose K bytes occur once in the
corpus are done. The others get their context, the union of the SPAN-byte strings that chose them; equal
contexts fall together by a hash, and two of the same settle each other wholly. What differs goes to an
index family by K-byte hash: a batch of contexts becomes a sparse suffix array (its suffixes at the anchors,
in byte order), is merge-scanned against every level for partners that agree to the left and right over
SPAN bytes or more, and levels of equal size merge, so that n contexts lie in at most log n levels.

A K-byte string with more than HOT different contexts is not gathered: its strings' fingerprints are
counted by Spark instead, which gives the same spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, batch_of, prefix_hashes, span_hashes, table, utf8

SPAN = 200
K = 32
WINDOWS = SPAN - K + 1
HOT = 20_000
SEGMENT = 4 << 20
BATCH = 8192
"""Contexts of one batch of the index family."""
SHARD_CONTEXTS = 30_000
PAIRS = 1 << 14
"""Pairs compared at once."""
MANY = 1 << 12
"""A K-byte string with so many pairs between two batches is compared by fingerprints."""

_PLACE = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: row, anchor, first and last start of the SPAN-byte strings that chose it (all from the row's begin), K-byte hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none, none
    if n > 2 * SEGMENT and len(at) == 2:
        # A very long text goes in stretches that overlap by a string less a byte: every string lies in one of them.
        parts = []
        for start in range(0, n - SPAN + 1, SEGMENT):
            part = data[start : start + SEGMENT + SPAN - 1]
            row, p, s, e, k = anchors(part, np.array([0, len(part)]))
            parts.append((row, p + start, s + start, e + start, k))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    sums = prefix_hashes(data)
    places = np.arange(n - K + 1)
    h = span_hashes(sums, places, places + K)
    key = (h & ~_PLACE) | places.astype(np.uint64)
    m = len(key) - WINDOWS + 1
    width = -(-len(key) // WINDOWS) * WINDOWS
    padded = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, WINDOWS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:m], ahead[WINDOWS - 1 : WINDOWS - 1 + m]) & _PLACE).astype(np.int64)
    # Strings that lie inside one row.
    size = np.diff(at)
    begin = np.repeat(at[:-1], np.maximum(size - SPAN + 1, 0))
    row = np.repeat(np.arange(len(size)), np.maximum(size - SPAN + 1, 0))
    if not len(row):
        return none, none, none, none, none
    count = np.maximum(size - SPAN + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin
    place = place[start]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(new[1:], len(row)) - 1
    base = begin[new]
    return row[new], place[new] - base, start[new] - base, start[last] - base, h[place[new]].view(np.int64)


def packed_rows(docs: DataFrame, rest: list[str]) -> DataFrame:
    """u (a number of its own), n (bytes), z (the text, compressed by row: it is shuffled twice), rest (other columns)."""
    import zstandard

    names = ["rest"] if rest else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            data, at = utf8(b.column(1))
            raw = data.tobytes()
            z = [press(raw[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield batch_of(u=b.column(0), n=np.diff(at), z=pa.array(z, pa.binary()), **{c: b.column(2) for c in names})

    inputs = docs.select(F.monotonically_increasing_id().alias("u"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    return inputs.mapInArrow(pack, "u long, n long, z binary" + (f", rest {inputs.schema['rest'].dataType.simpleString()}" if rest else ""))


def unpacked(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text each, the texts end to end, and their offsets."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        if not batch.num_rows:
            continue
        z = batch.column(batch.schema.get_field_index("z"))
        at = np.concatenate(([0], np.cumsum(batch.column(batch.schema.get_field_index("n")).to_numpy())))
        start = 0
        while start < batch.num_rows:
            end = min(max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1), batch.num_rows)
            yield batch.slice(start, end - start), b"".join(expand(x) for x in z.slice(start, end - start).to_pylist() if x is not None), at[start : end + 1] - at[start]
            start = end


def find_anchors(rows: DataFrame) -> DataFrame:
    """u, p, s, e, k: anchors of every row (u, n, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in unpacked(batches, 1 << 19):
            row, p, s, e, k = anchors(np.frombuffer(raw, np.uint8), at)
            if len(row):
                yield batch_of(u=batch.column(0).take(pa.array(row)), p=p.astype(np.int32), s=s.astype(np.int32), e=e.astype(np.int32), k=k)

    return rows.select("u", "n", "z").mapInArrow(run, "u long, p int, s int, e int, k long")


def contexts(rows: DataFrame, live: DataFrame) -> DataFrame:
    """u, p, s, e, k, c, ctx: the live anchors with their contexts [s, e + SPAN) and a hash of context and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in unpacked(batches, 1 << 20):
            marks = part.column(part.schema.get_field_index("marks"))
            sizes = np.diff(marks.offsets.to_numpy())
            flat = marks.flatten()
            p, s, e, k = (flat.field(n).to_numpy() for n in ("p", "s", "e", "k"))
            base = np.repeat(at[:-1], sizes)
            u = np.repeat(part.column(0).to_numpy(), sizes)
            for j in range(0, len(p), 20_000):
                t = slice(j, j + 20_000)
                ctx = [raw[a:b] for a, b in zip((base[t] + s[t]).tolist(), (base[t] + e[t] + SPAN).tolist(), strict=True)]
                c = [hashlib.blake2b(x, digest_size=16, salt=int(o).to_bytes(4, "big")).digest() for x, o in zip(ctx, (p[t] - s[t]).tolist(), strict=True)]
                yield batch_of(u=pa.array(u[t]), p=p[t], s=s[t], e=e[t], k=k[t], c=pa.array(c, pa.binary()), ctx=pa.array(ctx, pa.binary()))

    marks = live.groupBy("u").agg(F.collect_list(F.struct("p", "s", "e", "k")).alias("marks"))
    joined = rows.select("u", "n", "z").join(marks, "u")
    return joined.select("u", "n", "z", "marks").mapInArrow(run, "u long, p int, s int, e int, k long, c binary, ctx binary")


class Family:
    """An index family of sparse suffix arrays over contexts.

    A context is (bytes, place of the anchor). reach_left and reach_right hold, by context, how far from its
    anchor the longest equal stretches go that some other context shares over SPAN bytes or more (0: none).
    """

    def __init__(self, span: int = SPAN, k: int = K, many: int = MANY):
        self.span, self.k, self.many = span, k, many
        self.left = np.zeros((0, span - k + 1), np.uint8)
        self.right = np.zeros((0, span), np.uint8)
        self.left_size = self.right_size = np.zeros(0, np.int64)
        self.reach_left = self.reach_right = np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []  # context numbers in suffix order

    def _suffixes(self, ids: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.right[ids]).view(f"S{self.span}").ravel()

    def _heads(self, ids: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.right[ids, : self.k]).view(f"S{self.k}").ravel()

    def add(self, batch: list[tuple[bytes, int]]) -> None:
        """Indexes a batch: its suffix array is scanned in itself and against all levels, then levels merge."""
        first, n = len(self.left), len(batch)
        left, right = np.zeros((n, self.left.shape[1]), np.uint8), np.zeros((n, self.span), np.uint8)
        sizes = np.zeros((2, n), np.int64)
        for i, (ctx, place) in enumerate(batch):
            a, b = np.frombuffer(ctx, np.uint8, place)[::-1], np.frombuffer(ctx, np.uint8, offset=place)[: self.span]
            left[i, : len(a)], right[i, : len(b)] = a, b
            sizes[:, i] = len(a), len(b)
        self.left, self.right = np.concatenate((self.left, left)), np.concatenate((self.right, right))
        self.left_size, self.right_size = np.append(self.left_size, sizes[0]), np.append(self.right_size, sizes[1])
        self.reach_left, self.reach_right = np.append(self.reach_left, np.zeros(n, np.int64)), np.append(self.reach_right, np.zeros(n, np.int64))
        ids = np.arange(first, first + n)
        ids = ids[np.argsort(self._suffixes(ids), kind="stable")]
        self._scan(ids, ids)
        for level in self.levels:
            self._scan(ids, level)
        self.levels.append(ids)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            two = np.concatenate((self.levels[-2], self.levels[-1]))
            self.levels[-2:] = [two[np.argsort(self._suffixes(two), kind="stable")]]

    def _scan(self, new: np.ndarray, level: np.ndarray) -> None:
        """Compares every suffix of `new` with the run of `level` that begins with the same K bytes."""
        itself = new is level
        heads, there = self._heads(new), self._heads(level)
        low, high = np.searchsorted(there, heads, side="left"), np.searchsorted(there, heads, side="right")
        run = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        size = np.diff(np.append(run, len(new)))
        cost = size * (high - low)[run]
        for i in np.flatnonzero(cost > self.many).tolist():
            a, b = new[run[i] : run[i] + size[i]], level[low[run[i]] : high[run[i]]]
            self._by_fingerprint(a if itself else np.unique(np.concatenate((a, b))))
        few = np.repeat(cost <= self.many, size)
        new, low, many = new[few], low[few], (high - low)[few]
        ends = np.cumsum(many)
        start = 0
        while start < len(new):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            m = many[start:stop]
            a = np.repeat(new[start:stop], m)
            b = level[np.repeat(low[start:stop], m) + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)]
            once = a < b if itself else a > b  # a level's contexts are older
            self._compare(a[once], b[once])
            start = stop

    def _agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        differ = x != y
        return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1]), most)

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        left = self._agree(self.left[a], self.left[b], np.minimum(self.left_size[a], self.left_size[b]))
        right = self._agree(self.right[a], self.right[b], np.minimum(self.right_size[a], self.right_size[b]))
        long = left + right >= self.span
        for own in (a[long], b[long]):
            np.maximum.at(self.reach_left, own, left[long])
            np.maximum.at(self.reach_right, own, right[long])

    def _by_fingerprint(self, ids: np.ndarray) -> None:
        """The same for many contexts: fingerprints of all their SPAN-byte strings, equal ones of different contexts."""
        prints, owner, back = [], [], []
        for i in ids.tolist():
            a, b = int(self.left_size[i]), int(self.right_size[i])
            f = fingerprints(np.concatenate((self.left[i, :a][::-1], self.right[i, :b])), self.span)
            prints.append(f)
            owner.append(np.full(len(f), i))
            back.append(a - np.arange(len(f)))
        prints, owner, back = np.concatenate(prints), np.concatenate(owner), np.concatenate(back)
        _, which, count = np.unique(prints, return_inverse=True, return_counts=True)
        hit = count[which] > 1  # a context holds no string twice around one anchor
        np.maximum.at(self.reach_left, owner[hit], back[hit])
        np.maximum.at(self.reach_right, owner[hit], self.span - back[hit])


def fingerprints(data: np.ndarray, span: int = SPAN) -> np.ndarray:
    start = np.arange(max(len(data) - span + 1, 0))
    return span_hashes(prefix_hashes(data), start, start + span)


def resolve(index: DataFrame, scratch: Scratch) -> DataFrame:
    """c, l, r: how far from the anchor a context's bytes are shared with other contexts of its K-byte string (k, c, o, ctx)."""
    sizes = scratch.keep(index.groupBy("k").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, total // SHARD_CONTEXTS + 1)

    def run(part: pa.Table) -> pa.Table:
        family = Family(many=MANY)
        part = part.sort_by("k")
        c = part.column("c")
        ctx, o = part.column("ctx"), part.column("o")
        for i in range(0, part.num_rows, BATCH):
            family.add(list(zip(ctx.slice(i, BATCH).to_pylist(), o.slice(i, BATCH).to_pylist(), strict=True)))
        hit = np.flatnonzero(family.reach_left + family.reach_right)
        return pa.table({"c": c.take(pa.array(hit)), "l": family.reach_left[hit].astype(np.int32), "r": family.reach_right[hit].astype(np.int32)})

    tame = index.join(sizes.where(F.col("n") <= HOT).select("k"), "k")
    near = tame.select(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), "k", "c", "o", "ctx").groupBy("shard").applyInArrow(run, "c binary, l int, r int")
    hot = sizes.where(F.col("n") > HOT)
    if not hot.take(1):
        return near
    return near.union(by_counted_fingerprints(index.join(hot.select("k"), "k")))


def by_counted_fingerprints(index: DataFrame) -> DataFrame:
    """The same for K-byte strings with very many contexts: no context meets another, fingerprints are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, o, ctx in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f = fingerprints(np.frombuffer(ctx, np.uint8))
                yield batch_of(c=pa.array([c] * len(f), pa.binary()), b=(o - np.arange(len(f))).astype(np.int32), f=f.view(np.int64))

    every = index.select("c", "o", "ctx").mapInArrow(run, "c binary, b int, f long")
    twice = every.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    return every.join(twice, "f").groupBy("c").agg(F.max("b").alias("l"), (F.lit(SPAN) - F.min("b")).cast("int").alias("r"))


def repeated_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """u, start, end: stretches to remove of rows (u, n, z), possibly overlapping; rows must be kept (u stable)."""
    found = scratch.keep(find_anchors(rows))
    # A kept table on one side lets Spark split a hot string's rows on the other among tasks.
    again = scratch.keep(found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    live = found.join(again, "k").select("u", "p", "s", "e", "k")
    members = scratch.keep(contexts(rows, live))
    scratch.drop(found)
    scratch.sweep()
    marks = members.select("u", "p", "s", "e", "k", "c")
    # One row stands for equal contexts; K-byte strings with a single context need no index.
    reps = scratch.keep(marks.groupBy("c").agg(F.count("*").alias("n"), F.min(F.struct("u", "p")).alias("x"), F.first("k").alias("k")).select("c", "n", "k", F.col("x.u").alias("u"), F.col("x.p").alias("p")))
    mixed = scratch.keep(reps.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("k"))
    wanted = reps.join(mixed, "k").select("u", "p", "k", "c")
    index = wanted.join(members.select("u", "p", (F.col("p") - F.col("s")).alias("o"), "ctx"), ["u", "p"]).select("k", "c", "o", "ctx")
    index = scratch.keep(index)
    scratch.sweep()
    partial = resolve(index, scratch)
    verdict = scratch.keep(reps.join(partial, "c", "left").where("n > 1 OR l IS NOT NULL").select("c", "n", "l", "r"))
    whole = F.col("n") > 1
    return marks.join(verdict, "c").select("u", F.when(whole, F.col("s")).otherwise(F.col("p") - F.col("l")).alias("start"), F.when(whole, F.col("e") + SPAN).otherwise(F.col("p") + F.col("r")).alias("end"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs (all columns but the text), with n_bytes, n_removed, n_spans, spans (start, end in bytes), kept (the bytes
    left) and kept_text (the same without bytes of characters that a cut has split).

    Null and empty texts and texts under SPAN bytes lose nothing. Matches never cross rows; repeated rows
    and rows with equal or null ids count as different rows, so their texts go if they are long enough.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    taken = [c for c in docs.columns if c != "text"]
    rows = scratch.keep(packed_rows(docs, taken))
    spans = repeated_spans(rows.where(F.col("n") >= SPAN), scratch)
    # Of one row's stretches those that repeat (nested windows) are many: equal ones fall together first.
    scratch.sweep()
    own = spans.distinct().groupBy("u").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["rest"] if taken else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, at in unpacked(batches, 2 << 20):
            n, gone, runs, kept = [], [], [], []
            for i, marks in enumerate(b.column(b.schema.get_field_index("marks")).to_pylist()):
                text = raw[at[i] : at[i + 1]]
                merged: list[list[int]] = []
                for m in sorted((m["start"], m["end"]) for m in marks or ()):
                    if merged and m[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], m[1])
                    else:
                        merged.append(list(m))
                edges = [0, *(x for m in merged for x in m), len(text)]
                n.append(len(text))
                gone.append(sum(e - s for s, e in merged))
                runs.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            out = {c: b.column(b.schema.get_field_index(c)) for c in names}
            yield batch_of(**out, n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array([len(r) for r in runs], pa.int64()), spans=pa.array(runs, pair), kept=pa.array(kept, pa.binary()), kept_text=pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))

    rest = f"rest {rows.schema['rest'].dataType.simpleString()}, " if taken else ""
    out = rows.join(own, "u", "left").select("n", "z", *names, "marks").mapInArrow(cut, f"{rest}n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_text string")
    return out.select(*[F.col(f"rest.`{c}`") for c in taken], "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by every 200-byte string of every text, for tables on which that is quick enough.
SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, hash(substr(h, 2 * i + 1, 400)) AS f FROM (SELECT k, h, unnest(range(0, strlen(h) // 2 - 199)) AS i FROM t)),
d AS (SELECT k, i FROM w WHERE f IN (SELECT f FROM w GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM d),
n AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM s), gone AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY k, g),
edge AS (SELECT k, a, b, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS before FROM gone),
kept AS (SELECT k, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM edge JOIN t USING (k) GROUP BY k)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE concat(x, substr(h, 2 * last + 1)) END)) AS kept_sha256 FROM t LEFT JOIN kept USING (k)
"""
