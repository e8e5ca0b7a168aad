"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links form.

1. Each text becomes the set of its word shingles (64-bit hashes cut to a key of bucket bits + 40 bits).
   Equal sets in a chunk are taken together at once. Keys go to their bucket, in packed arrays; a bucket
   counts in how many sets each of its keys lies, and returns only the keys that lie in two sets or more.
2. Back at its chunk, a set keeps its live keys. Whatever two sets share is live, so a set with fewer live
   keys than a link needs is done; of the others, the rarest keys form a prefix that any linked partner
   must meet (prefix filter, in the order of document frequency).
3. In every prefix key's list one set is the pivot. Pivots query the inverted lists of the sets that they
   meet: DivideSkip merges the short lists, and probes the long ones by binary search for sets that came up
   often enough. Links give components, and lists that lie in one component are settled: a group of n copies
   costs n comparisons with its pivots, not n^2.
4. Lists that still hold several components get new pivots; what is left then is searched fully: of every
   two components that share a prefix key, the sets of the smaller query the lists of the larger, which are
   cut into shards of bounded size. No pair that can link goes without a search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, batch_of, chunks, hashed_spans, mix, runs, table, words
from .components import connected_components

N = 5
PERCENT = 80
SHARD = 1500
"""Sets to a search shard."""
PIVOT_ROUNDS = 3
LEAST_LEFT = 1_000_000
"""Another pivot round is worth its jobs while so many postings are unsettled."""
MU = 0.01
"""DivideSkip's weight of a probe against a merge step."""

_ODD = [int(x) | 1 for x in mix(np.arange(101, 101 + 64, dtype=np.uint64))]


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of a set of n with any set that it links with."""
    return -(-n * percent // 100)


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's texts, sorted within each text, and offsets."""
    lower, start, end, first = words(data, at)
    w = hashed_spans(lower, start, end)
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), windows)
    place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][row]
    h = np.zeros(len(place), np.uint64)
    width = np.minimum(count, n)[row]
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = width > k
            h[inside] += mix(w[place[inside] + k] + np.uint64(_ODD[k])) * np.uint64(_ODD[n + k])
        h = mix(h + width.astype(np.uint64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


class Lists:
    """Inverted lists over sets of keys, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        keys = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")  # owners stay in order within a key
        self.owner = owner[order]
        self.keys, self.start = np.unique(keys[order], return_index=True)
        self.end = np.append(self.start[1:], len(keys))

    def search(self, query: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Sets that link with the query (100 * common >= percent * union)."""
        if not len(self.keys) or not len(query):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        least = int(needed(np.array(size), percent))
        if len(at) < least:
            return np.zeros(0, np.int64)
        length = self.end[at] - self.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        skip = min(int(least / (MU * math.log2(max(int(length[-1]), 2)) + 1)), least - 1, len(at))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        merged = np.concatenate([self.owner[self.start[k] : self.end[k]] for k in short]) if len(short) else np.zeros(0, np.int32)
        found, count = np.unique(merged, return_counts=True)
        keep = count >= least - skip
        found, count = found[keep], count[keep]
        n = self.sizes[found]
        fit = (n * 100 >= size * percent) & (n * percent <= size * 100)
        found, count, n = found[fit], count[fit], n[fit]
        total = -(-(size + n) * percent // (100 + percent))  # the least intersection with each
        left = len(long)
        for k in long:
            live = count + left >= total
            if not live.all():
                found, count, total = found[live], count[live], total[live]
            if not len(found):
                break
            own = self.owner[self.start[k] : self.end[k]]
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[place] == found)
            left -= 1
        return found[count >= total].astype(np.int64)


def _rows(row: np.ndarray, many: int) -> np.ndarray:
    """Row numbers in two bytes where a chunk has few rows, else in four."""
    return row.astype(np.uint16 if many < 1 << 16 else np.uint32)


def _unrows(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.uint32)


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | (high.astype(np.int64) << 32)


def set_tables(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Rows of two kinds: (doc_id, n, node) for every document row, and (node, n, live, prefix) for every set that may link."""
    buckets = max(64, 8 * docs.rdd.getNumPartitions())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches):
            h, off = shingles(data, at, n)
            size = np.diff(off)
            names = [hashlib.blake2b(h[off[i] : off[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None for i in range(len(size))]
            first = {name: i for i, name in reversed(list(enumerate(names))) if name is not None}
            block = int.from_bytes(hashlib.blake2b(b"".join(x or b"-" for x in names) + len(names).to_bytes(8, "big"), digest_size=8).digest(), "big") >> 1
            doc = pa.array(batch.column(0).to_pylist(), pa.int64())
            meta = pa.RecordBatch.from_arrays([doc, pa.array(names, pa.binary(16)), pa.array(size)], names=["d", "f", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as writer:
                writer.write_batch(meta)
            own = np.zeros(len(size), bool)
            own[list(first.values())] = True
            row = np.repeat(np.arange(len(size), dtype=np.uint32), size)
            take = own[row]
            h, row = h[take], row[take]
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, row, bucket = h[order], row[order], bucket[order]
            there, begin, end = runs(bucket)
            low, high = h.astype(np.uint32), ((h >> np.uint64(32)) & np.uint64(255)).astype(np.uint8)
            row = _rows(row, len(size))
            yield batch_of(
                g=np.append(there, buckets + block % buckets),
                block=np.full(len(there) + 1, block),
                low=pa.array([*(low[a:b].tobytes() for a, b in zip(begin, end, strict=True)), sink.getvalue().to_pybytes()], pa.binary()),
                high=pa.array([*(high[a:b].tobytes() for a, b in zip(begin, end, strict=True)), None], pa.binary()),
                row=pa.array([*(row[a:b].tobytes() for a, b in zip(begin, end, strict=True)), None], pa.binary()),
            )

    def live(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        g = part.column("g")[0].as_py()
        if g >= buckets:
            none = pa.nulls(part.num_rows, pa.binary())
            return pa.table({"g": part.column("g"), "block": part.column("block"), "low": part.column("low"), "high": none, "row": none, "df": none})
        lows = [np.frombuffer(x, np.uint32) for x in part.column("low").to_pylist()]
        low, high = np.concatenate(lows), np.concatenate([np.frombuffer(x, np.uint8) for x in part.column("high").to_pylist()])
        rows = part.column("row").to_pylist()
        short = [len(r) == 2 * len(x) for r, x in zip(rows, lows, strict=True)]
        row = np.concatenate([_unrows(r, len(x)) for r, x in zip(rows, lows, strict=True)])
        src = np.repeat(np.arange(len(lows), dtype=np.int32), [len(x) for x in lows])
        key = _wide(low, high)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        df = np.diff(np.append(new, len(key)))
        df = np.repeat(df, df)
        some = order[df > 1]
        df, src = df[df > 1], src[some]
        order = np.argsort(src, kind="stable")
        some, df, src = some[order], np.minimum(df[order], 65535).astype(np.uint16), src[order]
        low, high, row = low[some], high[some], row[some]
        there, begin, end = runs(src)
        cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(begin, end, strict=True)], pa.binary())
        back = pa.array([row[x:y].astype(np.uint16 if short[i] else np.uint32).tobytes() for i, x, y in zip(there.tolist(), begin, end, strict=True)], pa.binary())
        return pa.table({"g": np.full(len(there), g), "block": part.column("block").combine_chunks().take(pa.array(there)), "low": cut(low), "high": cut(high), "row": back, "df": cut(df)})

    def select(part: pa.Table) -> pa.Table:
        listed = [part.column(c).to_pylist() for c in ("g", "low", "high", "row", "df")]
        metas = [low for low, row in zip(listed[1], listed[3], strict=True) if row is None]
        every = [x for x in zip(*listed, strict=True) if x[3] is not None]
        out: dict[str, list] = {c: [] for c in ("doc_id", "node", "n", "live", "prefix")}
        node, size = [], np.zeros(0, np.int64)
        for m in metas:
            docs_ = pa.ipc.open_stream(m).read_all()
            node, size = docs_.column("f").to_pylist(), docs_.column("n").to_numpy()
            # Chunks of the same sets come as a description each, whether or not their ids are the same.
            out["doc_id"] += docs_.column("d").to_pylist()
            out["node"] += node
            out["n"] += size.tolist()
        nothing = [None] * len(out["node"])
        out["live"] += nothing
        out["prefix"] += nothing
        if every:
            key = np.concatenate([_wide(np.frombuffer(x[1], np.uint32), np.frombuffer(x[2], np.uint8)) + (np.int64(x[0]) << 40) for x in every])
            row = np.concatenate([_unrows(x[3], len(x[1]) // 4) for x in every])
            df = np.concatenate([np.frombuffer(x[4], np.uint16) for x in every])
            order = np.lexsort((key, df, row))
            key, row = key[order], row[order]
            if len(metas) > 1:
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
                key, row = key[new], row[new]
            there, begin = np.unique(row, return_index=True)
            for i, a, b in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)], strict=True):
                least = int(needed(size[i], percent))
                k = int(size[i]) - least + 1 - (int(size[i]) - (b - a))
                if b - a >= least and k > 0:
                    out["doc_id"].append(None)
                    out["node"].append(node[i])
                    out["n"].append(int(size[i]))
                    out["live"].append(np.sort(key[a:b]))
                    out["prefix"].append(key[a : a + k])
        longs = pa.list_(pa.int64())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "node": pa.array(out["node"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "live": pa.array(out["live"], longs), "prefix": pa.array(out["prefix"], longs)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(spread, "g long, block long, low binary, high binary, row binary")
    back = sent.groupBy("g").applyInArrow(live, "g long, block long, low binary, high binary, row binary, df binary")
    return back.groupBy("block").applyInArrow(select, "doc_id long, node binary, n long, live array<long>, prefix array<long>")


def search(index: DataFrame, queries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) found by the queries of a shard among the sets indexed in it; both have shard, node, n, live, comp.

    Of the links in a shard those that join two components so far unjoined are given, so there are fewer than components.
    """

    def run(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        left, right = part.filter(pa.array(~asks)), part.filter(pa.array(asks))
        a, b = [], []
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        if left.num_rows and right.num_rows:
            nodes, sizes, comps = left.column("node").to_pylist(), left.column("n").to_numpy(), left.column("comp").to_pylist()
            lists = Lists([x.values.to_numpy() for x in left.column("live")], sizes)
            for node, n, comp, keys in zip(right.column("node").to_pylist(), right.column("n").to_pylist(), right.column("comp").to_pylist(), right.column("live"), strict=True):
                for i in lists.search(keys.values.to_numpy(), n, percent).tolist():
                    if (x := root(comp)) != (y := root(comps[i])):
                        up[x] = y
                        a.append(node)
                        b.append(nodes[i])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    cols = ("shard", "node", "n", "live", "comp")
    both = index.select(*cols, F.lit(False).alias("asks")).union(queries.select(*cols, F.lit(True).alias("asks")))
    return both.groupBy("shard").applyInArrow(run, "a binary, b binary")


def links_between_sets(sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(node, comp) of all sets that link with another; sets: distinct (node, n, live, prefix)."""
    postings = scratch.keep(sets.select("node", "n", F.explode("prefix").alias("key")))
    # Lists of one set alone are of no use.
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    postings = scratch.keep(postings.join(shared, "key"))
    lists = sets.select("node", "n", "live")
    shards = max(1, math.ceil(lists.count() / SHARD))
    known = postings.select("node").distinct().select("node", F.col("node").alias("comp"))
    open_ = postings.join(known, "node")
    links, left = None, postings.count()
    for turn in range(PIVOT_ROUNDS):
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("o") if turn else F.col("node").alias("o"), F.col("node").alias("node"), F.col("comp"), F.col("n"))
        pivots = open_.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pcomp"), F.col("p.n").alias("pn"))
        near = open_.join(pivots, "key").where((F.col("comp") != F.col("pcomp")) & (F.col("n") * 100 >= F.col("pn") * percent) & (F.col("n") * percent <= F.col("pn") * 100))
        pairs = scratch.keep(near.select("node", "pivot").distinct())
        # A pivot's sets lie in shards by pivot and part, so that a hot pivot's go to many.
        many = pairs.groupBy("pivot").agg(F.count("*").alias("c")).select("pivot", F.ceil(F.col("c") / SHARD).alias("parts"))
        parts = pairs.join(many, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("pivot"), F.lit(shards))).otherwise(F.xxhash64("pivot", "part").bitwiseOR(F.lit(-(1 << 63))))
        index = parts.select("node", shard.alias("shard")).distinct().join(lists, "node")
        asked = parts.select(F.col("pivot").alias("node"), shard.alias("shard")).distinct().join(lists, "node")
        found = search(index.withColumn("comp", F.col("node")), asked.withColumn("comp", F.col("node")), percent)
        links = scratch.keep(found if links is None else links.union(found))
        labels = connected_components(links, scratch)
        open_ = unsettled(postings, labels, scratch)
        before, left = left, open_.count()
        if left < LEAST_LEFT or left * 2 > before:
            break
    if left:
        links = scratch.keep(links.union(search(*full_shards(open_, lists), percent)))
        labels = connected_components(links, scratch)
    return labels


def unsettled(postings: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of the keys whose lists hold more than one component, with comp."""
    here = scratch.keep(postings.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return scratch.keep(here.join(mixed, "key"))


def full_shards(open_: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and queries of the exact search between components that share prefix keys.

    Components lie in shards by their smallest open key, so that those with common keys are mostly together; where such a
    shard would have more than SHARD sets, its components are dealt to several; a component of more than SHARD sets has
    shards of its own. A shard of several components is searched by its own sets. Between
    two shards that share a key the sets of one query the other: those of common shards the shards of large
    components, otherwise the lower number the higher. Which shards a key touches is a short list, whatever its sets.
    """
    members = open_.groupBy("node", "comp").agg(F.min("key").alias("key"))
    counts = members.groupBy("comp").agg(F.count("*").alias("c"), F.min("key").alias("home"))
    shards = max(1, math.ceil(members.count() / SHARD))
    parts = F.ceil(F.col("c") / SHARD)
    own = F.xxhash64("comp", F.pmod(F.xxhash64("node"), parts)).bitwiseOR(F.lit(-(1 << 63)))
    counts = counts.withColumn("at", F.pmod(F.xxhash64("home"), F.lit(shards)))
    load = counts.where(parts == 1).groupBy("at").agg(F.ceil(F.sum("c") / SHARD).alias("load"))
    counts = counts.join(load, "at", "left")
    together = F.col("at") * (1 << 24) + F.pmod(F.xxhash64("comp", F.lit(1)), F.col("load"))
    placed = members.join(counts, "comp").select("node", "comp", F.when(parts == 1, together).otherwise(own).alias("shard"))
    at = open_.select("key", "node").join(placed, "node")
    touched = at.groupBy("key", "shard").agg(F.min("comp").alias("other")).withColumnRenamed("shard", "to")
    # A shard with a negative number holds a part of one component.
    go = F.when((F.col("to") < 0) & (F.col("shard") < 0), (F.col("shard") < F.col("to")) & (F.col("comp") != F.col("other"))).when(F.col("to") < 0, True).when(F.col("shard") < 0, False).otherwise(F.col("shard") <= F.col("to"))
    asks = at.join(touched, "key").where(go).select("node", "comp", F.col("to").alias("shard")).distinct()
    return placed.select("node", "shard", "comp").join(lists, "node"), asks.join(lists, "node")


def jaccard_groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents (doc_id, text).

    component_id is the smallest doc_id reachable by links, the row's own included. Null, empty and blank
    texts have no shingle and are linked with nothing; fewer than n words count as one shingle. Equal sets
    are linked. Null ids take part; a group of null ids alone has a null component. Repeated rows stay.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    both = scratch.keep(set_tables(docs, n, percent))
    rows = both.where("live IS NULL").select("doc_id", "node", "n")
    sets = scratch.keep(both.where("live IS NOT NULL").select("node", "n", "live", "prefix").dropDuplicates(["node"]))
    labels = links_between_sets(sets, scratch, percent)
    # Smallest ids are found per set first, then per component, so that no group is gathered.
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = scratch.keep(named)
    of_comp = scratch.keep(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    final = scratch.keep(named.join(of_comp, "comp").select("node", "component_id"))
    return rows.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


#: The same by all pairs, for tables on which that is quick enough.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, k, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT k, unnest(s) AS g FROM sets), c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN sets x ON x.k = a JOIN sets y ON y.k = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, j) AS (SELECT k, k FROM sets UNION SELECT r.k, e.b FROM r JOIN e ON r.j = e.a)
SELECT any_value(o.doc_id) AS doc_id, CAST(any_value(len(o.s)) AS BIGINT) AS n_shingles, min(m.doc_id) AS component_id FROM r JOIN sets o ON o.k = r.k JOIN sets m ON m.k = r.j GROUP BY r.k
"""
