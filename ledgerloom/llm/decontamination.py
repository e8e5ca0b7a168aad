"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A text becomes its lower-cased words (runs of letters and digits) as 32-bit hashes. Every mask ignores
some of the positions under it; the hash of the words it selects is a seed. Seeds of documents meet the
benchmark's seeds in one equi-join, and around every meeting the two texts are laid side by side on that
diagonal: a document overlaps an item where some WINDOW neighbouring words (all of a shorter item's) agree
in at least SAME of their places, so substituted words don't hide a passage. Items of fewer than
LEAST_WORDS words are looked for as they are. Where the masks are too sparse for a short item, runs of
neighbouring words are seeds too: so many substitutions as SAME allows leave one of them whole.

Every window that agrees in SAME of its places holds a seed (tests enumerate all substitutions), so the
search misses none. Texts go in overlapping stretches, so that a seed's row is small however long its text.
The benchmark's seeds are broadcast only while they are counted to be few; beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MASKS = ("1101011", "11010011")
WINDOW = 13
SAME = 0.8
LEAST_WORDS = 8
"""Items of fewer words must agree in all of their words."""
RUNS = {8: 4, 9: 4, 10: 3, 11: 3}
"""Words of a run by the words of an item. One substitution leaves 4 of 8 words in a row, two leave 3 of 10."""
STRETCH = 240
"""Texts are searched in stretches of so many words, which overlap."""
BROADCAST_BYTES = 64 << 20
"""The benchmark's seeds (each with its item's word hashes) are broadcast up to so many bytes."""


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.hash(w))


def seeds(h: Column, number: int, mask: str) -> Column:
    """The seeds of one mask at every position where it fits; the mask's number is part of the hash."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    there = F.size(h) - F.lit(len(mask))
    at = lambda i: F.xxhash64(F.lit(number), *[F.get(h, i + k if k else i) for k in picked])
    return F.when(there >= 0, F.transform(F.sequence(F.lit(0), there), at)).otherwise(F.array().cast("array<bigint>"))


def seeded(df: DataFrame, h: str, masks: dict[int, str]) -> DataFrame:
    """One row per seed: the frame's columns, _seed, _at (word position). Masks by number."""
    every = F.concat(*[seeds(F.col(h), k, m) for k, m in masks.items()])
    out = df.select("*", F.posexplode(every).alias("_k", "_seed"))
    at, before = F.col("_k"), F.lit(0)
    for m in list(masks.values())[:-1]:
        before = before + F.greatest(F.size(h) - F.lit(len(m) - 1), F.lit(0))
        at = F.when(F.col("_k") >= before, F.col("_k") - before).otherwise(at)
    return out.withColumn("_at", at).drop("_k")


def stretches(docs: DataFrame) -> DataFrame:
    """doc_id, _base, _h: the word hashes of every text in stretches of STRETCH words and a window less a word more.

    So any window lies in one of them whole, and what a seed carries along does not grow with its text.
    """
    whole = docs.select(F.col("doc_id"), word_hashes(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - F.lit(WINDOW), F.lit(0)), F.lit(STRETCH))
    return whole.select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("_base"), F.slice("_w", i + 1, F.lit(STRETCH + WINDOW - 1)).alias("_h")))).alias("_x")).select("doc_id", "_x._base", "_x._h")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_same, n_window, start: pairs that overlap, with the best window's agreeing words and the
    word position in the document at which the item's first word lies (negative if it lies before the text).

    Null and empty texts and items overlap with nothing; rows that repeat an id are taken together under it, and
    repeated rows give one result; of windows that agree in as many words the first counts; items of fewer than
    LEAST_WORDS words overlap with texts that have all of them in a row; texts of any length are taken whole, in
    stretches. An empty table on either side gives no rows; further columns are not looked at.
    """
    items = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("_b")).where(F.size("_b") > 0).distinct()
    # A seed row is some 40 bytes and four for each word of its item, and an item has at most a seed for each word and mask.
    size, short = items.agg(F.coalesce(F.sum(F.size("_b").cast("long") * (4 * F.size("_b") + 40)), F.lit(0)), F.collect_set(F.when(F.size("_b") <= max(RUNS), F.size("_b")))).first()
    size *= len(MASKS) + 1
    # Only the lengths that there are give the documents further seeds.
    whole = dict(enumerate(MASKS))
    own = {n: len(MASKS) + RUNS.get(n, n) for n in sorted(short)}
    masks = whole | {k: "1" * (k - len(MASKS)) for k in sorted(set(own.values()))}
    probe = seeded(items.where(F.size("_b") >= LEAST_WORDS), "_b", whole)
    for n, k in own.items():
        probe = probe.union(seeded(items.where(F.size("_b") == n), "_b", {k: masks[k]}))
    probe = probe.withColumnRenamed("_at", "_i")
    parts = stretches(docs)
    if size <= BROADCAST_BYTES:
        near = seeded(parts, "_h", masks).join(F.broadcast(probe), "_seed").withColumn("_shift", F.col("_at") - F.col("_i"))
    else:
        # Only ids and places are shuffled by seed; the words beside a hit are fetched after that. Whatever agrees under
        # an id is an overlap of that id, so stretches of rows that repeat an id may stand in for each other.
        hits = seeded(parts, "_h", masks).select("doc_id", "_base", "_at", "_seed").join(probe.select("item_id", "_i", "_seed"), "_seed")
        hits = hits.select(F.col("doc_id").alias("_d"), F.col("_base").alias("_o"), F.col("item_id").alias("_t"), (F.col("_at") - F.col("_i")).alias("_shift")).distinct()
        near = hits.join(parts, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_o") == F.col("_base"))).join(items, F.col("_t").eqNullSafe(F.col("item_id"))).drop("_d", "_o", "_t")
    low, high = F.greatest(F.lit(0), -F.col("_shift")), F.least(F.size("_b"), F.size("_h") - F.col("_shift"))
    # Only the words beside the item leave the join; a stretch's seeds on one diagonal fall together.
    beside = near.select("doc_id", "item_id", (F.col("_base") + F.col("_shift")).alias("start"), low.alias("_low"), F.slice("_h", F.col("_shift") + low + 1, F.greatest(high - low, F.lit(0))).alias("_p"), F.slice("_b", low + 1, F.greatest(high - low, F.lit(0))).alias("_q"), F.size("_b").alias("_m"))
    lines = beside.distinct()
    width = F.least(F.col("_m"), F.lit(WINDOW))
    same = F.zip_with("_p", "_q", lambda a, b: F.when(a == b, 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_s") - width + 1), lambda j: F.aggregate(F.slice("_s", j, width), F.lit(0), lambda x, y: x + y)))
    found = lines.withColumn("_s", same).where(F.size("_s") >= width).withColumn("n_same", best).withColumn("n_window", width)
    found = found.where(F.col("n_same") >= F.when(F.col("_m") < LEAST_WORDS, F.col("_m")).otherwise(F.ceil(F.lit(SAME) * F.col("n_window"))))
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("start")).alias("_s"), "n_window")).alias("_x")).select("doc_id", "item_id", F.col("_x.n_same").alias("n_same"), F.col("_x.n_window").alias("n_window"), (-F.col("_x._s")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns; rows without an id are kept."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same without seeds: of words that agree in 80 % (all, of fewer than 8), some three words in a row do (all, of fewer
#: than three), so runs of three words bring every pair of places side by side that can overlap.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, w, least(3, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM b),
dr AS (SELECT doc_id, w, i, k, w[i:i + k - 1] AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
br AS (SELECT item_id, w, i, k, w[i:i + k - 1] AS run FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
near AS (SELECT DISTINCT dr.doc_id, br.item_id, dr.i - br.i AS start, dr.w AS dw, br.w AS bw FROM dr JOIN br ON dr.k = br.k AND dr.run = br.run),
sides AS (SELECT *, least(len(bw), {WINDOW}) AS n_window, row_number() OVER () AS k FROM near),
places AS (SELECT k, doc_id, item_id, start, len(bw) AS m, n_window, p, CAST(bw[p] = dw[p + start] AS INTEGER) AS same
  FROM (SELECT *, unnest(range(greatest(1, 1 - start), least(len(bw), len(dw) - start) + 1)) AS p FROM sides) x),
sums AS (SELECT k, doc_id, item_id, start, m, n_window, p, sum(same) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS s13,
  sum(same) OVER (PARTITION BY k) AS s_all, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM places),
best AS (SELECT doc_id, item_id, start, m, n_window, max(CASE WHEN n_window = {WINDOW} THEN s13 ELSE s_all END) AS n_same FROM sums WHERE r >= n_window GROUP BY k, doc_id, item_id, start, m, n_window),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same DESC, start ASC, n_window DESC) AS o FROM best WHERE n_same >= CASE WHEN m < {LEAST_WORDS} THEN m ELSE ceil({SAME} * n_window) END)
SELECT doc_id, item_id, CAST(n_same AS INTEGER) AS n_same, CAST(n_window AS INTEGER) AS n_window, CAST(start AS INTEGER) AS start FROM ranked WHERE o = 1
"""
