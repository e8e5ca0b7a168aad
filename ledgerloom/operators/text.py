"""Text: words, shingles, near-duplicates, identifiers, token estimates, diversity, degenerate texts, edit distance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word, piece, masking and identifier patterns.
WORD = r"[a-z0-9|.,%-]+"
PIECE = r"[A-Za-z]+|\d+|[^\sA-Za-z\d]"
MASKS = (r"\b\d{2,8}\|[0-9A-F]{6,12}\b", r"\b\d{4}-\d{2}-\d{2} \d{2}:\d{2}\b", r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b")
IDENTIFIERS = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("swift_bic", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("us_ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("payment_card", r"\b(?:\d[ -]?){13,19}\b"),
    ("phone", r"\+\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b"),
    ("url", r"\b(?i:https?)://\S+"),
    ("bitcoin_address", r"\b(?:bc1[a-z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("ethereum_address", r"\b0x[a-fA-F0-9]{40}\b"),
    ("long_digit_run", r"\b\d{12,}\b"),
)
TERMINAL = r"[.!?][\"')\]]*$"
MARKDOWN = r"(?m)^\s*(#{1,6}\s|[-*+]\s|\d+\.\s|```)"
PREAMBLE = r"(?i)^\s*(here(?:'s| is)|sure[,!]|certainly|below is|i(?:'ve| have)\b|as requested|the following is|narrative:|rewritten narrative)"
CHARS_PER_TOKEN = 3.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as joined strings; none of a shorter array. Give a column, not an expression: a lambda would compute it anew for each n-gram."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Set of n-word shingles; a shorter text is one shingle; no word: none."""
    return F.when(F.size(tokens) >= n, F.array_distinct(ngrams(tokens, n))).when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, first_id, n: rows whose text stands more than once, with the smallest id that has it."""
    g = docs.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.select("doc_id", F.sha2("text", 256).alias("h")).join(g, "h").select("doc_id", "first_id", "n")


def minhash_signatures(sets: DataFrame, column: str, permutations: int = 128, seed: int = 7) -> DataFrame:
    """The frame with `sig`: minima of affine maps of the hashes in `column` (array of long) modulo a prime; an empty set has the largest value everywhere.

    The hashes of an Arrow batch stand in one array, which each map goes through once; runs of it are the sets.
    """
    import numpy as np
    from pyspark.sql.functions import arrow_udf

    prime = np.uint64((1 << 31) - 1)
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, int(prime), permutations).astype(np.uint64), rng.integers(0, int(prime), permutations).astype(np.uint64)

    @arrow_udf("array<bigint>")
    def sign(hashes):
        import pyarrow as pa

        h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & prime
        size = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        sig = np.full((len(size), permutations), prime, np.uint64)
        start = 0
        while start < len(size):  # some sets at a time, so that their hashes stay near
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + (1 << 15), side="right")))
            own = start + np.flatnonzero(size[start:stop])
            if len(own):
                first = ends[start] - size[start]
                x, at = h[first : ends[stop - 1]], (ends - size)[own] - first
                for j in range(permutations):
                    v = x * a[j]
                    v += b[j]
                    v = (v & prime) + (v >> np.uint64(31))
                    sig[own, j] = np.minimum.reduceat(np.minimum(v, v - prime), at)  # below the prime, the difference wraps
            start = stop
        return pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * permutations, sig.astype(np.int64).ravel())

    return sets.withColumn("sig", sign(column))


def shingle_hashes(tokens: Column, n: int = 5) -> Column:
    """The set of `shingles` as ascending 64-bit hashes, made of the words' own; no word: none."""
    import numpy as np
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<bigint>")
    def sets(words_):
        import pyarrow as pa

        w = words_.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = words_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # A shorter text is one shingle of what there is; its length is part of the hash.
        count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
        row = np.repeat(np.arange(len(size)), count)
        at = np.repeat(np.cumsum(size) - size, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size, n)[row]
        h = length.astype(np.uint64)
        for k in range(n):
            x = (h ^ np.where(k < length, w[np.minimum(at + k, max(len(w) - 1, 0))], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            h = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        h = h.view(np.int64)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(size)))))
        return pa.ListArray.from_arrays(ends.astype(np.int32), h[new])

    return sets(F.transform(tokens, lambda x: F.xxhash64(x)))


PIVOTS = 16
"""So many sets of a bucket are compared with all behind them in the first round; twice as many in each further one."""
NEAR_PAIRS = 1_000_000
"""So many confirmed pairs are decided on the driver; more, by joins."""


def lsh_near_duplicates(docs: DataFrame, threshold: float = 0.8, permutations: int = 128, bands: int = 32) -> DataFrame:
    """a, b, jaccard: for every dropped shingle set the smallest kept one that drops it among those it met; ids are the smallest with a set.

    Greedy in id order over MinHash candidates, confirmed on the sets of 64-bit shingle hashes: equal sets are taken
    together first. In every band's bucket the smallest ids are compared with all behind them and leave it; sets that a
    kept one drops leave all buckets. So a bucket of n near copies costs some n comparisons, and one of n different sets
    takes rounds as the logarithm of n. A set is kept once it has left its buckets and no set that may be kept is near.
    """
    from ..sources.stores import scratch_table

    spark = docs.sparkSession
    rows = permutations // bands
    w = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    t = minhash_signatures(w.select("doc_id", shingle_hashes(F.col("w")).alias("s")), "s", permutations)
    sets = scratch_table(spark, t.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("s").alias("n"), F.struct(F.xxhash64("s"), F.hash("s")).alias("k"), "s", F.array(*[F.xxhash64(F.slice("sig", b * rows + 1, rows)) for b in range(bands)]).alias("bands")))
    first = sets.where("n > 0").groupBy("k").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")
    left = scratch_table(spark, sets.select("row", "doc_id", "n", "bands").join(first, "row").select("doc_id", "n", F.posexplode("bands").alias("band", "h")))
    near, dropped = None, None
    pivots = PIVOTS
    while True:
        many = left.groupBy("band", "h").agg(F.count("*").alias("c")).where("c > 1").select("band", "h")
        left = scratch_table(spark, left.join(many, ["band", "h"]).withColumn("r", F.row_number().over(W.partitionBy("band", "h").orderBy("doc_id"))))
        if not left.take(1):
            break
        x, y = (left.select("band", "h", F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("r").alias(f"r{c}")) for c in "ab")
        # Sets whose sizes differ by more than the threshold can't reach it.
        alike = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
        pairs = x.where(F.col("ra") <= pivots).join(y, ["band", "h"]).where((F.col("ra") < F.col("rb")) & (F.col("a") < F.col("b")) & alike).select("a", "b").distinct()
        if near is not None:
            pairs = pairs.join(near.select("a", "b"), ["a", "b"], "left_anti")
        own = sets.join(first, "row").select("doc_id", "s")
        j = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        j = j.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n")).select("a", "b", (F.col("i") / (F.col("n") - F.col("i"))).alias("jaccard"))
        new = scratch_table(spark, j.where(F.col("jaccard") >= threshold))
        near = new if near is None else near.unionByName(new)
        left = left.where(F.col("r") > pivots).drop("r")
        dropped = _greedy(near, left)
        left = left.join(dropped.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
        pivots *= 2
    return spark.createDataFrame([], "a long, b long, jaccard double") if near is None else _greedy(near, None)


def _greedy(near: DataFrame, left: DataFrame | None) -> DataFrame:
    """a, b, jaccard: the smallest kept a of each b that is dropped for certain; what is left in a bucket is not known to be kept."""
    from ..sources.stores import scratch_table

    spark = near.sparkSession
    ends = near.select(F.col("a").alias("doc_id")).distinct()
    waits = ends.limit(0) if left is None else ends.join(left.select("doc_id"), "doc_id", "left_semi")
    if near.limit(NEAR_PAIRS + 1).count() <= NEAR_PAIRS:
        unsure, by, kept = {r[0] for r in waits.collect()}, {}, []
        for a, b, j in near.collect():
            by.setdefault(b, []).append((a, j))
        gone = set()
        for b in sorted(by):  # all smaller ones are decided by then
            own = [x for x in by[b] if x[0] not in gone]
            sure = [x for x in own if x[0] not in unsure]
            if sure:
                gone.add(b)
                kept.append((min(sure)[0], b, min(sure)[1]))
            elif own:
                unsure.add(b)
        return spark.createDataFrame(kept, near.schema)
    edges = near
    gone = near.limit(0)
    while True:
        unsure = edges.select(F.col("b").alias("a")).union(waits).distinct()
        sure = scratch_table(spark, edges.join(unsure, "a", "left_anti").groupBy("b").agg(F.min(F.struct("a", "jaccard")).alias("x")).select("x.a", "b", "x.jaccard"))
        if not sure.take(1):
            return gone
        gone = gone.unionByName(sure)
        out = sure.select("b")
        edges = scratch_table(spark, edges.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti"))


def drop_near_duplicates(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents that no pair drops: of a pair the larger id goes, and so do exact copies but the first of each text."""
    copies = exact_duplicates(docs.where("text <> ''")).where("doc_id <> first_id").select("doc_id")
    return docs.join(pairs.select(F.col("b").alias("doc_id")).unionByName(copies).distinct(), "doc_id", "left_anti")


def masked(text: Column) -> Column:
    for m in MASKS:
        text = F.regexp_replace(text, "(?U)" + m, " ")
    return text


def identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, match: what looks like a personal identifier, after account keys, times and plain numbers are masked."""
    m = docs.select(key, masked(F.col(text)).alias("m"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("m", F.lit("(?U)" + p), F.lit(0)).alias("found")) for k, p in IDENTIFIERS])
    return m.select(key, F.explode(kinds).alias("x")).select(key, "x.kind", F.explode("x.found").alias("match"))


def holds_identifier(masked_text: Column) -> Column:
    """Whether `identifiers` finds anything in a text that is masked already (give a column: each kind looks at it)."""
    return reduce(lambda x, y: x | y, [masked_text.rlike("(?U)" + p) for _, p in IDENTIFIERS])


def heuristic_tokens(text: Column) -> Column:
    """Estimated tokens: letters by 3.5 to a token (half to even, at least 1), digits by three, other signs one each."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    one = lambda p: F.when(p.rlike("^[A-Za-z]"), F.greatest(F.lit(1), F.bround(F.length(p) / CHARS_PER_TOKEN).cast("int"))).when(p.rlike(r"^\d"), F.ceil(F.length(p) / 3).cast("int")).otherwise(1)
    return F.aggregate(pieces, F.lit(0), lambda a, p: a + one(p))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def distinct_n(docs: DataFrame, group: str, n: int) -> DataFrame:
    """group, n_unique, n_total, distinct: share of different n-grams by group."""
    g = docs.select(group, words(F.col("text")).alias("w")).select(group, F.explode(ngrams(F.col("w"), n)).alias("g"))
    by = g.groupBy(group, "g").agg(F.count("*").alias("c"))  # counted before it is counted distinct: no wide distinct state
    return by.groupBy(group).agg(F.count("*").alias("n_unique"), F.sum("c").alias("n_total")).withColumn("distinct", F.col("n_unique") / F.col("n_total"))


def type_token_ratio(docs: DataFrame) -> DataFrame:
    t = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_types"), F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"))


def length_stats(docs: DataFrame, group: str) -> DataFrame:
    """group, n, mean, std (population, 0 for one row), least, most, median of word counts."""
    t = docs.select(group, word_count(F.coalesce("text", F.lit(""))).alias("k"))
    return t.groupBy(group).agg(F.count("*").alias("n"), F.avg("k").alias("mean"), F.round(F.coalesce(F.stddev_pop("k"), F.lit(0.0)), 6).alias("std"), F.min("k").alias("least"), F.max("k").alias("most"), F.percentile("k", 0.5).alias("median"))


def degeneracy(docs: DataFrame, repeats: int = 3, sections: int = 4, section_words: int = 10, ratio: float = 0.35) -> DataFrame:
    """doc_id, reasons (in checking order, joined by commas): truncated, repetitive, too_few_sections, stub_section, preamble_or_markdown, low_lexical_variety."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", ""), r"\s+$", "")
    d = docs.select("doc_id", text.alias("t")).withColumn("w", words(F.col("t")))
    g = ngrams(F.col("w"), 5)
    # The most frequent 5-gram: equal ones stand together once sorted, so `repeats` neighbours need not be counted.
    d = d.withColumn("g", F.array_sort(g)).withColumn("loops", F.when(F.size("g") >= repeats, F.exists(F.sequence(F.lit(1), F.size("g") - repeats + 1), lambda i: F.element_at("g", i) == F.element_at("g", i + repeats - 1))).otherwise(False))
    parts = F.filter(F.split("t", r"\n\s*\n"), lambda p: ~p.rlike(r"^\s*$"))
    d = d.withColumn("p", parts)
    stub = F.exists("p", lambda p: F.size(F.regexp_extract_all(F.lower(p), F.lit(WORD), F.lit(0))) < section_words)
    checks = [
        ("truncated", ~F.col("t").rlike(TERMINAL)),
        ("repetitive", F.col("loops")),
        ("too_few_sections", F.size("p") < sections),
        ("stub_section", (F.size("p") >= sections) & stub),
        ("preamble_or_markdown", F.col("t").rlike(MARKDOWN) | F.col("t").rlike(PREAMBLE)),
        ("low_lexical_variety", (F.size("w") > 0) & (F.size(F.array_distinct("w")) / F.size("w") < ratio)),
    ]
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks])), ",").alias("reasons"))


def normalised_levenshtein(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / most)


def token_f1(pairs: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, f1 of the multisets of content words of a and b; two empty ones agree wholly."""
    w = lambda c: F.filter(words(F.col(c)), lambda x: ~x.isin(*stop)) if stop else words(F.col(c))
    t = pairs.select("pair_id", w("a").alias("wa"), w("b").alias("wb"))
    side = lambda c: t.select("pair_id", F.explode(c).alias("x")).groupBy("pair_id", "x").agg(F.count("*").alias(c))
    common = side("wa").join(side("wb"), ["pair_id", "x"]).groupBy("pair_id").agg(F.sum(F.least("wa", "wb")).alias("c"))
    total = F.size("wa") + F.size("wb")
    return t.join(common, "pair_id", "left").select("pair_id", F.when(total == 0, 1.0).otherwise(2 * F.coalesce("c", F.lit(0)) / total).alias("f1"))


def self_bleu(docs: DataFrame, references: int = 5, sample: int = 800, order: int = 4) -> DataFrame:
    """doc_id, bleu: BLEU of each of the first `sample` documents in hash order against the next `references` of them, clipped precisions, brevity penalty."""
    key = F.sha2(F.concat_ws(":", F.lit("bleu"), F.col("doc_id").cast("string")), 256)
    drawn = docs.where("text IS NOT NULL").orderBy(key).limit(sample).select("doc_id", words(F.col("text")).alias("w"), key.alias("h"))

    def run(pdf):
        import math
        from collections import Counter

        import pandas as pd

        pdf = pdf.sort_values("h")
        ids, texts = pdf["doc_id"].tolist(), [list(w) for w in pdf["w"]]
        grams = [[Counter(zip(*[t[i:] for i in range(n)], strict=False)) for n in range(1, order + 1)] for t in texts]
        out = []
        for i, t in enumerate(texts):
            refs = [(i + k) % len(texts) for k in range(1, references + 1) if (i + k) % len(texts) != i]
            logs = 0.0
            for n in range(order):
                best: Counter = Counter()
                for r in set(refs):
                    best |= grams[r][n]
                total = max(sum(grams[i][n].values()), 1)
                hit = sum((grams[i][n] & best).values())
                logs += math.log(hit / total) if hit else -math.inf
            near = min((abs(len(texts[r]) - len(t)), len(texts[r])) for r in refs)[1] if refs else 0
            brevity = 1.0 if len(t) > near or not t else math.exp(1 - near / len(t))
            out.append((ids[i], brevity * math.exp(logs / order) if refs and t else 0.0))
        return pd.DataFrame(out, columns=["doc_id", "bleu"])

    return drawn.withColumn("g", F.lit("sample")).groupBy("g").applyInPandas(run, "doc_id long, bleu double")  # a bounded sample


PHRASES = 10_000


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, phrase_group, phrase: of each group the longest phrase that the lower-cased text holds (a list of at most PHRASES is broadcast)."""
    if phrases.limit(PHRASES + 1).count() > PHRASES:
        raise ValueError(f"more than {PHRASES} phrases")
    j = docs.select("doc_id", F.lower("text").alias("t")).join(F.broadcast(phrases), F.expr("contains(t, phrase)"))
    w = W.partitionBy("doc_id", "phrase_group").orderBy(F.desc(F.length("phrase")), "phrase")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "phrase_group", "phrase")


def canonical(text: Column) -> Column:
    """Blanks inside paragraphs collapsed, paragraphs set apart by one empty line."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def python_words(text: str) -> list[str]:
    """The words of one text, for tests and small helpers."""
    return re.findall(WORD, text.lower())
