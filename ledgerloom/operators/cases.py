"""Cases: windows, buckets, stratified sampling in hash order, temporal splits and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(*cols, seed: str = "17") -> Column:
    """A reproducible shuffle key: sha256 of seed and id."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]), 256)


def hours_later(ts: Column, hours: float) -> Column:
    return (ts.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))).cast("timestamp_ntz")


def overlaps(a: str, b: str, c: str, d: str) -> Column:
    """Closed intervals [a, b] and [c, d] meet."""
    return (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))


def straddles(start: str, end: str, at: Column) -> Column:
    return (F.col(start) < at) & (at < F.col(end))


def bounded_window(df: DataFrame, start: str, end: str, pad_hours: float, most_hours: float) -> DataFrame:
    """Windows padded on both sides; one that is then too long is cut to `most_hours` around its centre."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a, b = us(start) - int(pad_hours * 3.6e9), us(end) + int(pad_hours * 3.6e9)
    half = int(most_hours * 1.8e9)
    centre = F.floor((us(start) + us(end)) / 2)
    long = (b - a) > int(most_hours * 3.6e9)
    back = lambda x: F.timestamp_micros(x.cast("long")).cast("timestamp_ntz")
    return df.withColumn("window_start", back(F.when(long, centre - half).otherwise(a))).withColumn("window_end", back(F.when(long, centre + half).otherwise(b)))


def activity_buckets(nodes: DataFrame, column: str = "degree") -> DataFrame:
    """node_id, bucket 0 to 9: share of the largest log degree, in tenths."""
    most = nodes.agg(F.max(F.log1p(F.col(column).cast("double"))).alias("_most"))
    return nodes.crossJoin(F.broadcast(most)).select("node_id", F.least(F.lit(9), F.floor(F.log1p(F.col(column).cast("double")) / F.col("_most") * 10)).cast("long").alias("bucket"))  # one row


def stratification(cases: DataFrame) -> DataFrame:
    """dimension, value, n: cases by class, size bucket and year, in one pass."""
    dims = ("case_class", "size_bucket", "year")
    g = cases.select(*dims).unpivot([], [F.col(d).cast("string").alias(d) for d in dims], "dimension", "value")
    return g.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def size_bucket(n: Column) -> Column:
    return F.when(n <= 5, "small").when(n <= 20, "medium").otherwise("large")


def case_index(edges: DataFrame) -> DataFrame:
    """case_id, start, end, n_edges, n_flagged, case_class, size_bucket, year."""
    g = edges.groupBy("case_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_edges"), F.count_if("is_laundering").alias("n_flagged"))
    return g.withColumn("case_class", F.when(F.col("n_flagged") > 0, "positive").otherwise("negative")).withColumn("size_bucket", size_bucket(F.col("n_edges"))).withColumn("year", F.year("start"))


def stratified_sample(cases: DataFrame, strata: list[str], per_stratum: int, seed: str = "17") -> DataFrame:
    """The first `per_stratum` cases of each stratum in hash order."""
    w = W.partitionBy(*strata).orderBy(hash_order("case_id", seed=seed))
    return cases.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_stratum).drop("_n")


def round_robin(cases: DataFrame, stratum: str, n: int, seed: str = "17") -> DataFrame:
    """n cases dealt in turn over the strata, each in hash order."""
    w = W.partitionBy(stratum).orderBy(hash_order("case_id", seed=seed))
    return cases.withColumn("_n", F.row_number().over(w)).orderBy("_n", stratum).limit(n).drop("_n")


def assign_workers(cases: DataFrame, stratum: str, workers: int) -> DataFrame:
    """case_id, stratum, worker: hash-ordered round robin that begins at another worker in each stratum."""
    w = W.partitionBy(stratum).orderBy(hash_order("case_id"))
    offset = F.conv(F.substring(F.sha2(F.col(stratum), 256), 1, 8), 16, 10).cast("long")
    return cases.select("case_id", stratum, F.pmod(F.row_number().over(w) - 1 + offset, F.lit(workers)).alias("worker"))


PROBES = 64


def match_negatives(cases: DataFrame, per_positive: int = 1, seed: str = "17") -> DataFrame:
    """positive, negative: for each positive case the first negatives of the same size bucket whose windows overlap it.

    A bucket's negatives stand in a circle in hash order, and a positive's own hash says where it begins. It looks at
    PROBES of them, then at four times as many, until it has enough or has been all round, so no pairs of a bucket are formed
    but for positives that hardly any negative suits. The joins are by merging: kept tables look small by their files' bytes,
    and would be broadcast through the driver.
    """
    from .evaluation import numbered
    from .graph import keep

    spark = cases.sparkSession
    h = lambda c: F.sha2(F.concat_ws(":", F.lit(seed), c), 256)
    neg = cases.where("n_flagged = 0").select(F.col("case_id").alias("negative"), "size_bucket", F.col("start").alias("ns"), F.col("end").alias("ne"), h("case_id").alias("h"))
    neg = keep(numbered(neg, "size_bucket", "h", "negative").drop("h"), spark)
    rings = keep(neg.groupBy("size_bucket").agg(F.min("k").alias("first"), F.count("*").alias("n")), spark)
    pos = cases.where("n_flagged > 0").select(F.col("case_id").alias("positive"), "size_bucket", F.col("start").alias("ps"), F.col("end").alias("pe")).join(F.broadcast(rings), "size_bucket")  # a row a bucket
    begin = F.conv(F.substring(h("positive"), 1, 15), 16, 10).cast("long") % F.col("n")
    open_ = keep(pos.withColumn("begin", begin).withColumn("have", F.lit(0).cast("long")), spark)
    found, low, high = None, 0, PROBES
    while open_.take(1):
        asked = open_.where(F.col("n") > low).withColumn("turn", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), F.col("n")) - 1)))
        hit = asked.withColumn("k", F.col("first") + (F.col("begin") + F.col("turn")) % F.col("n")).join(neg.drop("size_bucket").hint("merge"), "k").where(overlaps("ps", "pe", "ns", "ne"))
        new = keep(hit.select("positive", "turn", "negative", "have").withColumn("_r", F.row_number().over(W.partitionBy("positive").orderBy("turn")) + F.col("have")).where(F.col("_r") <= per_positive), spark)
        found = new.select("positive", "negative") if found is None else found.unionByName(new.select("positive", "negative"))
        got = new.groupBy("positive").agg(F.max("_r").alias("_g"))
        low, high = high, 4 * high
        open_ = keep(open_.join(got.hint("merge"), "positive", "left").withColumn("have", F.coalesce(F.col("_g").cast("long"), F.col("have"))).drop("_g").where((F.col("have") < per_positive) & (F.col("n") > low)), spark)
    return found if found is not None else pos.limit(0).select("positive", F.lit("").alias("negative"))


# --- splits -----------------------------------------------------------------------------------------

def boundary_grid(cases: DataFrame, candidates: DataFrame, shares: tuple[float, float, float] = (0.7, 0.15, 0.15), weight: float = 1.5) -> DataFrame:
    """One row: the pair of boundaries with the least score (L1 error of the split shares + weight * share of straddling cases), ties by the earlier pair.

    A case is ranged among the candidates once: its place is the first one after its start, the last one before its end
    and how many lie before its end. Only counts by place go on, so neither cases nor their pairs with candidates are
    broadcast or joined. `candidates` (column b) is a grid of a few hundred dates: it goes as one row.
    """
    from .graph import keep

    c = candidates.select("b").distinct().where("b IS NOT NULL")
    grid = c.agg(F.array_sort(F.collect_list("b")).alias("grid"))
    upto = lambda c, x: F.when(F.col(c).isNotNull(), F.size(F.filter("grid", x)).cast("long"))
    placed = cases.select("start", "end").crossJoin(F.broadcast(grid)).select(upto("start", lambda b: b <= F.col("start")).alias("lo"), upto("end", lambda b: b < F.col("end")).alias("hi"))
    # Candidates number from 0: those from lo up to hi - 1 are straddled, those from hi on are not before the end. A case without bounds is never kept.
    g = keep(placed.groupBy("lo", "hi").agg(F.count("*").alias("k")), cases.sparkSession)
    n, m = (x or 0 for x in g.agg(F.sum("k"), F.sum(F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("k")))).first())
    at = keep(grid.select(F.posexplode("grid").alias("i", "b")), cases.sparkSession)
    ends = at.join(F.broadcast(g.groupBy("hi").agg(F.sum("k").alias("k"))), F.col("hi") <= F.col("i"), "left").groupBy("i", "b").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("ended"))
    cuts = g.where("lo < hi").select("k", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"), "hi")
    over = cuts.groupBy("i").agg(F.sum("k").alias("cut"))
    stat = F.broadcast(ends.join(over, "i", "left").select("b", "ended", F.coalesce("cut", F.lit(0)).alias("cut"), "i"))
    x, y = stat.select(*[F.col(k).alias(f"{k}1") for k in ("b", "ended", "cut", "i")]), stat.select(*[F.col(k).alias(f"{k}2") for k in ("b", "ended", "cut", "i")])
    both = cuts.where("i + 1 < hi").groupBy("i", "hi").agg(F.sum("k").alias("k")).select(F.col("i").alias("i1"), "k", F.explode(F.sequence(F.col("i") + 1, F.col("hi") - 1)).alias("i2")).groupBy("i1", "i2").agg(F.sum("k").alias("twice"))
    p = x.join(y, F.col("b1") < F.col("b2")).join(both, ["i1", "i2"], "left").fillna(0, ["twice"])
    dropped = F.col("cut1") + F.col("cut2") - F.col("twice")
    train, rest = F.col("ended1"), F.lit(m) - F.col("ended2") - F.col("cut2")
    val = F.lit(m) - dropped - train - rest
    kept = F.lit(m) - dropped
    error = F.abs(train / kept - shares[0]) + F.abs(val / kept - shares[1]) + F.abs(rest / kept - shares[2])
    scored = p.where(kept > 0).select("b1", "b2", train.alias("n_train"), val.alias("n_val"), rest.alias("n_test"), F.round(error + weight * (1 - kept / n), 9).alias("score"))
    return scored.orderBy("score", "b1", "b2").limit(1)


def assign_splits(cases: DataFrame, first: Column, second: Column, buffer_hours: float = 0.0) -> DataFrame:
    """Cases with split (train, val, test; null if dropped) and drop_reason (straddles, within_buffer)."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    near = F.lit(False)
    for b in (first, second):
        near = near | (F.least(F.abs(us(F.col("start")) - us(b)), F.abs(us(F.col("end")) - us(b))) < int(buffer_hours * 3.6e9))
    reason = F.when(straddles("start", "end", first) | straddles("start", "end", second), "straddles").when(near, "within_buffer")
    split = F.when(F.col("end") <= first, "train").when(F.col("end") <= second, "val").otherwise("test")
    return cases.withColumn("drop_reason", reason).withColumn("split", F.when(F.col("drop_reason").isNull(), split))


_ORDER = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 END"


def broken_streams(members: DataFrame) -> DataFrame:
    """pattern_id, n_splits: laundering streams that lie in several splits; members: (case_id, split, pattern_id)."""
    return members.where("split IS NOT NULL").groupBy("pattern_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def enforce_atomicity(members: DataFrame) -> DataFrame:
    """case_id, split of the cases that stay when each stream lives in its earliest split alone."""
    m = members.where("split IS NOT NULL").withColumn("o", F.expr(_ORDER))
    home = m.groupBy("pattern_id").agg(F.min("o").alias("home"))
    bad = m.join(home, "pattern_id").where("o > home").select("case_id")
    return m.select("case_id", "split").distinct().join(bad, "case_id", "left_anti")


def overlap_rates(members: DataFrame) -> DataFrame:
    """split, n_nodes, n_shared, rate: accounts of val and test that also occur in train; members: (split, node_id)."""
    m = members.distinct()
    train = m.where("split = 'train'").select("node_id")
    rest = m.where("split IN ('val', 'test')")
    shared = rest.join(train, "node_id", "left_semi").groupBy("split").agg(F.count("*").alias("n_shared"))
    return rest.groupBy("split").agg(F.count("*").alias("n_nodes")).join(shared, "split", "left").select("split", "n_nodes", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), (F.coalesce("n_shared", F.lit(0)) / F.col("n_nodes")).alias("rate"))


def near_duplicate_cases(members: DataFrame, percent: int = 90, hub: int = 200) -> DataFrame:
    """a, b, common, union: pairs of cases whose account sets agree to `percent`; accounts in more than `hub` cases don't propose pairs (but count).

    Only the smallest non-hub accounts of each set that a partner must share propose (prefix filter), and sizes must fit.
    """
    m = members.select("case_id", "node_id").distinct()
    sizes = m.groupBy("case_id").agg(F.count("*").alias("n"))
    df = m.groupBy("node_id").agg(F.count("*").alias("f"))
    ranked = m.join(df, "node_id").join(sizes, "case_id").withColumn("r", F.row_number().over(W.partitionBy("case_id").orderBy("f", "node_id")))
    prefix = ranked.where((F.col("f") <= hub) & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("case_id", "node_id", "n")
    a, b = prefix.select(F.col("case_id").alias("a"), "node_id", F.col("n").alias("na")), prefix.select(F.col("case_id").alias("b"), "node_id", F.col("n").alias("nb"))
    pairs = a.join(b, "node_id").where((F.col("a") < F.col("b")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b", "na", "nb").distinct()
    x, y = m.select(F.col("case_id").alias("a"), "node_id"), m.select(F.col("case_id").alias("b"), "node_id")
    common = pairs.join(x, "a").join(y, ["b", "node_id"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return common.withColumn("union", F.col("na") + F.col("nb") - F.col("common")).where(F.col("common") * 100 >= F.col("union") * percent).select("a", "b", "common", "union")


def audit(cases: DataFrame, members: DataFrame) -> DataFrame:
    """check, n_violations, passed: six checks of a split; cases: (case_id, split, start, end, n_edges, n_flagged, hash), members: (case_id, split, node_id, pattern_id)."""
    s = cases.where("split IS NOT NULL")
    bounds = s.groupBy("split").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).withColumn("o", F.expr(_ORDER))
    later = bounds.select(F.col("o").alias("o2"), F.col("lo").alias("lo2"))
    checks = [
        bounds.join(later, F.col("o2") == F.col("o") + 1).where("lo2 < hi").agg(F.count("*").alias("n")).withColumn("check", F.lit("temporal_order")),
        s.groupBy("case_id").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("case_in_two_splits")),
        broken_streams(members.where("pattern_id IS NOT NULL")).agg(F.count("*").alias("n")).withColumn("check", F.lit("stream_atomicity")),
        s.groupBy("hash").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("exact_duplicates")),
        s.groupBy((F.col("n_flagged") > 0).alias("y")).agg(F.min("n_edges").alias("lo"), F.max("n_edges").alias("hi")).agg((F.max("lo") > F.min("hi")).cast("long").alias("n")).withColumn("check", F.lit("label_leakage_n_edges")),
        members.where("split = 'test'").select("case_id", "node_id").distinct().join(members.where("split = 'train'").select("node_id").distinct(), "node_id", "left_semi").agg(F.countDistinct("case_id").alias("n")).withColumn("check", F.lit("test_cases_sharing_accounts")),
    ]
    return reduce(DataFrame.unionByName, [c.select("check", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_violations")) for c in checks]).withColumn("passed", F.col("n_violations") == 0)


def structural_hash(members: DataFrame) -> DataFrame:
    """case_id, hash: 16 hex digits of sha256 over the sorted account ids."""
    return members.groupBy("case_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("node_id")), ","), 256), 1, 16).alias("hash"))


def stream_windows(edges: DataFrame) -> DataFrame:
    """pattern_id, first_ts, last_ts, centre (median time, whole microseconds), n."""
    m = F.unix_micros(F.col("ts").cast("timestamp"))
    g = edges.where("pattern_id IS NOT NULL").groupBy("pattern_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.percentile(m, 0.5).alias("p"), F.count("*").alias("n"))
    return g.select("pattern_id", "first_ts", "last_ts", F.timestamp_micros(F.floor("p")).cast("timestamp_ntz").alias("centre"), "n")


def partition_negatives(candidates: DataFrame, wanted: int, share: float = 0.3, least: float = 0.5, seed: str = "17") -> DataFrame:
    """case_id, kind (`hard`, `easy`) of licit candidates (case_id, window_start, window_end, motif_score): of each window the
    best-scored share is hard, if scored `least` or more; of the hard ones at most that share of `wanted` is kept, and easy
    ones fill up, both in hash order."""
    w = W.partitionBy("window_start", "window_end")
    r = candidates.withColumn("_k", F.row_number().over(w.orderBy(F.desc("motif_score"), "case_id"))).withColumn("_q", F.bround(F.count("*").over(w) * share))
    kind = F.when((F.col("_k") <= F.col("_q")) & (F.col("motif_score") >= least), "hard").otherwise("easy")
    r = r.select("case_id", kind.alias("kind"), F.sha2(F.concat_ws(":", F.lit(seed), "case_id"), 256).alias("_h"))
    most = round(wanted * share)
    hard = r.where("kind = 'hard'").orderBy("_h", "case_id").limit(most)
    n_hard = hard.count()
    easy = r.where("kind = 'easy'").orderBy("_h", "case_id").limit(max(wanted - n_hard, 0))
    return hard.unionByName(easy).select("case_id", "kind")


def strict_splits(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """case_id, split, drop_reason: test cases that share an account (case_id, node_id) with a training case go."""
    j = assigned.where("split IS NOT NULL").select("case_id", "split").join(members, "case_id")
    seen = j.where("split = 'train'").select("node_id").distinct()
    hit = j.where("split = 'test'").join(seen, "node_id", "left_semi").select("case_id").distinct().withColumn("_o", F.lit(True))
    o = assigned.join(hit, "case_id", "left")
    return o.select("case_id", F.when(F.col("_o").isNull(), F.col("split")).alias("split"), F.when(F.col("_o"), "node_overlap_strict").otherwise(F.col("drop_reason")).alias("drop_reason"))


def probe_active(pool: DataFrame, windows: DataFrame, probes: int = 32, seed: str = "17") -> DataFrame:
    """window_id, node_id: of the `probes` first accounts of each window's bucket by hash the first that is active in the window.

    pool: (bucket, node_id, first_seen, last_seen), windows: (window_id, bucket, start, end). A bucket's probes are drawn once
    for each window from the bucket's own order, begun at a place that the window's hash gives.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), "node_id"), 256)
    ranked = pool.withColumn("_k", F.row_number().over(W.partitionBy("bucket").orderBy(h, "node_id")) - 1).withColumn("_n", F.count("*").over(W.partitionBy("bucket")))
    sizes = ranked.groupBy("bucket").agg(F.max("_n").alias("_n"))
    asked = windows.join(sizes, "bucket").withColumn("_at", F.explode(F.sequence(F.lit(0), F.least(F.lit(probes), F.col("_n")).cast("int") - 1)))
    asked = asked.withColumn("_k", F.pmod(F.xxhash64("window_id") % F.col("_n") + F.col("_at"), F.col("_n")))
    j = asked.join(ranked.drop("_n"), ["bucket", "_k"]).where((F.col("first_seen") <= F.col("end")) & (F.col("start") <= F.col("last_seen")))
    return j.groupBy("window_id").agg(F.min_by("node_id", "_at").alias("node_id"))


def gold_sample(cases: DataFrame, quotas: dict[str, int], seed: str = "17") -> tuple[DataFrame, DataFrame]:
    """(case_id, block, rank) of the first cases of each block by hash order, and (block, wanted, found, deficit)."""
    want = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    r = cases.where(want[F.col("block")].isNotNull()).select("case_id", "block", F.row_number().over(W.partitionBy("block").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "case_id"), 256), "case_id")).alias("rank"))
    drawn = r.where(F.col("rank") <= want[F.col("block")])
    asked = cases.sparkSession.createDataFrame(list(quotas.items()), "block string, wanted int")
    n = asked.join(drawn.groupBy("block").agg(F.count("*").alias("found")), "block", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return drawn, n.withColumn("deficit", F.greatest(F.col("wanted") - F.col("found"), F.lit(0)))


def gate_findings(cases: DataFrame, assigned: DataFrame, least_hard: float = 0.2, least_split: float = 0.05) -> DataFrame:
    """gate, value, passed: the share of hard negatives, and the smallest split's share of the cases kept."""
    hard = cases.where("case_class <> 'positive'").agg(F.avg((F.col("case_class") == "hard_negative").cast("double")).alias("value")).select(F.lit("hard_negatives").alias("gate"), "value", (F.col("value") >= least_hard).alias("passed"))
    n = assigned.where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"))
    split = n.agg((F.min("n") / F.sum("n")).alias("value")).select(F.lit("smallest_split").alias("gate"), "value", (F.col("value") >= least_split).alias("passed"))
    return hard.unionByName(split)


def chosen_annotation(annotations: DataFrame, reviews: DataFrame) -> DataFrame:
    """One annotation (case_id, annotator, ...) for each case: the only one, or the one whose annotator the review (case_id, chosen) names."""
    n = annotations.withColumn("_n", F.count("*").over(W.partitionBy("case_id"))).join(reviews.select("case_id", "chosen"), "case_id", "left")
    return n.where((F.col("_n") == 1) | (F.col("annotator") == F.col("chosen"))).drop("_n", "chosen")


def candidates_for(facts: DataFrame, cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with their case's class, of the split's ids alone."""
    return facts.join(cases.select("case_id", "case_class"), "case_id").join(ids.select("case_id").distinct(), "case_id", "left_semi")
