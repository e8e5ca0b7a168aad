"""A rating study: blinded balanced allocation, checks of a design, keep-latest ratings, reliability, per-system results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build_design(raters: DataFrame, cases: DataFrame, systems: list[str], rounds: int, salt: str, repeat_share: float = 0.05) -> DataFrame:
    """rater, case_id, system, position, item_id, is_repeat. raters (rater, index from 0); each meets a case once.

    A rater's cases are drawn by hash. Items come in rounds of one per system; in round i the order is row (rater + i) of
    a cyclic Latin square, so every system meets every place equally often. A share of items comes again at the end.
    """
    k = len(systems)
    w = W.partitionBy("rater").orderBy(F.sha2(F.concat_ws(":", F.lit(salt), "rater", "case_id"), 256))
    drawn = raters.crossJoin(cases.select("case_id").distinct()).withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < rounds * k)  # a panel is some tens of people
    place = F.pmod(F.col("index") + F.floor(F.col("position") / k) + F.col("position") % k, F.lit(k)).cast("int")
    first = drawn.select("rater", "case_id", F.element_at(F.array(*[F.lit(s) for s in systems]), place + 1).alias("system"), F.col("position").cast("int").alias("position"), F.lit(False).alias("is_repeat"))
    n = max(1, round(rounds * k * repeat_share))
    again = first.where(F.col("position") < n).withColumn("position", F.col("position") + rounds * k).withColumn("is_repeat", F.lit(True))
    every = first.unionByName(again)
    return every.withColumn("item_id", F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "rater", "case_id", "system", F.col("is_repeat").cast("string")), 256), 1, 16))


def validate_design(design: DataFrame, systems: list[str]) -> DataFrame:
    """check, n_violations: a case twice for a rater, an item id twice, uneven systems for a rater, uneven places for a system, a repeat without its first."""
    first = design.where("NOT is_repeat")
    k = len(systems)
    spread = first.groupBy("rater", "system").agg(F.count("*").alias("n")).groupBy("rater").agg((F.max("n") - F.min("n")).alias("d"), F.count("*").alias("s"))
    places = first.groupBy("system", (F.col("position") % k).alias("place")).agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n")).alias("d"), F.count("*").alias("s"))
    raters = first.select("rater").distinct().count()
    checks = [
        (first.groupBy("rater", "case_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_violations")), "case_twice"),
        (design.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_violations")), "item_id_twice"),
        (spread.where(f"d > 0 OR s < {k}").agg(F.count("*").alias("n_violations")), "uneven_systems"),
        (places.where(f"d > {max(1, raters)} OR s < {k * k}").agg(F.count("*").alias("n_violations")), "uneven_places"),
        (design.where("is_repeat").join(first, ["rater", "case_id", "system"], "left_anti").agg(F.count("*").alias("n_violations")), "repeat_without_first"),
    ]
    out = None
    for d, name in checks:
        row = d.select(F.lit(name).alias("check"), "n_violations")
        out = row if out is None else out.unionByName(row)
    return out


def intra_rater(ratings: DataFrame) -> DataFrame:
    """rater, n, mean_gap, exact: repeats against the first rating of the same (rater, case, system)."""
    first = ratings.where("NOT is_repeat").select("rater", "case_id", "system", F.col("score").alias("s0"))
    j = ratings.where("is_repeat").join(first, ["rater", "case_id", "system"])
    return j.groupBy("rater").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("s0"))).alias("mean_gap"), F.avg((F.col("score") == F.col("s0")).cast("double")).alias("exact"))


def system_means(ratings: DataFrame) -> DataFrame:
    """system, mean over raters of their means, n_raters, without repeats."""
    r = ratings.where("NOT is_repeat").groupBy("rater", "system").agg(F.avg("score").alias("m"))
    return r.groupBy("system").agg(F.avg("m").alias("mean"), F.count("*").alias("n_raters"))


def active_seconds(events: DataFrame) -> DataFrame:
    """item, seconds on screen: time from open to close less the hidden stretches between blur and focus, never below 0. Events: (item, at seconds, kind open, blur, focus, close)."""
    w = W.partitionBy("item").orderBy("at")
    e = events.withColumn("next", F.lead("at").over(w))
    gone = F.sum(F.when(F.col("kind") == "blur", F.col("next") - F.col("at")))
    return e.groupBy("item").agg(F.greatest(F.lit(0.0), F.max("at") - F.min("at") - F.coalesce(gone, F.lit(0.0))).alias("seconds"))
