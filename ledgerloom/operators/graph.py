"""Account graph: node table, statistics, integrity, components, bounded cuts. A directed multigraph with self-loops kept."""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"
"""Amounts are added as decimals: sums of doubles depend on their order."""


def total(column: str):
    return F.sum(F.col(column).cast(MONEY)).cast("double")


def node_table(edges: DataFrame) -> DataFrame:
    """One row per account: in and out degree (transfers, loops included), totals, first and last time seen.

    Each side is aggregated before the two meet in a full outer join, so only one row per account and side is shuffled twice.
    """
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"), total("amount_paid").alias("total_sent"), F.min("ts").alias("first_out"), F.max("ts").alias("last_out"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"), total("amount_received").alias("total_received"), F.min("ts").alias("first_in"), F.max("ts").alias("last_in"))
    both = out.join(into, "node_id", "full")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return both.select("node_id", F.split_part("node_id", F.lit("|"), F.lit(1)).alias("bank"), zero("in_degree", 0).alias("in_degree"), zero("out_degree", 0).alias("out_degree"), (zero("in_degree", 0) + zero("out_degree", 0)).alias("degree"), zero("total_received", 0.0).alias("total_received"), zero("total_sent", 0.0).alias("total_sent"), F.least("first_out", "first_in").alias("first_seen"), F.greatest("last_out", "last_in").alias("last_seen"))


def attach_typologies(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges with pattern_id and typology: the first pattern by id of an edge's key; flagged edges without one are `unclassified`."""
    first = patterns.withColumn("_n", F.row_number().over(W.partitionBy("transaction_key").orderBy("pattern_id"))).where("_n = 1").select("transaction_key", F.col("pattern_id").alias("_p"), F.col("typology").alias("_t"))
    joined = edges.drop("pattern_id", "typology").join(first, "transaction_key", "left")
    return joined.withColumn("pattern_id", F.col("_p")).withColumn("typology", F.when(F.col("is_laundering"), F.coalesce("_t", F.lit("unclassified")))).drop("_p", "_t")


def typology_counts(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """typology, n_transactions: pattern rows by typology, and flagged transactions that no pattern holds."""
    known = patterns.groupBy("typology").agg(F.count("*").alias("n_transactions"))
    rest = edges.where("is_laundering").join(patterns, "transaction_key", "left_anti").agg(F.count("*").alias("n_transactions"))
    return known.unionByName(rest.select(F.lit("unclassified").alias("typology"), "n_transactions"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, min, max, mean, sample standard deviation and nearest-rank quantiles of one column."""
    q = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast(df.schema[column].dataType).alias(n) for n, p in (("p50_nearest_rank", 0.5), ("p90_nearest_rank", 0.9), ("p99_nearest_rank", 0.99), ("p999_nearest_rank", 0.999))]
    return df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), *q)


def structural_statistics(edges: DataFrame) -> DataFrame:
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.agg(F.sum("n").alias("n_edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("n_self_loops"), F.count("*").alias("n_distinct_pairs"), F.count_if(F.col("n") > 1).alias("n_multi_pairs"), F.max("n").alias("max_parallel"))


def temporal_statistics(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000).alias("span_days"), F.countDistinct("ts").alias("n_timestamps"), F.countDistinct(F.second("ts")).alias("n_seconds"), F.countDistinct(F.minute("ts")).alias("n_minutes"))


def class_balance(edges: DataFrame) -> DataFrame:
    n, k = F.count("*"), F.count_if("is_laundering")
    return edges.agg(n.alias("n_edges"), k.alias("n_flagged"), (k / n).alias("share"), F.when(k > 0, F.floor(n / k)).alias("one_in"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """side, node_id, n: endpoints that the node table lacks; empty where the graph is sound."""
    ends = [edges.groupBy(F.col(c).alias("node_id")).agg(F.count("*").alias("n")).select(F.lit(c).alias("side"), "node_id", "n") for c in ("src", "dst")]
    return reduce(DataFrame.unionByName, ends).join(nodes.select("node_id"), "node_id", "left_anti").select("side", "node_id", "n")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (two semi joins; the node list may be of any size)."""
    ends = nodes.select("node_id").distinct()
    return edges.join(ends, F.col("src") == F.col("node_id"), "left_semi").join(ends, F.col("dst") == F.col("node_id"), "left_semi")


def subgraph_labels(memberships: DataFrame) -> DataFrame:
    """subgraph_id, label (null where its members' labels conflict), n_nodes, n_labels."""
    return memberships.groupBy("subgraph_id").agg(F.when(F.min("label") == F.max("label"), F.min("label")).alias("label"), F.countDistinct("node_id").alias("n_nodes"), F.countDistinct("label").alias("n_labels"))


def positive_seeds(edges: DataFrame, per_stream: int = 12) -> DataFrame:
    """pattern_id, node_id, n: the busiest accounts of each laundering stream, at most `per_stream` (ties by id)."""
    hit = edges.where("pattern_id IS NOT NULL")
    ends = hit.select("pattern_id", F.col("src").alias("node_id")).unionAll(hit.select("pattern_id", "dst"))
    g = ends.groupBy("pattern_id", "node_id").agg(F.count("*").alias("n"))
    return g.withColumn("_k", F.row_number().over(W.partitionBy("pattern_id").orderBy(F.desc("n"), "node_id"))).where(F.col("_k") <= per_stream).drop("_k")


def reference_check(edges: DataFrame, facts: DataFrame, store: str) -> DataFrame:
    """graph_ref, stored_nodes, stored_edges, n_edges, resolves: stored cases against (case_id, n_edges) of their facts; either side may lack a case."""
    n = edges.select("case_id", F.col("src").alias("v")).union(edges.select("case_id", "dst")).distinct().groupBy("case_id").agg(F.count("*").alias("stored_nodes"))
    e = edges.groupBy("case_id").agg(F.count("*").alias("stored_edges"))
    j = n.join(e, "case_id").join(facts.select("case_id", "n_edges"), "case_id", "full")
    return j.select(F.concat(F.lit(f"{store}#"), "case_id").alias("graph_ref"), "stored_nodes", "stored_edges", "n_edges", F.coalesce(F.col("stored_edges") == F.col("n_edges"), F.lit(False)).alias("resolves"))


def compare_to_published(observed: DataFrame, published: dict[str, float]) -> DataFrame:
    """name, observed, published, delta."""
    p = F.create_map(*[F.lit(x) for kv in published.items() for x in kv])[F.col("name")]
    return observed.select("name", "observed", p.alias("published"), (F.col("observed") - p).alias("delta"))


def realistic_stream(nodes: DataFrame, n: int, seed: str = "17") -> DataFrame:
    """Accounts drawn evenly from the active ones, in hash order: a population with its own prevalence."""
    return nodes.where("degree > 0").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "node_id"), 256)).limit(n)


def expand(edges: DataFrame, seeds: DataFrame, k: int = 2, cap: int = 64) -> DataFrame:
    """case_id, node_id, depth: accounts within k hops of each seed (case_id, node_id, start, end), in the closed window.

    From every frontier account at most `cap` incident edges are followed (flagged first, then by amount, then by key),
    which is what bounds a hub; the frontier moves by joins, one per hop.
    """
    both = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "ts", "amount_paid", "is_laundering", "transaction_key").unionByName(edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "ts", "amount_paid", "is_laundering", "transaction_key"))
    reached = seeds.select("case_id", "node_id", "start", "end", F.lit(0).alias("depth"))
    frontier = reached
    for depth in range(1, k + 1):
        near = frontier.join(both, F.col("node_id") == F.col("here")).where(F.col("ts").between(F.col("start"), F.col("end")))
        order = W.partitionBy("case_id", "here").orderBy(F.desc("is_laundering"), F.desc("amount_paid"), "transaction_key", "there")
        kept = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
        new = kept.select("case_id", F.col("there").alias("node_id"), "start", "end").distinct().join(reached.select("case_id", "node_id"), ["case_id", "node_id"], "left_anti")
        frontier = new.withColumn("depth", F.lit(depth)).select("case_id", "node_id", "start", "end", "depth")
        reached = reached.unionByName(frontier)
    return reached.select("case_id", "node_id", "depth")


def prune(case_edges: DataFrame, n_max: int = 150) -> DataFrame:
    """Edges kept of each case: protected (flagged) ones first, then by amount (none last), then by key, while their new endpoints fit in n_max accounts.

    The decision depends on all earlier ones, but only through the accounts that are in and since when: the flagged edges'
    from the beginning; while two more fit, others as they are first met; into a last place comes the first account
    that is alone new on its edge. An edge is kept if both of its accounts are in by then. A case whose flagged edges
    have more accounts than fit keeps no other edge. So cases of any size are worked on by aggregation, and at most
    n_max accounts of a case meet its edges.
    """
    spark = case_edges.sparkSession
    amount = F.coalesce(-F.col("amount_paid").cast("double"), F.lit(float("nan")))
    flagged = F.coalesce("is_laundering", F.lit(False))
    e = case_edges.withColumn("_at", F.struct(F.col("is_laundering").isNull().alias("no"), amount.alias("less"), F.col("transaction_key").alias("key"), F.col("src").alias("src"), F.col("dst").alias("dst")))
    never = F.lit(None).cast(e.schema["_at"].dataType)

    def ends(df: DataFrame) -> DataFrame:
        return df.select("case_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v"), "_at").groupBy("case_id", "v").agg(F.min("_at").alias("_at"))

    def same(*columns: str):
        return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])

    def known(df: DataFrame, have: DataFrame, end: str, how: str) -> DataFrame:
        """With `_in_<end>`: since when the account is in, and whether it is."""
        h = have.select(F.col("case_id").alias("_case_id"), F.col("v").alias(f"_{end}"), F.struct(F.col("_at").alias("since")).alias(f"_in_{end}"))
        h = h.hint("merge")  # n_max accounts a case, which grow with the cases: not for the driver
        return df.join(h, same("case_id", end), how).drop("_case_id", f"_{end}")

    have = keep(ends(e.where(flagged)).withColumn("_at", never), spark)
    full = have.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > n_max).select(F.col("case_id").alias("_case_id"))
    some = keep(e.where(~flagged).select("case_id").distinct().join(full, same("case_id"), "left_anti"), spark)
    if not some.take(1):
        return case_edges.where(flagged)
    have = keep(have.join(some.withColumnRenamed("case_id", "_case_id"), same("case_id"), "left_semi"), spark)
    room = keep(some.join(have.groupBy(F.col("case_id").alias("_case_id")).agg(F.count("*").alias("n")), same("case_id"), "left").select("case_id", (n_max - F.coalesce("n", F.lit(0))).alias("room")), spark)
    open_ = room.withColumnRenamed("case_id", "_case_id")
    rest = e.where(~flagged).join(open_, same("case_id")).drop("_case_id")
    # Accounts by first sight; those of one edge come together, and come in while two more fit before it.
    fresh = known(ends(rest), have, "v", "left").where("_in_v IS NULL").select("case_id", "v", "_at")
    order = W.partitionBy("case_id").orderBy("_at")
    seen = fresh.withColumn("_n", F.rank().over(order)).where(F.col("_n") <= n_max).join(open_, same("case_id")).where(F.col("room") - F.col("_n") + 1 >= 2).select("case_id", "v", "_at")
    have = keep(have.unionByName(seen), spark)
    one = keep(room.join(have.groupBy(F.col("case_id").alias("_case_id")).agg(F.count("*").alias("n")), same("case_id"), "left").where(F.coalesce("n", F.lit(0)) == n_max - 1).select("case_id"), spark)
    if one.take(1):
        last = e.where(~flagged).join(one.withColumnRenamed("case_id", "_case_id"), same("case_id"), "left_semi")
        last = known(known(last, have, "src", "left"), have, "dst", "left")
        alone = F.when(F.col("src").eqNullSafe(F.col("dst")), F.col("_in_src").isNull()).otherwise(F.col("_in_src").isNull() != F.col("_in_dst").isNull())
        new = last.where(alone).groupBy("case_id").agg(F.min(F.struct("_at", F.when(F.col("_in_src").isNull(), F.col("src")).otherwise(F.col("dst")).alias("v"))).alias("x"))
        have = keep(have.unionByName(new.select("case_id", "x.v", "x._at")), spark)
    rest = e.where(~flagged).join(some.withColumnRenamed("case_id", "_case_id"), same("case_id"), "left_semi")
    in_ = known(known(rest, have, "dst", "inner"), have, "src", "inner")
    since = lambda end: F.col(f"_in_{end}.since").isNull() | (F.col(f"_in_{end}.since") <= F.col("_at"))
    return e.where(flagged).select(*case_edges.columns).unionByName(in_.where(since("src") & since("dst")).select(*case_edges.columns))


def weak_components(edges: DataFrame) -> DataFrame:
    """node_id, component (smallest account id that edges reach).

    First over few edges, those to each account's smallest and largest neighbour on either side. All others are then
    looked at once: those between components are a smaller graph of the same kind.
    """
    spark = edges.sparkSession
    pairs = keep(edges.select("src", "dst"), spark)
    out = pairs.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    into = pairs.groupBy("dst").agg(F.min("src").alias("a"), F.max("src").alias("b"))
    few = out.select("src", F.explode(F.array("a", "b")).alias("dst")).union(into.select(F.explode(F.array("a", "b")), "dst"))
    labels = _spread(few, spark)
    there = labels.select(F.col("node_id").alias("dst"), F.col("component").alias("b"))
    here = labels.select(F.col("node_id").alias("src"), F.col("component").alias("a"))
    # An account meets few components, so most of this falls together before it moves.
    met = pairs.join(there, "dst").select("src", "b").distinct()
    between = keep(met.join(here, "src").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), spark)
    if not between.take(1):
        return labels
    joined = weak_components(between).select(F.col("node_id").alias("component"), F.col("component").alias("_c"))
    return labels.join(joined, "component", "left").select("node_id", F.coalesce("_c", "component").alias("component"))


def _spread(edges: DataFrame, spark) -> DataFrame:
    """The components of few edges: labels spread and chains are halved until nothing moves."""
    ends = edges.select("src", "dst").where("src <> dst")
    both = keep(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), spark)
    labels = keep(edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct().withColumn("component", F.col("node_id")), spark)
    while True:
        near = both.join(labels, both["dst"] == labels["node_id"]).groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("_c"))
        step = labels.join(near, "node_id", "left").select("node_id", F.col("component").alias("_old"), F.least("component", "_c").alias("_new"))
        above = labels.select(F.col("node_id").alias("_new"), F.col("component").alias("_up"))
        nxt = keep(step.join(above, "_new").select("node_id", F.least("_new", "_up").alias("component"), (F.least("_new", "_up") != F.col("_old")).alias("_moved")), spark)
        labels = nxt.select("node_id", "component")
        if not nxt.where("_moved").take(1):
            return labels


def keep(df: DataFrame, spark) -> DataFrame:
    """Cuts the lineage by a table in the shared checkpoint folder."""
    from ..sources.stores import scratch_table

    return scratch_table(spark, df)


def release(spark) -> None:
    """Shuffle files of tables that are written go when the driver collects garbage, which may be long after; here it is asked to."""
    gc.collect()
    spark._jvm.System.gc()
