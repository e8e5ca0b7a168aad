"""Facts per case: flow by currency, structure, time, counterparties, motifs, roles.

A fact that can't be had is not a null: it is a struct (available, reason, value), and the reason says why.
A null value under available = true is a measured null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import MONEY, keep, release, total

#: Reasons of unavailable facts.
MULTI_CURRENCY = "multi_currency_aggregate_undefined"
NO_TRANSFERS = "no_transfers_in_this_direction"
OUTFLOW_EXCEEDS = "outflow_exceeds_inflow_within_window"


def sentinel(reason: Column, value: Column) -> Column:
    """A tagged fact: available where there is no reason against it."""
    return F.struct(reason.isNull().alias("available"), reason.alias("reason"), F.when(reason.isNull(), value).alias("value"))


def flatten(df: DataFrame, *names: str) -> DataFrame:
    """Tagged columns as name and name_reason."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *[x for n in names for x in (F.col(f"{n}.value").alias(n), F.col(f"{n}.reason").alias(f"{n}_reason"))])


def focal(edges: DataFrame) -> DataFrame:
    """Edges of each case seen from its focal account: direction, other account, amount, currency. Loops are left out."""
    own = F.split_part("case_id", F.lit("/"), F.lit(1))
    e = edges.where("src <> dst").withColumn("focal", own)
    return e.withColumn("direction", F.when(F.col("src") == F.col("focal"), "out").when(F.col("dst") == F.col("focal"), "in"))


def flow_by_currency(edges: DataFrame, key: str = "case_id") -> DataFrame:
    """key, direction, currency, value, n_transfers. Inflow counts what was received, outflow what was paid; currencies never add up."""
    out = edges.select(key, F.lit("out").alias("direction"), F.col("payment_currency").alias("currency"), F.col("amount_paid").alias("amount"))
    into = edges.select(key, F.lit("in").alias("direction"), F.col("receiving_currency").alias("currency"), F.col("amount_received").alias("amount"))
    return out.unionByName(into).groupBy(key, "direction", "currency").agg(total("amount").alias("value"), F.count("*").alias("n_transfers"))


def account_flow(edges: DataFrame) -> DataFrame:
    """node_id, total_in, total_out, max_in, max_out, retained as tagged facts, from one pass over both directions."""
    out = edges.select(F.col("src").alias("node_id"), F.lit("out").alias("d"), F.col("payment_currency").alias("c"), F.col("amount_paid").alias("v"))
    into = edges.select(F.col("dst").alias("node_id"), F.lit("in").alias("d"), F.col("receiving_currency").alias("c"), F.col("amount_received").alias("v"))
    side = lambda d, x: F.when(F.col("d") == d, x)
    aggs = []
    for d in ("in", "out"):
        aggs += [F.count(side(d, F.lit(1))).alias(f"n_{d}"), F.min(side(d, F.col("c"))).alias(f"lo_{d}"), F.max(side(d, F.col("c"))).alias(f"hi_{d}"), F.sum(side(d, F.col("v").cast(MONEY))).cast("double").alias(f"sum_{d}"), F.max(side(d, F.col("v"))).alias(f"max_{d}")]
    g = out.unionByName(into).groupBy("node_id").agg(*aggs)
    why = lambda d: F.when(F.col(f"n_{d}") == 0, NO_TRANSFERS).when(F.col(f"lo_{d}") != F.col(f"hi_{d}"), MULTI_CURRENCY)
    whole = (F.col("n_in") > 0) & (F.col("n_out") > 0) & (F.col("lo_in") == F.col("hi_in")) & (F.col("lo_out") == F.col("hi_out")) & (F.col("lo_in") == F.col("lo_out"))
    kept = F.col("sum_in") - F.col("sum_out")
    no = F.when(~F.coalesce(whole, F.lit(False)), MULTI_CURRENCY).when(kept < 0, OUTFLOW_EXCEEDS)
    return g.select("node_id", sentinel(why("in"), F.col("sum_in")).alias("total_in"), sentinel(why("out"), F.col("sum_out")).alias("total_out"), sentinel(why("in"), F.col("max_in")).alias("max_in"), sentinel(why("out"), F.col("max_out")).alias("max_out"), sentinel(no, kept).alias("retained"))


def near_threshold(edges: DataFrame, currency: str, reference: float, band: float, key: str = "case_id") -> DataFrame:
    """key, n_near: payments in [reference * (1 - band), reference) in one currency."""
    hit = (F.col("payment_currency") == currency) & (F.col("amount_paid") >= reference * (1 - band)) & (F.col("amount_paid") < reference)
    return edges.groupBy(key).agg(F.count_if(hit).alias("n_near"))


def structure(edges: DataFrame, key: str = "case_id") -> DataFrame:
    """key, n_edges, n_nodes, n_self_loops, n_pairs (distinct, no loops), density, reciprocity, max_out_degree, max_in_degree.

    Degrees count distinct counterparties without loops. Pairs are formed once and all else is read from them.
    """
    pairs = edges.groupBy(key, "src", "dst").agg(F.count("*").alias("n"))
    loops = F.col("src") == F.col("dst")
    sums = pairs.groupBy(key).agg(F.sum("n").alias("n_edges"), F.coalesce(F.sum(F.when(loops, F.col("n"))), F.lit(0)).alias("n_self_loops"), F.count_if(~loops).alias("n_pairs"))
    nodes = pairs.select(key, F.col("src").alias("v")).union(pairs.select(key, "dst")).distinct().groupBy(key).agg(F.count("*").alias("n_nodes"))
    plain = pairs.where(~loops).select(key, "src", "dst")
    back = plain.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = plain.join(back, [key, "src", "dst"], "left_semi").groupBy(key).agg(F.count("*").alias("n_mutual"))
    outs = plain.groupBy(key, "src").agg(F.count("*").alias("d")).groupBy(key).agg(F.max("d").alias("max_out_degree"))
    ins = plain.groupBy(key, "dst").agg(F.count("*").alias("d")).groupBy(key).agg(F.max("d").alias("max_in_degree"))
    j = sums.join(nodes, key).join(mutual, key, "left").join(outs, key, "left").join(ins, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.col("n_nodes")
    return j.select(key, "n_edges", "n_nodes", "n_self_loops", "n_pairs", F.when(n > 1, F.col("n_pairs") / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(F.col("n_pairs") > 0, z("n_mutual") / F.col("n_pairs")).otherwise(0.0).alias("reciprocity"), z("max_out_degree").alias("max_out_degree"), z("max_in_degree").alias("max_in_degree"))


def burst(events: DataFrame, key: str, ts: str, hours: int = 48, least: int = 5) -> DataFrame:
    """key, burst_n, burst_start, burst_span_hours: the fullest window of `hours` that ends at an event; of equals the shortest, then the earliest. Keys with fewer than `least` events in any window are left out."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(key, F.col(ts).alias("t"), micros.alias("_m"))
    w = W.partitionBy(key).orderBy("_m").rangeBetween(-hours * 3_600_000_000, 0)
    e = e.withColumn("burst_n", F.count("*").over(w)).withColumn("burst_start", F.min("t").over(w)).withColumn("_span", F.col("_m") - F.min("_m").over(w))
    best = e.where(F.col("burst_n") >= least).groupBy(key).agg(F.min(F.struct((-F.col("burst_n")).alias("n"), "_span", "burst_start")).alias("b"))
    return best.select(key, (-F.col("b.n")).alias("burst_n"), F.col("b.burst_start").alias("burst_start"), (F.col("b._span") / 3.6e9).alias("burst_span_hours"))


def phases(edges: DataFrame, key: str, out_if: Column) -> DataFrame:
    """key, phase: whether inflow ends before outflow begins, the reverse, or they mix; ends that touch count as ordered."""
    g = edges.groupBy(key).agg(F.min(F.when(out_if, F.col("ts"))).alias("o1"), F.max(F.when(out_if, F.col("ts"))).alias("o2"), F.min(F.when(~out_if, F.col("ts"))).alias("i1"), F.max(F.when(~out_if, F.col("ts"))).alias("i2"))
    return g.select(key, F.when(F.col("o1").isNull(), "inflow_only").when(F.col("i1").isNull(), "outflow_only").when(F.col("i2") <= F.col("o1"), "inflow_then_outflow").when(F.col("o2") <= F.col("i1"), "outflow_then_inflow").otherwise("interleaved").alias("phase"))


def extent(edges: DataFrame, key: str = "case_id") -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return edges.groupBy(key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((us(F.max("ts")) - us(F.min("ts"))) / 3.6e9).alias("span_hours"), F.count("*").alias("n_edges"))


def flagged_nodes(edges: DataFrame) -> DataFrame:
    hit = edges.where("is_laundering")
    return hit.select(F.col("src").alias("node_id")).union(hit.select("dst")).distinct()


def flagged_nodes_of(edges: DataFrame, key: str) -> DataFrame:
    """key, node_id: accounts on a case's flagged edges."""
    hit = edges.where("is_laundering")
    return hit.select(key, F.col("src").alias("node_id")).union(hit.select(key, "dst")).distinct()


def counterparties(edges: DataFrame) -> DataFrame:
    """node_id, n_illicit, n_licit: distinct accounts beside each account, by whether any flagged transfer touches them."""
    plain = edges.where("src <> dst")
    near = plain.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(plain.select("dst", "src")).distinct()
    flagged = flagged_nodes(edges).select(F.col("node_id").alias("other"), F.lit(True).alias("hit"))
    return near.join(flagged, "other", "left").groupBy("node_id").agg(F.count("hit").alias("n_illicit"), F.count_if(F.col("hit").isNull()).alias("n_licit"))


def illicit_inflow_share(edges: DataFrame) -> DataFrame:
    """node_id, share: flagged part of what an account received, as a tagged fact (one currency only)."""
    g = edges.groupBy(F.col("dst").alias("node_id")).agg(F.min("receiving_currency").alias("lo"), F.max("receiving_currency").alias("hi"), F.sum(F.col("amount_received").cast(MONEY)).cast("double").alias("v"), F.coalesce(F.sum(F.when(F.col("is_laundering"), F.col("amount_received").cast(MONEY))), F.lit(0).cast(MONEY)).cast("double").alias("k"))
    why = F.when(F.col("lo") != F.col("hi"), MULTI_CURRENCY).when(F.col("v") <= 0, NO_TRANSFERS)
    return g.select("node_id", sentinel(why, F.col("k") / F.col("v")).alias("share"))


def hops_to_flagged(edges: DataFrame) -> DataFrame:
    """node_id, hops: least number of undirected hops to an account on a flagged edge; null where there is no way to one.

    One join per hop from the last frontier, each written; it ends when no account is new.
    """
    spark = edges.sparkSession
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    both = keep(plain.union(plain.select("dst", "src")).distinct(), spark)
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    front = seen = keep(flagged_nodes(edges).withColumn("hops", F.lit(0)), spark)
    while front.take(1):
        step = both.join(front.select(F.col("node_id").alias("src"), "hops"), "src").select(F.col("dst").alias("node_id"), (F.col("hops") + 1).alias("hops")).distinct()
        front = keep(step.join(seen.select("node_id"), "node_id", "left_anti"), spark)
        seen = seen.unionByName(front)
    return nodes.join(seen, "node_id", "left")


HUB = 5
"""Distinct counterparties on both sides that make a hub."""


def counterparty_counts(edges: DataFrame, *key: str) -> DataFrame:
    """key, node_id, n_senders, n_receivers, n_others: distinct counterparties without loops; accounts with loops alone have 0."""
    plain = edges.where("src <> dst").select(*key, "src", "dst").distinct()
    ends = plain.select(*key, F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(plain.select(*key, "dst", "src", F.lit(0), F.lit(1)))
    loops = edges.where("src = dst").select(*key, F.col("src").alias("node_id"), F.lit(None).cast("string").alias("other"), F.lit(0).alias("o"), F.lit(0).alias("i")).distinct()
    by = ends.union(loops).groupBy(*key, "node_id", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return by.groupBy(*key, "node_id").agg(F.sum("i").alias("n_senders"), F.sum("o").alias("n_receivers"), F.count("other").alias("n_others"))


def roles(edges: DataFrame, *key: str, hub: int = HUB) -> DataFrame:
    """key, node_id, n_senders, n_receivers, role, from distinct counterparties without loops. A hub is told before a pass-through."""
    return counterparty_counts(edges, *key).select(*key, "node_id", "n_senders", "n_receivers", role_of(F.col("n_senders"), F.col("n_receivers"), hub).alias("role"))


def role_of(i: Column, o: Column, hub: int = HUB) -> Column:
    """The role by the numbers of senders and receivers; from one and from `hub` on, larger ones don't matter."""
    return F.when((i == 0) & (o == 0), "terminal").when(i == 0, "originator").when(o == 0, "beneficiary").when(F.least(i, o) >= hub, "hub").when((i == 1) & (o == 1), "pass_through").otherwise("intermediary")


def account_summary(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """node_id (a number), n_out, n_in, total_out, total_in (tagged), first_ts, last_ts, role, kept: what node_table, account_flow and roles
    tell of an account.

    The transfers are written once, and either side of them moves once, by account; what moved for one step is let go before the next.
    Currencies are told apart by 64-bit hashes. Whether there are `hub` counterparties follows where they fall into as many
    of 63 places by hash, or are no more than the transfers; the few accounts where neither tells are counted exactly.
    """
    spark = edges.sparkSession
    edges = keep(edges.select("src", "dst", "ts", "amount_paid", "payment_currency", "amount_received", "receiving_currency"), spark)
    release(spark)
    sides = []
    for d, a, b, v, c in (("out", "src", "dst", "amount_paid", "payment_currency"), ("in", "dst", "src", "amount_received", "receiving_currency")):
        e = edges.where(F.col(a).isNotNull()).select(F.col(a).alias("node_id"), F.when(F.col(a) != F.col(b), F.col(b)).alias("other"), "ts", F.col(v).alias("v"), F.col(c).alias("c")).repartition("node_id")
        code = F.when(F.col("c").isNotNull(), F.xxhash64("c"))
        place = F.when(F.col("other").isNotNull(), F.expr("shiftleft(1L, CAST(pmod(xxhash64(other), 63) AS INT))"))
        g = e.groupBy("node_id").agg(F.count("*").alias(f"n_{d}"), F.min("ts").alias(f"first_ts_{d}"), F.max("ts").alias(f"last_ts_{d}"), F.count("other").alias(f"plain_{d}"), F.min("other").alias("a"), F.max("other").alias("b"), F.bit_or(place).alias("places"), F.min(code).alias("lo"), F.max(code).alias("hi"), F.sum(F.col("v").cast(MONEY)).cast("double").alias(f"sum_{d}"))
        least = F.when(F.col(f"plain_{d}") == 0, 0).when(F.col("a") == F.col("b"), 1).otherwise(F.greatest(F.lit(2), F.bit_count("places")))
        sides.append(keep(g.select("node_id", f"n_{d}", f"first_ts_{d}", f"last_ts_{d}", f"plain_{d}", f"sum_{d}", (F.col("lo") != F.col("hi")).alias(f"many_{d}"), least.alias(f"least_{d}")), spark))
        release(spark)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = lambda d: F.when(z(f"n_{d}") == 0, NO_TRANSFERS).when(F.col(f"many_{d}"), MULTI_CURRENCY)
    o, i = z("least_out"), z("least_in")
    open_ = (o > 1) & (i > 1) & (F.least(z("plain_out"), z("plain_in")) >= hub) & (F.least(o, i) < hub)
    told = ["node_id", "n_out", "n_in", "total_out", "total_in", "first_ts", "last_ts"]
    s = keep(sides[0].join(sides[1], "node_id", "full").select("node_id", z("n_out").alias("n_out"), z("n_in").alias("n_in"), sentinel(why("out"), F.col("sum_out")).alias("total_out"), sentinel(why("in"), F.col("sum_in")).alias("total_in"), F.least("first_ts_out", "first_ts_in").alias("first_ts"), F.greatest("last_ts_out", "last_ts_in").alias("last_ts"), o.alias("o"), i.alias("i"), open_.alias("open")), spark)
    role = s.select(*told, role_of(F.col("i"), F.col("o"), hub).alias("role"))
    unsure = s.where("open").select("node_id")
    if not unsure.take(1):
        return role
    ends = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(True).alias("out")).union(edges.select("dst", "src", F.lit(False)))
    own = ends.where("node_id <> other").join(unsure, "node_id", "left_semi").distinct()
    exact = keep(own.groupBy("node_id").agg(F.count_if("out").alias("_o"), F.count_if(~F.col("out")).alias("_i")), spark)
    return s.join(exact, "node_id", "left").select(*told, role_of(F.coalesce("_i", "i"), F.coalesce("_o", "o"), hub).alias("role"))


def select_focal(edges: DataFrame, seeds: DataFrame, key: str = "case_id") -> DataFrame:
    """key, node_id, rule: the case's seed (key, seed_node) where it takes part, else the account with most distinct counterparties, of equals the first by id."""
    own = counterparty_counts(edges, key).join(seeds.select(key, "seed_node"), key, "left")
    first = own.groupBy(key).agg(F.min(F.struct(F.when(F.col("node_id") == F.col("seed_node"), 0).otherwise(1).alias("r"), (-F.col("n_others")).alias("n"), "node_id")).alias("x"))
    return first.select(key, F.col("x.node_id").alias("node_id"), F.when(F.col("x.r") == 0, "extraction_seed").otherwise("max_degree").alias("rule"))


#: The order in which shapes that fire name a case without a known typology.
SHAPE_PRIORITY = ("gather_scatter", "scatter_gather", "cycle", "bipartite", "stack", "fan_out", "fan_in")


def resolve_typology(cases: DataFrame, known: bool) -> DataFrame:
    """typology, source, confidence, scope of cases with `typology` (of their own flagged edges) and a boolean for each shape.

    A substrate that knows typologies is believed, also where it names none; else the first shape that fires is inferred,
    the surer the more of them fire.
    """
    if known:
        return cases.withColumns({"typology": F.coalesce("typology", F.lit("unclassified")), "source": F.lit("ground_truth"), "confidence": F.lit(1.0), "scope": F.lit("stream_membership")})
    n = sum((F.col(m).cast("int") for m in SHAPE_PRIORITY), F.lit(0))
    name = F.coalesce(*[F.when(F.col(m), F.lit(m)) for m in SHAPE_PRIORITY], F.lit("unclassified"))
    sure = F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(0.9), 0.5 + 0.2 * (n - 1)), 2))
    return cases.withColumns({"typology": name, "source": F.when(n == 0, "none").otherwise("inferred"), "confidence": sure, "scope": F.lit("case_structure")})


def dominant_typology(edges: DataFrame, order: tuple[str, ...], key: str = "case_id") -> DataFrame:
    """key, typology, n: the most frequent typology of a case's flagged edges, ties by the vocabulary's order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("typology"))
    g = edges.where("typology IS NOT NULL").groupBy(key, "typology").agg(F.count("*").alias("n"))
    return g.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), rank.alias("r"), "typology")).alias("b")).select(key, F.col("b.typology").alias("typology"), (-F.col("b.m")).alias("n"))


# --- motifs -----------------------------------------------------------------------------------------

FAN = 3
TWO_SIDED = 2
"""Least widths of a fan, and of each side of the two-sided shapes."""


def widest_star(edges: DataFrame, centre: str, other: str, key: str, least: int = FAN) -> DataFrame:
    """key, present, node_id, width, window_hours: the account with most distinct counterparties on one side (of equals the
    first by id) and the span of the transfers that form its star; null where none reaches `least`."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = edges.groupBy(key, F.col(centre).alias("node_id")).agg(F.countDistinct(F.when(F.col("src") != F.col("dst"), F.col(other))).alias("width"), ((F.max(F.when(F.col("src") != F.col("dst"), us)) - F.min(F.when(F.col("src") != F.col("dst"), us))) / 3.6e9).alias("h"))
    x = g.groupBy(key).agg(F.min(F.struct((-F.col("width")).alias("w"), "node_id", "h")).alias("b"))
    there = -F.col("b.w") >= least
    return x.select(key, there.alias("present"), F.when(there, F.col("b.node_id")).alias("node_id"), F.when(there, -F.col("b.w")).alias("width"), F.when(there, F.col("b.h")).alias("window_hours"))


def fan_out(edges: DataFrame, key: str = "case_id") -> DataFrame:
    return widest_star(edges, "src", "dst", key)


def fan_in(edges: DataFrame, key: str = "case_id") -> DataFrame:
    return widest_star(edges, "dst", "src", key)


def gather_scatter(edges: DataFrame, key: str) -> DataFrame:
    """key, node_id, width: the hub with the largest smaller side of distinct senders and receivers."""
    plain = edges.where("src <> dst")
    ins = plain.groupBy(key, F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("i"))
    outs = plain.groupBy(key, F.col("src").alias("node_id")).agg(F.countDistinct("dst").alias("o"))
    g = ins.join(outs, [key, "node_id"]).withColumn("w", F.least("i", "o"))
    return g.where(F.col("w") >= TWO_SIDED).groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), "node_id")).alias("b")).select(key, F.col("b.node_id").alias("node_id"), (-F.col("b.w")).alias("width"))


def scatter_gather(edges: DataFrame, key: str) -> DataFrame:
    """key, origin, destination, width: the pair that most distinct middle accounts connect in two hops; ties by ids."""
    plain = edges.where("src <> dst").select(key, "src", "dst").distinct()
    a, b = plain.select(key, F.col("src").alias("origin"), F.col("dst").alias("mid")), plain.select(key, F.col("src").alias("mid"), F.col("dst").alias("destination"))
    g = a.join(b, [key, "mid"]).where("origin <> destination").groupBy(key, "origin", "destination").agg(F.count("*").alias("w")).where(F.col("w") >= TWO_SIDED)
    return g.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), "origin", "destination")).alias("b")).select(key, F.col("b.origin").alias("origin"), F.col("b.destination").alias("destination"), (-F.col("b.w")).alias("width"))


#: A cycle's accounts, a chain's arcs, the accounts up to which the longest path is searched exactly, a
#: stack's layers and their width, the accounts of a side.
CYCLE, CHAIN, EXACT_PATH, STACK, LAYER, SIDE = (3, 8), 3, 40, 3, 2, 2

SHAPES = "cycle_length long, chain_length long, chain boolean, bipartite boolean, bipartite_score double, left_size long, right_size long, stack_depth long, layer_widths array<long>, diameter long"


def shape_motifs(edges: DataFrame, key: str) -> DataFrame:
    """key and SHAPES of bounded cases (key, src, dst), each worked on as a whole.

    cycle_length: of the shortest cycle, null if none. chain_length: arcs of the longest simple path; chain: whether it is
    long enough. bipartite: no pair within a side, and both sides large enough; the score is the share of transfers
    between the sides times their balance, whether or not. stack_depth and layer_widths: null under STACK layers.
    diameter: the widest component's.
    """
    from .case_matrices import Case

    def run(pdf):
        import pandas as pd

        case = Case(pdf["src"], pdf["dst"])
        path = case.longest_path(EXACT_PATH)
        odd = case.sides()
        large, small = sorted((int(odd.sum()), int((~odd).sum())), reverse=True)
        across, _, within = case.across()
        total = int(case.transfers.sum())
        two = total > 0 and not within and small >= SIDE
        widths = case.layers(LAYER)
        row = {
            key: pdf[key].iloc[0], "cycle_length": case.cycle(*CYCLE), "chain_length": path, "chain": path >= CHAIN, "bipartite": two, "bipartite_score": round(across / total * small / large, 6) if total else 0.0,
            "left_size": len(odd) - int(odd.sum()) if two else None, "right_size": int(odd.sum()) if two else None, "stack_depth": len(widths) if len(widths) >= STACK else None, "layer_widths": widths if len(widths) >= STACK else None, "diameter": case.diameter(),
        }
        return pd.DataFrame([row]).astype({c: "Int64" for c in ("cycle_length", "left_size", "right_size", "stack_depth", "diameter")})

    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, {SHAPES}")


def gap_since_touch(edges: DataFrame) -> DataFrame:
    """transaction_key, hours since the sender last took part in any transfer (null for its first)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    touch = edges.select(F.col("src").alias("node_id"), us.alias("m")).union(edges.select("dst", us)).distinct()
    prev = touch.withColumn("prev", F.lag("m").over(W.partitionBy("node_id").orderBy("m")))
    return edges.withColumn("m", us).join(prev.withColumnRenamed("node_id", "src"), ["src", "m"]).select("transaction_key", "src", "ts", ((F.col("m") - F.col("prev")) / 3.6e9).alias("gap_hours"))


def zscores(edges: DataFrame, train_if: Column, clip: float = 8.0) -> DataFrame:
    """transaction_key, payment_currency, z: log1p(amount) standardised by currency over training rows (population deviation, 1 for 0), clipped; currencies that training lacks use all of it."""
    x = F.log1p(F.greatest(F.col("amount_paid"), F.lit(0.0)))
    own = edges.where(train_if).groupBy("payment_currency").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    every = edges.where(train_if).agg(F.avg(x).alias("gm"), F.stddev_pop(x).alias("gs"))
    j = edges.join(own, "payment_currency", "left").crossJoin(F.broadcast(every))  # one row
    s = F.coalesce("s", "gs")
    z = (x - F.coalesce("m", "gm")) / F.when(s > 0, s).otherwise(1.0)
    return j.select("transaction_key", "payment_currency", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z"))
