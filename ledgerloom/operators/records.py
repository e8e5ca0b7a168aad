"""One record per case out of the fact operators, and what is read from records: panels, families, descriptors, exemplars, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formatting as fm
from . import facts

INVENTORY = 1_000
"""A case with more accounts was not bounded by its cut: reading its record raises."""


def banks(edges: DataFrame, key: str = "case_id") -> DataFrame:
    """key, n_banks, cross_bank: institutions that take part, and whether a transfer goes from one to another."""
    ends = edges.select(key, F.col("src_bank").alias("b")).union(edges.select(key, "dst_bank")).groupBy(key).agg(F.countDistinct("b").alias("n_banks"))
    return ends.join(edges.groupBy(key).agg(F.max(F.col("src_bank") != F.col("dst_bank")).alias("cross_bank")), key)


def focal_flow(edges: DataFrame, focal: DataFrame, key: str = "case_id") -> DataFrame:
    """key, total_in, total_out, max_in, max_out, retained of each case's focal account (key, node_id), as tagged facts."""
    own = edges.where("src <> dst").join(focal.select(key, "node_id"), key).where((F.col("src") == F.col("node_id")) | (F.col("dst") == F.col("node_id")))
    side = lambda c: F.when(F.col(c) == F.col("node_id"), F.col(key)).otherwise(F.lit(None))
    seen = own.withColumns({"src": side("src"), "dst": side("dst")})
    return facts.account_flow(seen).where("node_id IS NOT NULL").withColumnRenamed("node_id", key)


def extract_facts(edges: DataFrame, seeds: DataFrame, key: str = "case_id", known_typologies: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """key and the record's blocks as structs: entity_inventory, structure, focal_entity, temporal, flow, labels, motifs, typology.

    Cases are bounded; one with over INVENTORY accounts raises when read.
    """
    plain = edges.where("src <> dst")
    nodes = edges.select(key, F.col("src").alias("node_id")).union(edges.select(key, "dst")).groupBy(key).agg(F.array_sort(F.collect_set("node_id")).alias("entity_inventory"))
    nodes = nodes.withColumn("entity_inventory", F.when(F.size("entity_inventory") <= INVENTORY, F.col("entity_inventory")).otherwise(F.raise_error(F.concat(F.lit("too many accounts in case "), F.col(key))).cast("array<string>")))
    block = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    shape = block(facts.structure(edges, key).join(facts.shape_motifs(edges, key).select(key, "diameter"), key).join(banks(edges, key), key), "structure")
    focal = facts.select_focal(edges, seeds, key)
    roles = facts.roles(edges, key)
    entity = block(focal.join(roles, [key, "node_id"]), "focal_entity")
    both = plain.join(focal.select(key, F.col("node_id").alias("_f")), key).where((F.col("src") == F.col("_f")) | (F.col("dst") == F.col("_f")))
    when = facts.extent(edges, key).drop("n_edges").join(facts.phases(both, key, F.col("src") == F.col("_f")), key, "left").join(facts.burst(edges, key, "ts"), key, "left")
    flow = focal_flow(edges, focal, key)
    flagged = facts.flagged_nodes_of(edges, key)
    labels = edges.groupBy(key).agg(F.count_if("is_laundering").alias("n_illicit_transactions")).join(flagged.groupBy(key).agg(F.count("*").alias("n_illicit_accounts")), key, "left").fillna(0)
    shapes = facts.shape_motifs(edges, key).select(key, "cycle_length", "chain_length", "chain", "bipartite", "bipartite_score", "stack_depth")
    fans = [facts.fan_in(edges, key).select(key, F.col("present").alias("fan_in"), F.col("width").alias("fan_in_width")), facts.fan_out(edges, key).select(key, F.col("present").alias("fan_out"), F.col("width").alias("fan_out_width"))]
    two = [facts.gather_scatter(edges, key).select(key, F.col("width").alias("gather_scatter_width")), facts.scatter_gather(edges, key).select(key, F.col("width").alias("scatter_gather_width"))]
    motifs = shapes
    for t in (*fans, *two):
        motifs = motifs.join(t, key, "left")
    motifs = motifs.withColumns({"cycle": F.col("cycle_length").isNotNull(), "stack": F.col("stack_depth").isNotNull(), "gather_scatter": F.col("gather_scatter_width").isNotNull(), "scatter_gather": F.col("scatter_gather_width").isNotNull()})
    named = motifs.join(facts.dominant_typology(edges, order, key).drop("n"), key, "left") if known_typologies else motifs
    typology = block(facts.resolve_typology(named, known_typologies).select(key, "typology", "source", "confidence", "scope"), "typology")
    out = nodes.join(shape, key).join(entity, key).join(block(when, "temporal"), key).join(block(flow, "flow"), key, "left")
    return out.join(block(labels, "labels"), key).join(block(motifs, "motifs"), key).join(typology, key)


def fact_panel(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, section, label, value: a record's leaves as text, for reading."""
    rows = []
    for c in columns:
        for f in records.schema[c].dataType.fields:
            v = F.col(f"{c}.{f.name}")
            tagged = getattr(f.dataType, "names", None) == ["available", "reason", "value"]
            text = F.when(v["available"], v["value"].cast("string")).otherwise(F.concat(F.lit("n/a: "), v["reason"])) if tagged else v.cast("string")
            rows.append(F.struct(F.lit(c).alias("section"), F.lit(f.name).alias("label"), text.alias("value")))
    return records.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


# --- families, descriptors ----------------------------------------------------------------------------

#: Accounts up to which a case is minimal, and the families beside those of the typologies.
MINIMAL_NODES = 2
TOPOLOGY, MINIMAL, SUSPICIOUS, NO_FINDING = "topology", "minimal", "unclassified_suspicious", "no_finding"


def family(has_amounts: Column, n_nodes: Column, typology: Column, n_illicit: Column, families: dict[str, str]) -> Column:
    """The template family of a record: without amounts the topology's, then the smallest, then its typology's."""
    own = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[typology] if families else F.lit(None).cast("string")
    return F.when(~has_amounts, TOPOLOGY).when(n_nodes <= MINIMAL_NODES, MINIMAL).when(own.isNotNull(), own).when(F.coalesce(n_illicit, F.lit(0)) > 0, SUSPICIOUS).otherwise(NO_FINDING)


def realisation(index: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """A realisation's number as a place in each pool (mixed radix, the first pool turns fastest)."""
    out, left = {}, index
    for name, n in sizes.items():
        out[name] = F.pmod(left, F.lit(n)).cast("int")
        left = F.floor(left / n)
    return out


def holding_descriptors(long: DataFrame, descriptors: list[tuple[str, str, str]]) -> DataFrame:
    """case_id, descriptor, place, bound: the risk descriptors (name, field path, condition) that hold for a case's available numbers."""
    rows = [F.when((F.col("field_path") == path) & F.col("available") & fm.evaluate_condition(F.col("number"), condition), F.struct(F.lit(name).alias("descriptor"), F.lit(i).alias("place"), F.col("number").alias("bound"))) for i, (name, path, condition) in enumerate(descriptors)]
    return long.where(F.col("number").isNotNull()).select("case_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def indicators(holding: DataFrame, most: int = 3) -> DataFrame:
    """case_id, descriptors: up to `most` of those that hold, in their order, begun at a place that the case's digest chooses."""
    g = holding.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", "descriptor"))).alias("all"))
    at = F.pmod(fm.digest64(F.col("case_id"), F.lit("indicators")), F.size("all")).cast("int")
    turned = F.concat(F.slice("all", at + 1, F.size("all")), F.slice("all", F.lit(1), at))
    return g.select("case_id", F.transform(F.slice(turned, 1, most), lambda x: x["descriptor"]).alias("descriptors"))


def check_qualitative(claims: DataFrame, long: DataFrame, descriptors: list[tuple[str, str, str]]) -> DataFrame:
    """claims (case_id, claim_id, text) with verdict and class: an intensifier holds if its binding does; one that is no
    descriptor, or binds to a fact that isn't there, is unverifiable."""
    table = F.create_map(*[x for name, path, _ in descriptors for x in (F.lit(name), F.lit(path))])
    j = claims.withColumn("_name", F.lower(F.trim("text"))).withColumn("field_path", table[F.col("_name")])
    j = j.join(long.select("case_id", "field_path", F.col("available").alias("_a"), F.col("number").alias("_n")), ["case_id", "field_path"], "left")
    holds = F.coalesce(*[F.when(F.col("_name") == name, fm.evaluate_condition(F.col("_n"), condition)) for name, _, condition in descriptors])
    known = F.col("field_path").isNotNull() & F.coalesce("_a", F.lit(False)) & F.col("_n").isNotNull()
    verdict = F.when(~known, "UNVERIFIABLE").when(holds, "SUPPORTED").otherwise("CONTRADICTED")
    return j.select("case_id", "claim_id", verdict.alias("verdict"), F.when(verdict == "CONTRADICTED", "H2").alias("hallucination_class"))


def check_typology(claims: DataFrame, typologies: DataFrame) -> DataFrame:
    """claims (case_id, claim_id, text) against (case_id, typology, source): an inferred label can be contradicted, never supported."""
    j = claims.join(typologies.select("case_id", "typology", "source"), "case_id", "left")
    same = F.col("text") == F.col("typology")
    verdict = F.when(F.col("typology").isNull() | (same & (F.col("source") != "ground_truth")), "UNVERIFIABLE").when(same, "SUPPORTED").otherwise("CONTRADICTED")
    return j.select("case_id", "claim_id", verdict.alias("verdict"), F.when(verdict == "CONTRADICTED", "H5").alias("hallucination_class"))


# --- exemplars and displays ---------------------------------------------------------------------------

def exemplars(cases: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """case_id, rank, exemplar: k training cases for each case, those of its own typology first, in a turn that the case's id chooses.

    The pool (case_id, typology, split) is of the training split alone, else reading raises; a case's typology is known only
    if it is in the pool. The pool is numbered once as a whole and once by typology; a case then takes numbers, so neither pairs
    are formed nor lists of the pool. Only typologies of k cases or fewer, which others must fill up, give their places as a list.
    """
    from ..sources.corpora import none_of
    from .evaluation import numbered
    from .graph import keep

    spark = cases.sparkSession
    pool = none_of(pool, F.col("split") != "train", "an exemplar is not of the training split").select("case_id", F.coalesce("typology", F.lit("")).alias("typology")).distinct()
    own = numbered(pool, "typology", "case_id").withColumnRenamed("k", "own")
    whole = keep(numbered(own, "case_id").withColumnRenamed("k", "place"), spark)
    sides = whole.groupBy("typology").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    few = whole.join(sides.where(F.col("n") <= k), "typology").groupBy("typology").agg(F.array_sort(F.collect_list("place")).alias("skip"))
    every = whole.agg(F.count("*").alias("all"))
    j = cases.select("case_id").join(whole.select("case_id", "typology", "own"), "case_id", "left").withColumn("typology", F.coalesce("typology", F.lit("")))
    j = j.join(sides, "typology", "left").join(few, "typology", "left").crossJoin(F.broadcast(every)).fillna(0, ["n"])  # one row
    offset = F.aggregate(F.split("case_id", ""), F.lit(0), lambda x, c: x + F.when(c == "", 0).otherwise(F.ascii(c)))
    j = j.select("case_id", offset.alias("off"), (F.col("own") - F.col("first")).alias("self"), "first", (F.col("n") - F.col("own").isNotNull().cast("long")).alias("same"), (F.col("all") - F.col("n")).alias("rest"), F.coalesce("skip", F.array().cast("array<bigint>")).alias("skip"))
    turn = j.withColumn("rank", F.explode(F.sequence(F.lit(0), F.least(F.lit(k).cast("long"), F.col("same") + F.col("rest")).cast("int")))).where(F.col("rank") < F.least(F.lit(k), F.col("same") + F.col("rest")))
    at = F.try_mod(F.col("off") + F.col("rank"), F.col("same"))
    near = turn.where("rank < same").select("case_id", "rank", (F.col("first") + at + F.when(at >= F.col("self"), 1).otherwise(0)).alias("own"))
    far = turn.where("rank >= same").select("case_id", "rank", F.aggregate("skip", F.try_mod(F.col("off") + F.col("rank") - F.col("same"), F.col("rest")), lambda g, p: g + F.when(p <= g, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("place"))
    ids = lambda c: whole.select(c, F.col("case_id").alias("exemplar"))
    return near.join(ids("own"), "own").select("case_id", "rank", "exemplar").unionByName(far.join(ids("place"), "place").select("case_id", "rank", "exemplar"))


def side_by_side(cases: DataFrame, n: int = 12, seed: str = "17") -> DataFrame:
    """case_id, place: the first case of each typology by hash order (typologies by name), then the next ones by hash order (a report's list)."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), "case_id"), 256)
    r = cases.select("case_id", "typology", h.alias("h")).withColumn("k", F.row_number().over(W.partitionBy("typology").orderBy("h", "case_id")))
    first = F.when(F.col("k") == 1, 0).otherwise(1)
    top = r.select("case_id", "typology", "h", first.alias("f")).orderBy("f", F.when(F.col("f") == 0, F.col("typology")), "h", "case_id").limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy("f", F.when(F.col("f") == 0, F.col("typology")), "h", "case_id"))).select("case_id", "place")


def displayed(edges: DataFrame, focal: DataFrame, most: int, key: str = "case_id") -> DataFrame:
    """key, node_id, n_hidden: accounts that a view of a case shows: the focal one, those beside it, the others by their
    counterparties; and how many it hides."""
    counts = facts.counterparty_counts(edges, key).withColumn("degree", F.col("n_senders") + F.col("n_receivers"))
    f = focal.select(key, F.col("node_id").alias("_f"))
    plain = edges.where("src <> dst").join(f, key)
    beside = plain.where("src = _f").select(key, F.col("dst").alias("node_id")).union(plain.where("dst = _f").select(key, "src")).distinct().withColumn("_b", F.lit(1))
    j = counts.join(f, key).join(beside, [key, "node_id"], "left")
    order = W.partitionBy(key).orderBy(F.when(F.col("node_id") == F.col("_f"), 0).when(F.col("_b") == 1, 1).otherwise(2), F.desc("degree"), "node_id")
    n = F.count("*").over(W.partitionBy(key))
    return j.withColumn("_r", F.row_number().over(order)).withColumn("n_hidden", F.greatest(n - most, F.lit(0))).where(F.col("_r") <= most).select(key, "node_id", "n_hidden")


def timeline(edges: DataFrame, buckets: int = 24, key: str = "case_id") -> DataFrame:
    """key, bucket, n: transfers by equal stretches of a case's time (all in the first where it has no length)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = edges.groupBy(key).agg(F.min(us).alias("a"), F.max(us).alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.lit(buckets - 1), F.floor((us - F.col("a")) * buckets / (F.col("b") - F.col("a"))))).otherwise(0)
    return edges.select(key, "ts").join(ends, key).groupBy(key, at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# --- encodings ----------------------------------------------------------------------------------------

def encodings(edges: DataFrame, key: str = "case_id", laplacian: int = 8, walks: int = 16) -> DataFrame:
    """key, node_id, laplacian_pe, walk_pe of bounded cases, from the undirected distinct pairs without loops.

    laplacian_pe: eigenvectors of the normalised Laplacian after the first, each with its largest entry positive (their
    sign is free), padded with zeros; walk_pe: chances that a walk is back after 1, 2, ... steps.
    """
    import numpy as np

    def run(pdf):
        import pandas as pd

        names = np.unique(np.concatenate((pdf["src"].to_numpy(), pdf["dst"].to_numpy())).astype(str))
        a = np.zeros((len(names), len(names)))
        i, j = np.searchsorted(names, pdf["src"].to_numpy().astype(str)), np.searchsorted(names, pdf["dst"].to_numpy().astype(str))
        a[i, j] = a[j, i] = 1
        np.fill_diagonal(a, 0)
        degree = a.sum(axis=1)
        scale = np.divide(1, degree, out=np.zeros_like(degree), where=degree > 0)
        lap = np.zeros((len(names), laplacian))
        if len(names) > 1:
            _, vectors = np.linalg.eigh(np.eye(len(names)) - np.sqrt(scale)[:, None] * a * np.sqrt(scale))
            v = vectors[:, 1 : laplacian + 1]
            lap[:, : v.shape[1]] = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        back, power = np.zeros((len(names), walks)), np.eye(len(names))
        for k in range(walks):
            power = power @ (scale[:, None] * a)
            back[:, k] = power.diagonal()
        return pd.DataFrame({key: pdf[key].iloc[0], "node_id": names, "laplacian_pe": list(lap.astype(np.float32)), "walk_pe": list(back.astype(np.float32))})

    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, node_id string, laplacian_pe array<float>, walk_pe array<float>")


def build_feature_cache(features: DataFrame, splits: DataFrame, path: str) -> None:
    """Features of all split cases, by split."""
    features.join(splits.select("case_id", "split"), "case_id").write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def cache_departures(cache: DataFrame, splits: DataFrame) -> DataFrame:
    """case_id, cached, planned: cases whose split differs between the cache and the manifest, or that one of them lacks."""
    a, b = cache.select("case_id", F.col("split").alias("cached")).distinct(), splits.select("case_id", F.col("split").alias("planned")).distinct()
    return a.join(b, "case_id", "full").where(~F.col("cached").eqNullSafe(F.col("planned")))
