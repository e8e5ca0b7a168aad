"""Soft motif scores of cases, in [0, 1], from structure alone: loops are left out, labels are never seen.

Branching scores are joins and counts over distinct pairs. Cycle, bipartite and layer scores follow order
through a case and work on one bounded case at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Motifs in the order that breaks ties, and where their scores begin and saturate.
MOTIFS = ("fan_out", "fan_in", "gather_scatter", "scatter_gather", "cycle", "bipartite", "stack")
FAN = (3, 16)
TWO_SIDED = (2, 8)
CYCLE = (3, 6)
LAYERS = (2, 4)
LEAST_SIDE = 2
#: Cases of more accounts are looked at by their lists of neighbours instead of tables of all pairs.
TABLE_ACCOUNTS = 500


def saturating(n: Column, floor: int, full: int) -> Column:
    return F.when(n < floor, 0.0).when(n >= full, 1.0).otherwise((n - floor) / (full - floor))


def branching_scores(edges: DataFrame, key: str) -> DataFrame:
    """key, fan_out, fan_in, gather_scatter, scatter_gather; cases without an edge between two accounts are left out."""
    p = edges.where("src <> dst").select(key, "src", "dst").distinct()
    widest = lambda c, o, n: p.groupBy(key, c).agg(F.count(o).alias("w")).groupBy(key).agg(F.max("w").alias(n))
    back = p.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = p.join(back, [key, "src", "dst"], "left_anti")  # money that comes back is neither gathered nor scattered
    ins = one_way.groupBy(key, F.col("dst").alias("v")).agg(F.count("*").alias("i"))
    outs = one_way.groupBy(key, F.col("src").alias("v")).agg(F.count("*").alias("o"))
    hub = ins.join(outs, [key, "v"]).groupBy(key).agg(F.max(F.least("i", "o")).alias("hub"))
    origins = p.groupBy(key, "src").agg(F.count("*").alias("n")).where(F.col("n") >= TWO_SIDED[0]).select(key, "src")
    first = p.join(origins, [key, "src"]).select(key, F.col("src").alias("origin"), F.col("dst").alias("mid"))
    second = p.select(key, F.col("src").alias("mid"), "dst")
    meet = first.join(second, [key, "mid"]).where("dst <> origin").groupBy(key, "origin", "dst").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("meet"))
    j = widest("src", "dst", "out").join(widest("dst", "src", "into"), key).join(hub, key, "left").join(meet, key, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(key, saturating(z("out"), *FAN).alias("fan_out"), saturating(z("into"), *FAN).alias("fan_in"), saturating(z("hub"), *TWO_SIDED).alias("gather_scatter"), saturating(z("meet"), *TWO_SIDED).alias("scatter_gather"))


def ordered_scores(edges: DataFrame, key: str) -> DataFrame:
    """key, cycle, bipartite, stack.

    cycle falls from 1 for three accounts to a half for six. bipartite: distinct pairs across a breadth-first colouring over all
    transfers, times the balance of the sides. stack: layers of two accounts or more from the best source. Cases lie one after
    another in sorted partitions, so many small ones share a batch; no case is too large for a score.
    """

    from .case_matrices import Case, LargeCase

    def one(name, src, dst):
        if len(set(src)) == 1 or len(set(dst)) == 1:  # all from one account or all to one: no cycle of three, no side of two, no second layer
            return name, 0.0, 0.0, 0.0
        case = Case(src, dst) if len({*src, *dst}) <= TABLE_ACCOUNTS else LargeCase(src, dst)
        total = case.n_transfers()
        length = case.cycle(*CYCLE)
        odd = case.sides()
        large, small = sorted((int(odd.sum()), int((~odd).sum())), reverse=True)
        n = len(case.layers(LAYERS[0]))
        return (
            name,
            0.0 if length is None else 1 - (length - CYCLE[0]) / (2 * (CYCLE[1] - CYCLE[0])),
            case.across()[1] / total * small / large if total and small >= LEAST_SIDE else 0.0,
            0.0 if n < LAYERS[0] else min(1.0, (n - LAYERS[0]) / (LAYERS[1] - LAYERS[0])),
        )

    def run(batches):
        import pandas as pd

        def scored(pdf, ends):
            k, src, dst = (pdf[c].to_numpy(dtype=object) for c in (key, "src", "dst"))
            return pd.DataFrame([one(k[a], src[a:b], dst[a:b]) for a, b in zip(ends, ends[1:], strict=False)], columns=[key, "cycle", "bipartite", "stack"])

        # Rows come in the order of their cases; the last case of a batch may go on in the next.
        left = []
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key].to_numpy(dtype=object)
            if left and (_same(left[-1][key].iloc[-1], k[0])) and _same(k[0], k[-1]):
                left.append(pdf)
                continue
            pdf = pd.concat([*left, pdf]) if left else pdf
            k = pdf[key].to_numpy(dtype=object)
            ends = [0, *[i for i in range(1, len(k)) if not _same(k[i - 1], k[i])]]
            if len(ends) > 1:
                yield scored(pdf, ends)
            left = [pdf.iloc[ends[-1] :]]
        if left:
            pdf = pd.concat(left)
            yield scored(pdf, [0, len(pdf)])

    rows = edges.select(key, "src", "dst").repartition(key).sortWithinPartitions(key)
    return rows.mapInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, cycle double, bipartite double, stack double")


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def motif_scores(edges: DataFrame, key: str = "case_id") -> DataFrame:
    """key, the seven scores (six decimals), best (null if all are 0) and best_score; ties go by the motifs' order."""
    j = ordered_scores(edges, key).join(branching_scores(edges, key), key, "left").fillna(0.0, list(MOTIFS))
    j = j.select(key, *[F.round(m, 6).alias(m) for m in MOTIFS])
    best = F.array_min(F.array(*[F.struct((-F.col(m)).alias("s"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(MOTIFS)]))
    return j.withColumn("_b", best).withColumn("best", F.when(F.col("_b.s") < 0, F.col("_b.m"))).withColumn("best_score", -F.col("_b.s")).drop("_b")
