"""Evaluation statistics: ranks, rank tests, agreement, effect sizes, correlations, ranking metrics, neighbours, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def midrank(value: str, *partition: str) -> Column:
    """Rank from 1, ties averaged."""
    w = W.partitionBy(*partition).orderBy(value)
    same = W.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def mean(value: str | Column) -> Column:
    """Mean of a group's values by their decimal sum (18 places): the same in any order of rows, and equal means are equal doubles.
    Values that no decimal(38,18) holds, or whose sum none holds, have the mean of doubles."""
    v = F.col(value) if isinstance(value, str) else value
    exact = v.try_cast("decimal(38,18)")
    return F.when(F.count(exact) == F.count(v), F.coalesce((F.try_sum(exact) / F.count(v)).cast("double"), F.avg(v))).otherwise(F.avg(v))


def running(df: DataFrame, value: str, n: str, descending: bool = False) -> DataFrame:
    """Adds _before: the sum of n over the rows before this one in the order of the (distinct) values. Rows are sorted by range
    and summed by range, so no task has them all."""
    from .graph import keep

    order = F.desc(value) if descending else F.asc(value)
    s = keep(df.orderBy(order).withColumn("_p", F.spark_partition_id()), df.sparkSession)
    sums = s.groupBy("_p").agg(F.sum(n).alias("_s"))
    starts = sums.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row a range
    inside = F.coalesce(F.sum(n).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("_i", inside).join(F.broadcast(starts), "_p").withColumn("_before", F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def pooled_midranks(df: DataFrame, value: str) -> DataFrame:
    """value, n, midrank over a whole column without gathering it: ranks come from the counts of distinct values."""
    g = df.groupBy(value).agg(F.count("*").alias("n"))
    return running(g, value, "n").select(value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias("midrank"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row: chi2 (corrected for ties), k, n over blocks that have every treatment."""
    k = df.select(treatment).distinct().count()
    whole = df.groupBy(block).agg(F.countDistinct(treatment).alias("_k"), F.count("*").alias("_c")).where(f"_k = {k} AND _c = {k}").select(block)
    r = df.join(whole, block).withColumn("r", midrank(value, block))
    sums = r.groupBy(treatment).agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    ties = r.groupBy(block, "r").agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"))
    s = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.count("*").alias("k")).crossJoin(ties)
    n = F.col("n")
    base = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    return s.select((base / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("chi2"), F.col("k"), n)


def durbin(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row: the Durbin statistic of a balanced incomplete block design (k treatments to a block, r blocks to a treatment)."""
    r = df.withColumn("r", midrank(value, block))
    t = r.groupBy(treatment).agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    size = df.groupBy(block).agg(F.count("*").alias("k")).agg(F.max("k").alias("k"))
    s = t.agg(F.count("*").alias("t"), F.max("n").alias("r"), F.collect_list("s").alias("all"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("sum")).crossJoin(size)
    mean = F.col("r") * (F.col("k") + 1) / 2
    spread = F.col("ss") - 2 * mean * F.col("sum") + F.col("t") * mean * mean
    return s.select((12 * (F.col("t") - 1) * spread / (F.col("r") * F.col("t") * (F.col("k") - 1) * (F.col("k") + 1))).alias("durbin"), "t", "k", "r")


def holm(df: DataFrame, p: str = "p") -> DataFrame:
    """Step-down adjustment: the running maximum of (n - rank) * p, at most 1 (a list of tests, not data)."""
    order = W.orderBy(p, "name")
    r = df.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy()))
    return r.withColumn("p_adjusted", F.least(F.lit(1.0), F.max((F.col("_n") - F.col("_r") + 1) * F.col(p)).over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_r", "_n")


def cliffs_delta(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: delta, n_a, n_b, from counts of distinct values (never a cross join), and its band."""
    g = df.where(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("x"), F.count_if(F.col(group) == b).alias("y"))
    c = running(g, value, "y").select("x", "y", F.col("_before").alias("below"))
    s = c.agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.sum(F.col("x") * F.col("below")).alias("gt"), F.sum(F.col("x") * (F.col("below") + F.col("y"))).alias("ge"))
    d = (F.col("gt") - (F.col("n_a") * F.col("n_b") - F.col("ge"))) / (F.col("n_a") * F.col("n_b"))
    return s.select(d.alias("delta"), "n_a", "n_b", F.when(F.abs(d) < 0.147, "negligible").when(F.abs(d) < 0.33, "small").when(F.abs(d) < 0.474, "medium").otherwise("large").alias("band"))


def cohens_d(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.agg(m(a, F.avg).alias("ma"), m(b, F.avg).alias("mb"), m(a, F.var_samp).alias("va"), m(b, F.var_samp).alias("vb"), m(a, F.count).alias("na"), m(b, F.count).alias("nb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return s.select(((F.col("ma") - F.col("mb")) / pooled).alias("d"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: w_plus, w_minus, n (zero differences dropped), z by the normal approximation with ties."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    g = d.groupBy("m").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    r = running(g, "m", "n").select("n", "up", (F.col("_before") + (F.col("n") + 1) / 2).alias("r"))
    s = r.agg(F.coalesce(F.sum(F.col("r") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("r") * (F.col("n") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")), F.lit(0)).alias("t"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48
    return s.select("w_plus", "w_minus", "n", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0).alias("z"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: kappa, observed, expected, n, from the confusion counts."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    x, y = c.groupBy("a").agg(F.sum("n").alias("x")), c.groupBy("b").agg(F.sum("n").alias("y"))
    chance = x.join(y, F.col("a") == F.col("b")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    s = total.crossJoin(chance).select((F.col("same") / F.col("n")).alias("observed"), (F.col("xy") / (F.col("n") * F.col("n"))).alias("expected"), "n")
    return s.select(F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"), "observed", "expected", "n")


def kappa_band(kappa: Column) -> Column:
    return F.when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost_perfect")


def krippendorff_alpha(df: DataFrame, unit: str, value: str, ordinal: bool = False) -> DataFrame:
    """One row: alpha, n_pairable, of ragged units x coders (nulls are absent). Distances come from the coincidences of values, of which there are few.

    ordinal: the squared number of pairable values between two, half of each end's.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(unit, F.col(value).alias("c")).agg(F.count("*").alias("n"))
    v = v.join(v.groupBy(unit).agg(F.sum("n").alias("m")).where("m > 1"), unit)
    totals = v.groupBy("c").agg(F.sum("n").alias("t"))
    upto = F.sum("t").over(W.orderBy("c"))
    marks = totals.withColumn("mid", upto - F.col("t") / 2)  # the middle of each value's place in the order
    a, b = v.select(unit, F.col("c").alias("c"), "n", "m"), v.select(unit, F.col("c").alias("k"), F.col("n").alias("n2"))
    seen = a.join(b, unit).where("c <> k").groupBy("c", "k").agg(F.sum(F.col("n") * F.col("n2") / (F.col("m") - 1)).alias("o"))
    p, q = marks.select("c", F.col("t").alias("tc"), F.col("mid").alias("mc")), marks.select(F.col("c").alias("k"), F.col("t").alias("tk"), F.col("mid").alias("mk"))
    dist = F.pow(F.col("mc") - F.col("mk"), 2) if ordinal else F.lit(1.0)
    both = p.join(q, F.col("c") != F.col("k")).withColumn("d", dist).join(seen, ["c", "k"], "left")
    s = both.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("do"), F.sum(F.col("tc") * F.col("tk") * F.col("d")).alias("de")).crossJoin(totals.agg(F.sum("t").alias("n")))
    return s.select(F.when(F.col("de") > 0, 1 - (F.col("n") - 1) * F.col("do") / F.col("de")).otherwise(1.0).alias("alpha"), F.col("n").alias("n_pairable"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson, spearman (Pearson of midranks), n, and the Fisher interval of Pearson's."""
    rx = pooled_midranks(df, x).select(x, F.col("midrank").alias("_rx"))
    ry = pooled_midranks(df, y).select(y, F.col("midrank").alias("_ry"))
    s = df.join(rx, x).join(ry, y).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))
    z, h = F.atanh("pearson"), 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return s.select("pearson", "spearman", "n", F.tanh(z - h).alias("low"), F.tanh(z + h).alias("high"))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc_pr (steps at distinct scores), auc_roc (ties half), best_f1, n, n_positive. Counts by distinct score are all that is ordered."""
    g = df.groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    r = running(running(g, score, "p", True).withColumnRenamed("_before", "_tp"), score, "n", True)
    c = r.select("p", "n", (F.col("_tp") + F.col("p")).alias("tp"), (F.col("_before") + F.col("n")).alias("k")).crossJoin(F.broadcast(g.agg(F.sum("p").alias("pos"), F.sum("n").alias("all"))))
    neg, fp = F.col("all") - F.col("pos"), F.col("k") - F.col("tp")
    own = F.col("n") - F.col("p")
    return c.agg(F.sum(F.col("p") / F.col("pos") * F.col("tp") / F.col("k")).alias("auc_pr"), (F.sum(own * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("pos") * neg)).alias("auc_roc"), F.max(2 * F.col("tp") / (F.col("k") + F.col("pos"))).alias("best_f1"), F.max("all").alias("n"), F.max("pos").alias("n_positive"))


def score_percentile(df: DataFrame, key: str, score: str, groups: str) -> DataFrame:
    """key, percentile: 100 * (ordinal rank - 1) / max(n - 1, 1) within a group, ties by key."""
    w, all_ = W.partitionBy(groups).orderBy(score, key), W.partitionBy(groups)
    return df.select(key, groups, (100.0 * (F.row_number().over(w) - 1) / F.greatest(F.count("*").over(all_) - 1, F.lit(1))).alias("percentile"))


BLOCK_ROWS = 4096
"""So many vectors stand in a block, about."""
STRIP = 512
"""So many of a block's vectors meet another block's at once."""


def _vector_blocks(vectors: DataFrame) -> DataFrame:
    """q, ids, labels, data: the table's vectors in blocks, one row each, written to the shared folder."""
    from ..sources.stores import scratch_table

    kind = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        kept = [x for x in batches if x.num_rows]
        if kept:
            t = pa.Table.from_batches(kept)
            data = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks]).astype(kind)
            binary = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), binary(t.column("vec_id").to_numpy().astype("int64")), binary(t.column("label").to_numpy().astype("int64")), binary(data)], names=["q", "ids", "labels", "data"])

    rows = vectors.select("vec_id", "embedding", "label").repartition(max(1, -(-vectors.count() // BLOCK_ROWS)))
    return scratch_table(vectors.sparkSession, rows.mapInArrow(pack, "q long, ids binary, labels binary, data binary")).withColumn("kind", F.lit(kind))


def _all_pairs(vectors: DataFrame, side, meet, schema: str) -> DataFrame:
    """What is gathered for each block where it meets all others: `meet(x, y, same)` adds up in two sides, `x.found()` is a row (q, labels, ...).

    Each pair of blocks meets once, in a product of the written table's partitions: these are read where they are
    needed, and nothing but what was found is shuffled.
    """
    blocks = _vector_blocks(vectors)
    x, y = (blocks.select(F.col("q").alias(f"{c}q"), F.struct("q", "ids", "labels", "data", "kind").alias(c)) for c in "xy")

    def run(rows):
        import numpy as np

        def read(r):
            out = side()
            out.q, out.ids, out.labels = r["q"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
            out.data = np.frombuffer(r["data"], r["kind"]).astype(np.float64).reshape(len(out.ids), -1)
            out.norm = np.einsum("ij,ij->i", out.data, out.data)
            return out

        own, others = None, {}
        for r in rows:
            if own is None or own.q != r["xq"]:
                if own is not None:
                    yield own.found()
                own = read(r["x"])
            if r["xq"] == r["yq"]:
                meet(own, own, True)
                continue
            if r["yq"] not in others:
                others[r["yq"]] = read(r["y"])
            meet(own, others[r["yq"]], False)
        for o in ([] if own is None else [own, *others.values()]):
            yield o.found()

    pairs = x.join(y.hint("shuffle_replicate_nl"), F.col("xq") <= F.col("yq"))
    return vectors.sparkSession.createDataFrame(pairs.rdd.mapPartitions(run), schema)


def _strips(x, y):
    """Slices of x and their squared distances from y by products, and how far off these may be."""
    import numpy as np

    off = 1e-11 * (x.norm.max(initial=0) + y.norm.max(initial=0))
    for i in range(0, len(x.ids), STRIP):
        own = slice(i, i + STRIP)
        d = x.data[own] @ y.data.T
        d *= -2
        d += x.norm[own, None]
        d += y.norm[None, :]
        yield own, np.maximum(d, 0, out=d), off


def _exact(x, i, y, j):
    """Squared distances of pairs, added up dimension by dimension."""
    import numpy as np

    out = np.zeros(len(i))
    for c in range(x.data.shape[1]):
        e = x.data[i, c] - y.data[j, c]
        out += e * e
    return out


def knn_purity(vectors: DataFrame, k: int = 10) -> DataFrame:
    """label, purity, n: share of a vector's k nearest (Euclid, itself left out, ties by id) with its label.

    All pairs of blocks meet once; candidates come from matrix products with a margin, their distances are exact.
    A block gathers its k nearest by partition of the others.
    """
    import numpy as np

    class Side:
        other = None

        def add(self, i, y, j, d):
            """Neighbours j of y for the vectors i, at distances d."""
            if self.other is None:
                n = len(self.ids)
                self.other, self.d, self.same = np.zeros((n, k), np.int64), np.full((n, k), np.inf), np.zeros((n, k), bool)
            rows = np.unique(i)
            if not len(rows):
                return
            i = np.concatenate((np.repeat(rows, k), i))
            d = np.concatenate((self.d[rows].ravel(), d))
            other = np.concatenate((self.other[rows].ravel(), y.ids[j]))
            same = np.concatenate((self.same[rows].ravel(), y.labels[j] == self.labels[i[len(rows) * k :]]))
            order = np.lexsort((other, d, i))
            i = i[order]
            first = np.searchsorted(i, rows)
            top = order[(first[:, None] + np.arange(k)).ravel()]  # there are k of each row at least
            self.d[rows], self.other[rows], self.same[rows] = d[top].reshape(-1, k), other[top].reshape(-1, k), same[top].reshape(-1, k)

        def bound(self, own):
            return np.full(len(self.ids[own]), np.inf) if self.other is None else self.d[own, -1]

        def found(self):
            self.add(np.zeros(0, np.int64), self, np.zeros(0, np.int64), np.zeros(0))
            return self.q, self.labels.tobytes(), self.other.tobytes(), self.d.tobytes(), self.same.tobytes()

    def near(d, bound, off):
        """Places that may be among the k nearest of their row."""
        if d.shape[1] >= k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1] + off)
        return np.nonzero((d <= bound[:, None] + off) & (d < np.inf))

    def meet(x, y, same):
        twice = same or len(np.intersect1d(x.ids, y.ids)) > 0
        for own, d, off in _strips(x, y):
            if twice:
                d[x.ids[own, None] == y.ids[None, :]] = np.inf
            i, j = near(d, x.bound(own), off)
            i += own.start
            x.add(i, y, j, _exact(x, i, y, j))
            if not same:
                j, i = near(d.T, y.bound(slice(None)), off)
                i += own.start
                y.add(j, x, i, _exact(y, j, x, i))

    def merge(part):
        import pyarrow as pa

        labels = np.frombuffer(part.column("labels")[0].as_py(), np.int64)
        get = lambda c, t: np.concatenate([np.frombuffer(x, t).reshape(len(labels), k) for x in part.column(c).to_pylist()], axis=1)
        d, same = get("d", np.float64), get("same", bool)
        top = np.lexsort((get("other", np.int64), d), axis=1)[:, :k]
        there = np.isfinite(np.take_along_axis(d, top, 1))
        n = there.sum(axis=1)
        p = (np.take_along_axis(same, top, 1) & there).sum(axis=1) / np.maximum(n, 1)
        return pa.table({"label": pa.array(labels[n > 0].astype(np.int32)), "p": pa.array(p[n > 0])})

    found = _all_pairs(vectors, Side, meet, "q long, labels binary, other binary, d binary, same binary")
    return found.groupBy("q").applyInArrow(merge, "label int, p double").groupBy("label").agg(F.avg("p").alias("purity"), F.count("*").alias("n"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """label, silhouette, n by Euclid: all pairs of blocks meet once, and a block gathers its vectors' summed distances to each label."""
    import numpy as np

    class Side:
        def __init__(self):
            self.sums, self.count = {}, {}

        def add(self, own, labels, s, n):
            for c, x, m in zip(labels.tolist(), s, n.tolist(), strict=True):
                if c not in self.sums:
                    self.sums[c], self.count[c] = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int64)
                self.sums[c][own] += x
                self.count[c][own] += m

        def found(self):
            join = lambda x: b"".join(v.tobytes() for v in x.values())
            return self.q, self.labels.tobytes(), np.array(list(self.sums), np.int64).tobytes(), join(self.sums), join(self.count)

    def meet(x, y, same):
        def by_label(z, own):
            order = np.argsort(z.labels[own], kind="stable")
            u, at, n = np.unique(z.labels[own][order], return_index=True, return_counts=True)
            return order, u, at, n

        order, u, at, n = by_label(y, slice(None))
        for own, d, off in _strips(x, y):
            # Near ones, where products are off by much against the distance.
            i, j = np.nonzero(d <= 1e5 * off)
            for c in range(0, len(i), 1 << 18):
                a, b = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                d[a, b] = _exact(x, a + own.start, y, b)
            np.sqrt(d, out=d)
            x.add(own, u, np.add.reduceat(d[:, order], at, axis=1).T, n)
            if not same:
                order_, u_, at_, n_ = by_label(x, own)
                y.add(slice(None), u_, np.add.reduceat(d[order_], at_, axis=0), n_)

    def merge(part):
        import pyarrow as pa

        labels = np.frombuffer(part.column("labels")[0].as_py(), np.int64)
        sums, count = {}, {}
        for us, ss, ns in zip(*(part.column(c).to_pylist() for c in ("others", "sums", "count")), strict=True):
            for c, s, n in zip(np.frombuffer(us, np.int64).tolist(), np.frombuffer(ss, np.float64).reshape(-1, len(labels)), np.frombuffer(ns, np.int64).reshape(-1, len(labels)), strict=True):
                sums[c], count[c] = sums.get(c, 0) + s, count.get(c, 0) + n
        a, k, b = np.zeros(len(labels)), np.zeros(len(labels), np.int64), np.full(len(labels), np.inf)
        for c in sorted(sums):
            own = labels == c
            a[own], k[own] = (sums[c] / np.maximum(count[c] - 1, 1))[own], count[c][own]
            b[~own] = np.minimum(b, sums[c] / np.maximum(count[c], 1))[~own]
        most = np.maximum(a, b)
        has = (k > 1) & np.isfinite(b)
        x = np.where(has, (np.where(has, b, 0) - a) / np.where(has & (most > 0), most, 1), 0.0)
        return pa.table({"label": pa.array(labels.astype(np.int32)), "x": pa.array(x, mask=has & (most == 0))})

    found = _all_pairs(vectors, Side, meet, "q long, labels binary, others binary, sums binary, count binary")
    return found.groupBy("q").applyInArrow(merge, "label int, x double").groupBy("label").agg(F.avg("x").alias("silhouette"), F.count("*").alias("n"))


def seed_summary(df: DataFrame, *keys: str) -> DataFrame:
    """keys, mean, std (sample; null for one seed), n_seeds."""
    return df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("value")).alias("std"), F.count("*").alias("n_seeds"))


def latency(df: DataFrame, value: str, group: str) -> DataFrame:
    q = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *q)


def inverse_frequency_weights(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    mean = g.agg(F.avg(1 / F.col("n")).alias("m"))
    return g.crossJoin(F.broadcast(mean)).select(label, "n", ((1 / F.col("n")) / F.col("m")).alias("weight"))


# --- tails of distributions, for p values -------------------------------------------------------------

def chi2_tail(x: float, df: int) -> float:
    """Upper tail for a whole number of degrees of freedom: Q(df + 2) = Q(df) + the density's next term, from one or two up."""
    if x <= 0:
        return 1.0
    h = x / 2
    out, k = (math.exp(-h), 2) if df % 2 == 0 else (math.erfc(math.sqrt(h)), 1)
    while k < df:
        out += math.exp(k / 2 * math.log(h) - h - math.lgamma(k / 2 + 1))
        k += 2
    return min(out, 1.0)


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def student_tail(t: float, df: float, steps: int = 4000) -> float:
    """Upper tail, by Simpson's rule on the angle (t = sqrt(df) tan a), where the density is cos(a) ** (df - 1)."""
    a, b = math.atan(t / math.sqrt(df)), math.pi / 2
    f = lambda x: math.cos(x) ** (df - 1) if x < b else (1.0 if df == 1 else 0.0)
    h = (b - a) / steps
    total = f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, steps))
    return total * h / 3 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
