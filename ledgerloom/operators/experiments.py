"""Experiments: tidy metrics, comparison of systems on shared cases, confusion metrics, costs, held records, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .statistics import mean


def tidy(reports: DataFrame) -> DataFrame:
    """system, seed, metric, value from reports (system, seed, report JSON of a flat object); values that are no numbers are left out."""
    e = reports.select("system", "seed", F.explode(F.from_json("report", "map<string,string>")).alias("metric", "v"))
    return e.select("system", "seed", "metric", F.col("v").try_cast("double").alias("value")).where("value IS NOT NULL")


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """system and one column for each metric: means over seeds."""
    return metrics.groupBy("system").pivot("metric", names).agg(F.avg("value"))


def per_case_means(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("system", "case_id").agg(mean("value").alias("value"))


def compare_systems(outputs: DataFrame) -> DataFrame:
    """a, b, n, mean_diff, wins, losses, ties of every two systems over the cases that both have (systems are few; cases join by id)."""
    m = per_case_means(outputs)
    x, y = m.select(F.col("system").alias("a"), "case_id", F.col("value").alias("va")), m.select(F.col("system").alias("b"), "case_id", F.col("value").alias("vb"))
    d = F.col("va") - F.col("vb")
    return x.join(y, "case_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), mean(d).alias("mean_diff"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def confusion_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 (0 where undefined), of every label that occurs on either side."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = c.where("t = p").select(F.col("t").alias("label"), F.col("n").alias("tp"))
    rows, cols = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support")), c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    j = rows.join(cols, "label", "full").join(hit, "label", "left").fillna(0, ["support", "said", "tp"])
    f = 2 * F.col("tp") / (F.col("support") + F.col("said"))
    return j.select("label", "support", F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0).alias("precision"), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"), f.alias("f1"))


def summary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro_f1, chance (the share of the most frequent label), n."""
    by = confusion_metrics(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"), F.max("support").alias("m"), F.sum("support").alias("n"))
    acc = df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return acc.crossJoin(by).select("accuracy", "macro_f1", (F.col("m") / F.col("n")).alias("chance"), "n")


#: Studentised range quantiles over the square root of two at 0.05, for 2 to 10 systems.
NEMENYI = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


def nemenyi(ranks: DataFrame, n_blocks: int) -> DataFrame:
    """a, b, gap, critical, differ of mean ranks (system, mean_rank)."""
    k = ranks.count()
    if not 2 <= k <= len(NEMENYI) + 1:
        raise ValueError(f"critical values are known for 2 to {len(NEMENYI) + 1} systems, not for {k}")
    critical = NEMENYI[k - 2] * (k * (k + 1) / (6 * n_blocks)) ** 0.5
    x, y = ranks.select(F.col("system").alias("a"), F.col("mean_rank").alias("ra")), ranks.select(F.col("system").alias("b"), F.col("mean_rank").alias("rb"))
    gap = F.abs(F.col("ra") - F.col("rb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", gap.alias("gap"), F.lit(critical).alias("critical"), (gap > critical).alias("differ"))


def mean_ranks(df: DataFrame, block: str, system: str, value: str) -> DataFrame:
    """system, mean_rank over blocks (1 is the least value, ties averaged)."""
    from .statistics import midrank

    return df.withColumn("_r", midrank(value, block)).groupBy(F.col(system).alias("system")).agg(F.avg("_r").alias("mean_rank"))


def costs(calls: DataFrame, price_in: float, price_out: float, price_cached: float) -> DataFrame:
    """teacher, n_calls, tokens_in, tokens_out, usd: totals of calls (teacher, tokens_in, tokens_cached, tokens_out); prices per million."""
    fresh = F.col("tokens_in") - F.col("tokens_cached")
    usd = (fresh * price_in + F.col("tokens_cached") * price_cached + F.col("tokens_out") * price_out) / 1e6
    return calls.groupBy("teacher").agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(usd).alias("usd"))


def discards(records: DataFrame) -> DataFrame:
    """reason, teacher, typology, n with totals by each alone and over all (nulls): one pass over grouping sets."""
    e = records.select(F.explode("reasons").alias("reason"), "teacher", "typology")
    return e.groupingSets([[F.col("reason")], [F.col("reason"), F.col("teacher")], [F.col("reason"), F.col("typology")], []], "reason", "teacher", "typology").agg(F.count("*").alias("n"))


def held_reason(reviewed: Column, independent: Column, accepted: Column, has_facts: Column, in_split: Column, unverifiable_rate: Column, budget: float = 0.05) -> Column:
    """Why an annotation isn't taken in; null: it is. The first reason in order counts."""
    return F.when(~reviewed, "no_review").when(~independent, "reviewer_not_independent").when(~accepted, "rejected").when(~has_facts, "no_facts").when(~in_split, "not_in_split").when(unverifiable_rate > budget, "unverifiable_budget")


def most_attended(attention: DataFrame) -> DataFrame:
    """One row over cases with some and not all accounts on the path: mean attention on the path, mean share expected, lift, top-1 hits. Rows: (case_id, node_id, weight, on_path)."""
    c = attention.groupBy("case_id").agg((F.sum(F.when(F.col("on_path"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("mass"), F.avg(F.col("on_path").cast("double")).alias("share"), F.max_by("on_path", F.struct("weight", "node_id")).alias("top"))
    c = c.where("share > 0 AND share < 1")
    return c.agg(F.count("*").alias("n_cases"), F.avg("mass").alias("mass"), F.avg("share").alias("expected"), (F.avg("mass") / F.avg("share")).alias("lift"), F.avg(F.col("top").cast("double")).alias("top1"))


def linear_probe(vectors: DataFrame, folds: int = 5) -> DataFrame:
    """One row: held-out accuracy of a balanced logistic probe on (embedding, label), and of the same on labels shifted in hash order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    h = F.xxhash64("vec_id")
    w = W.partitionBy("_b").orderBy(h)
    d = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), F.pmod(h, F.lit(16)).alias("_b"), (F.pmod(h, F.lit(folds)) == 0).alias("held"))
    d = d.withColumn("shuffled", F.coalesce(F.lead("label", 7).over(w), F.lit(0.0)))
    out = []
    for name in ("label", "shuffled"):
        counts = d.where("NOT held").groupBy(name).agg(F.count("*").alias("_c"))
        train = d.where("NOT held").join(counts, name).withColumn("weight", 1 / F.col("_c"))
        model = LogisticRegression(featuresCol="features", labelCol=name, weightCol="weight", maxIter=50, regParam=0.01).fit(train)
        out.append(model.transform(d.where("held")).agg(F.avg((F.col("prediction") == F.col(name)).cast("double")).alias("accuracy" if name == "label" else "control")))
    return out[0].crossJoin(out[1])
