"""Queries of experiment bookkeeping, with their SQL. Event types stand for systems, users for cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as ex
from .registry import query


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def outputs(spark, d):
    return events(spark, d).select(F.col("event_type").alias("system"), F.col("user_id").alias("case_id"), "value")


_M = "WITH m AS (SELECT event_type AS system, user_id AS case_id, avg(value) AS v FROM events GROUP BY 1, 2)"


@query("compare_systems", f"{_M} SELECT x.system AS a, y.system AS b, count(*) AS n, round(avg(x.v - y.v), 9) AS mean_diff, count(*) FILTER (x.v > y.v) AS wins, count(*) FILTER (x.v < y.v) AS losses, count(*) FILTER (x.v = y.v) AS ties FROM m x JOIN m y USING (case_id) WHERE x.system < y.system GROUP BY 1, 2")
def compare_systems(spark, d):
    return ex.compare_systems(outputs(spark, d)).withColumn("mean_diff", F.round("mean_diff", 9))


@query("tidy_metrics", "SELECT event_type AS system, event_id AS seed, 'k' AS metric, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def tidy_metrics(spark, d):
    return ex.tidy(events(spark, d).select(F.col("event_type").alias("system"), F.col("event_id").alias("seed"), F.col("props").alias("report")))


@query("metrics_table", "SELECT event_type AS system, round(avg(value), 9) AS value_mean, round(avg(CAST(user_id AS DOUBLE)), 9) AS user_mean FROM events GROUP BY 1")
def metrics_table(spark, d):
    e = events(spark, d)
    rows = e.select(F.col("event_type").alias("system"), F.lit("value_mean").alias("metric"), "value").unionByName(e.select(F.col("event_type").alias("system"), F.lit("user_mean").alias("metric"), F.col("user_id").cast("double").alias("value")))
    return ex.wide(rows, ["value_mean", "user_mean"]).withColumns({c: F.round(c, 9) for c in ("value_mean", "user_mean")})


def guesses(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("lang", F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("guess"))


_G = "WITH g AS (SELECT lang AS t, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS p FROM documents), l AS (SELECT t AS label FROM g UNION SELECT p FROM g), c AS (SELECT label, (SELECT count(*) FROM g WHERE t = label) AS support, (SELECT count(*) FROM g WHERE p = label) AS said, (SELECT count(*) FROM g WHERE t = label AND p = label) AS tp FROM l), f AS (SELECT label, support, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, 2 * tp / (support + said) AS f1 FROM c)"


@query("confusion_metrics", f"{_G} SELECT * FROM f")
def confusion_metrics(spark, d):
    return ex.confusion_metrics(guesses(spark, d), "lang", "guess")


@query("summary_metrics", f"{_G} SELECT (SELECT avg(CAST(t = p AS DOUBLE)) FROM g) AS accuracy, round(avg(f1), 9) AS macro_f1, max(support) / sum(support) AS chance, CAST(sum(support) AS BIGINT) AS n FROM f")
def summary_metrics(spark, d):
    return ex.summary_metrics(guesses(spark, d), "lang", "guess").withColumn("macro_f1", F.round("macro_f1", 9))


@query("nemenyi", f"{_M}, r AS (SELECT system, rank() OVER (PARTITION BY case_id ORDER BY v) + (count(*) OVER (PARTITION BY case_id, v) - 1) / 2 AS r FROM m), k AS (SELECT system, avg(r) AS mr FROM r GROUP BY 1) SELECT x.system AS a, y.system AS b, round(abs(x.mr - y.mr), 9) AS gap, round(2.728 * sqrt(5 * 6 / (6.0 * 100)), 9) AS critical, abs(x.mr - y.mr) > 2.728 * sqrt(5 * 6 / (6.0 * 100)) AS differ FROM k x JOIN k y ON x.system < y.system")
def nemenyi(spark, d):
    m = ex.per_case_means(outputs(spark, d))
    return ex.nemenyi(ex.mean_ranks(m, "case_id", "system", "value"), 100).withColumn("gap", F.round("gap", 9)).withColumn("critical", F.round("critical", 9))


@query("call_costs", "SELECT event_type AS teacher, count(*) AS n_calls, CAST(sum(user_id * 10) AS BIGINT) AS tokens_in, CAST(sum(event_id % 50) AS BIGINT) AS tokens_out, round(sum(((user_id * 10 - user_id) * 3.0 + user_id * 0.3 + (event_id % 50) * 15.0) / 1e6), 9) AS usd FROM events GROUP BY 1")
def call_costs(spark, d):
    c = events(spark, d).select(F.col("event_type").alias("teacher"), (F.col("user_id") * 10).alias("tokens_in"), F.col("user_id").alias("tokens_cached"), (F.col("event_id") % 50).alias("tokens_out"))
    return ex.costs(c, 3.0, 15.0, 0.3).withColumn("usd", F.round("usd", 9))


@query("discard_report", "WITH e AS (SELECT unnest(CASE WHEN n_chars % 2 = 0 THEN ['even', 'any'] ELSE ['any'] END) AS reason, source AS teacher, lang AS typology FROM documents) SELECT reason, teacher, typology, count(*) AS n FROM e GROUP BY GROUPING SETS ((reason), (reason, teacher), (reason, typology), ())")
def discard_report(spark, d):
    r = spark.read.parquet(f"{d}/documents.parquet").select(F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("even"), F.lit("any"))).otherwise(F.array(F.lit("any"))).alias("reasons"), F.col("source").alias("teacher"), F.col("lang").alias("typology"))
    return ex.discards(r)


@query("held_annotations", "SELECT CASE WHEN NOT o_orderkey % 11 <> 0 THEN 'no_review' WHEN NOT o_custkey % 7 <> 0 THEN 'reviewer_not_independent' WHEN NOT o_orderstatus <> 'F' THEN 'rejected' WHEN o_totalprice / 1e6 > 0.05 THEN 'unverifiable_budget' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def held_annotations(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    yes = F.lit(True)
    return o.select(ex.held_reason(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 7 != 0, F.col("o_orderstatus") != "F", yes, yes, F.col("o_totalprice") / 1e6).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("attention_alignment", "WITH a AS (SELECT user_id AS case_id, event_id AS node_id, value AS weight, event_type = (SELECT min(event_type) FROM events) AS p FROM events), c AS (SELECT case_id, sum(CASE WHEN p THEN weight ELSE 0.0 END) / sum(weight) AS mass, avg(CAST(p AS DOUBLE)) AS share FROM a GROUP BY 1), t AS (SELECT case_id, p AS top FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, node_id DESC) AS k FROM a) WHERE k = 1) SELECT count(*) AS n_cases, round(avg(mass), 9) AS mass, round(avg(share), 9) AS expected, round(avg(mass) / avg(share), 9) AS lift, round(avg(CAST(top AS DOUBLE)), 9) AS top1 FROM c JOIN t USING (case_id) WHERE share > 0 AND share < 1")
def attention_alignment(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("event_type")).first()[0]
    out = ex.most_attended(e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("node_id"), F.col("value").alias("weight"), (F.col("event_type") == first).alias("on_path")))
    return out.withColumns({c: F.round(c, 9) for c in ("mass", "expected", "lift", "top1")})


@query("linear_probe")
def linear_probe(spark, d):
    """Held-out accuracy of a logistic probe and of its shuffled control (an iterative fit: tested for sense)."""
    return ex.linear_probe(spark.read.parquet(f"{d}/embeddings.parquet"))
