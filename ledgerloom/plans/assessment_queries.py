"""Queries of agreement, validation, resampling and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, claims, evaluation
from ..operators import statistics as st
from ..sources.transactions import TXN_SQL, txn
from .evaluation_queries import EVENT_MEANS, event_means, pairs
from .registry import ORACLE_SQL, query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("friedman_p", f"SELECT k, n, round(exp(-chi2 / 2) * (1 + chi2 / 2), 9) AS p FROM ({ORACLE_SQL['friedman']})")
def friedman_p(spark, d):
    f = st.friedman(event_means(spark, d), "user_id", "event_type", "v")
    return evaluation.with_p(f, "chi2", "chi2", "k - 1").select("k", "n", F.round("p", 9).alias("p"))


@query("wilcoxon_p")
def wilcoxon_p(spark, d):
    """Both tails of the normal approximation (SQL has no error function: tested against known values)."""
    return evaluation.with_p(st.wilcoxon(pairs(spark, d), "a", "b"), "z", "normal")


_ANN = """ann AS (SELECT CAST(c_custkey // 2 AS VARCHAR) AS case_id, concat('a', c_custkey % 2) AS annotator, CASE WHEN c_custkey % 3 = 0 THEN 'cycle' ELSE c_mktsegment END AS typology, [c_mktsegment, concat('n', c_nationkey % 3)] AS mentioned, CAST(c_acctbal AS DOUBLE) AS seconds FROM customer),
 p AS (SELECT a.typology AS x, b.typology AS y, a.mentioned AS m, b.mentioned AS k, abs(a.seconds - b.seconds) AS s FROM ann a JOIN ann b ON a.case_id = b.case_id AND a.annotator = 'a0' AND b.annotator = 'a1')"""


def annotations(spark, d):
    c = _t(spark, d, "customer")
    text = lambda x: x.cast("string")
    return c.select(F.expr("CAST(c_custkey div 2 AS STRING)").alias("case_id"), F.concat(F.lit("a"), text(F.col("c_custkey") % 2)).alias("annotator"), F.when(F.col("c_custkey") % 3 == 0, "cycle").otherwise(F.col("c_mktsegment")).alias("typology"), F.array("c_mktsegment", F.concat(F.lit("n"), text(F.col("c_nationkey") % 3))).alias("mentioned"), F.col("c_acctbal").alias("seconds"), F.col("c_name").alias("narrative"))


@query("annotator_agreement", f"""WITH {_ANN}, t AS (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po FROM p), e AS (SELECT sum(c.k * r.k) AS s FROM (SELECT x, count(*) AS k FROM p GROUP BY 1) c JOIN (SELECT y, count(*) AS k FROM p GROUP BY 1) r ON x = y)
SELECT n AS n_pairs, round((po - s / (n * n)) / (1 - s / (n * n)), 9) AS kappa, round((SELECT avg(len(list_intersect(m, k)) / len(list_distinct(list_concat(m, k)))) FROM p), 9) AS content_jaccard, round((SELECT avg(s) FROM p), 6) AS seconds_apart, round(po, 9) AS typology_agreed FROM t, e""")
def annotator_agreement(spark, d):
    m = evaluation.measure_agreement(annotations(spark, d))
    return m.select("n_pairs", F.round("kappa", 9).alias("kappa"), F.round("content_jaccard", 9).alias("content_jaccard"), F.round("seconds_apart", 6).alias("seconds_apart"), F.round("typology_agreed", 9).alias("typology_agreed"))


@query("annotator_disagreements", f"WITH {_ANN} SELECT concat(least(x, y), '/', greatest(x, y)) AS typologies, count(*) AS n FROM p WHERE x <> y GROUP BY 1")
def annotator_disagreements(spark, d):
    return evaluation.disagreements(annotations(spark, d))


@query("annotator_scores", f"""WITH {_ANN}, c AS (SELECT DISTINCT case_id, 'cycle' AS t, ['BUILDING', 'n1'] AS m FROM ann) SELECT annotator, count(*) AS n, avg(CASE WHEN typology = t THEN 1.0 ELSE 0.0 END) AS typology, round(avg(len(list_intersect(mentioned, m)) / len(list_distinct(list_concat(mentioned, m)))), 9) AS salience,
 avg(CASE WHEN seconds > 0 THEN 1.0 ELSE 0.0 END) AS hedging, 1.0 AS factual, avg(CASE WHEN typology = t THEN 1.0 ELSE 0.0 END) >= 0.3 AS passed FROM ann JOIN c USING (case_id) GROUP BY 1""")
def annotator_scores(spark, d):
    a = annotations(spark, d).withColumn("hedged", F.col("seconds") > 0).withColumn("factual", F.lit(1.0))
    c = a.select("case_id").distinct().select("case_id", F.lit("cycle").alias("typology"), F.array(F.lit("BUILDING"), F.lit("n1")).alias("mentioned"), F.lit(True).alias("hedged"))
    return evaluation.score_annotator(a, c, {"typology": 0.3}).withColumn("salience", F.round("salience", 9))


@query("chosen_annotations", f"WITH {_ANN}, n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM ann) SELECT case_id, annotator FROM n WHERE n = 1 OR annotator = concat('a', CAST(case_id AS BIGINT) % 2)")
def chosen_annotations(spark, d):
    a = annotations(spark, d)
    r = a.select("case_id").distinct().withColumn("chosen", F.concat(F.lit("a"), (F.col("case_id").cast("long") % 2).cast("string")))
    return cases.chosen_annotation(a, r).select("case_id", "annotator")


_AUTO = """auto AS (SELECT o_custkey AS case_id, o_orderpriority AS metric, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2), human AS (SELECT c_custkey AS case_id, c_mktsegment AS dimension, round(c_acctbal / 1000) AS rating FROM customer), j AS (SELECT * FROM auto JOIN human USING (case_id)),
 r AS (SELECT *, rank() OVER (PARTITION BY metric, dimension ORDER BY value) + (count(*) OVER (PARTITION BY metric, dimension, value) - 1) / 2 AS x, rank() OVER (PARTITION BY metric, dimension ORDER BY rating) + (count(*) OVER (PARTITION BY metric, dimension, rating) - 1) / 2 AS y FROM j)"""


@query("metric_validation", f"WITH {_AUTO} SELECT metric, dimension, count(*) AS n, round(corr(value, rating), 7) AS pearson, round(corr(x, y), 7) AS spearman FROM r GROUP BY 1, 2 HAVING count(*) > 4")
def metric_validation(spark, d):
    a = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    h = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("dimension"), F.round(F.col("c_acctbal") / 1000).alias("rating"))
    return evaluation.validate_metrics(a, h).where("n > 4").select("metric", "dimension", "n", F.round("pearson", 7).alias("pearson"), F.round("spearman", 7).alias("spearman"))


_MEANS = "m AS (SELECT c_nationkey AS rater, c_mktsegment AS system, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2)"


def _means(spark, d):
    return _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("rater"), F.col("c_mktsegment").alias("system")).agg(F.avg("c_acctbal").alias("value"))


@query("baseline_differences", f"WITH {_MEANS} SELECT a.system, count(*) AS n_pairs, round(avg(a.value - b.value), 6) AS mean_difference, round(quantile_cont(a.value - b.value, 0.5), 6) AS median_difference FROM m a JOIN m b ON a.rater = b.rater AND b.system = 'BUILDING' AND a.system <> 'BUILDING' GROUP BY 1")
def baseline_differences(spark, d):
    b = evaluation.against_baseline(_means(spark, d), "BUILDING")
    return b.select("system", "n_pairs", F.round("mean_difference", 6).alias("mean_difference"), F.round("median_difference", 6).alias("median_difference"))


@query("rater_effects", """WITH g AS (SELECT c_nationkey AS rater, count(*) AS n, avg(c_acctbal) AS m, coalesce(var_samp(c_acctbal), 0) AS v FROM customer GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS t, sum(n * m) / sum(n) AS mean, sum(n * n) AS q, sum((n - 1) * v) AS w FROM g),
 x AS (SELECT s.*, (SELECT sum(n * (m - mean) * (m - mean)) FROM g, s z) AS ss FROM s), y AS (SELECT mean, k, w / greatest(t - k, 1) AS within, ss / (k - 1) AS b, (t - q / t) / (k - 1) AS size FROM x)
SELECT round(mean, 4) AS mean, round(greatest(0, (b - within) / size), 2) AS between, round(within, 2) AS within, CAST(k AS BIGINT) AS n_raters FROM y""")
def rater_effects(spark, d):
    r = evaluation.rater_effects(_t(spark, d, "customer").select(F.col("c_nationkey").alias("rater"), F.col("c_acctbal").alias("value")))
    return r.select(F.round("mean", 4).alias("mean"), F.round("between", 2).alias("between"), F.round("within", 2).alias("within"), "n_raters")


@query("balanced_subset", "SELECT CAST(c_custkey AS VARCHAR) AS case_id, s AS system FROM customer, (VALUES ('a'), ('b'), ('c')) t(s) WHERE c_custkey % 4 <> 0")
def balanced_subset(spark, d):
    """Three of four cases have three systems, the fourth has two."""
    c = _t(spark, d, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "abc"))).alias("system")).where("NOT (c_custkey % 4 = 0 AND system = 'b')")
    return evaluation.balanced_subset(c.select(F.col("c_custkey").cast("string").alias("case_id"), "system"))


@query("value_distribution", """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, min(v) AS least, max(v) FILTER (i = least(floor(n * 0.05), n - 1)) AS p05, max(v) FILTER (i = least(floor(n * 0.5), n - 1)) AS median, max(v) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(v) AS most, round(avg(v), 9) AS mean FROM r GROUP BY 1""")
def value_distribution(spark, d):
    return evaluation.distribution(_t(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 9))


@query("latency_by_size", "SELECT CASE WHEN user_id % 120 < 25 THEN '0-24' WHEN user_id % 120 < 50 THEN '25-49' WHEN user_id % 120 < 100 THEN '50-99' ELSE '100+' END AS band, count(*) AS n, round(avg(value), 9) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_by_size(spark, d):
    e = _t(spark, d, "events").withColumn("nodes", F.col("user_id") % 120)
    return evaluation.latency_by_size(e, "value", "nodes").select("band", "n", F.round("mean", 9).alias("mean"), "p95")


@query("breakeven", "SELECT p_partkey, CASE WHEN p_retailprice / 100 > p_size THEN 1000.0 * 0.5 * 730.0 * 0.4 / (p_retailprice / 100 - p_size) END AS per_month FROM part")
def breakeven(spark, d):
    return _t(spark, d, "part").select("p_partkey", evaluation.breakeven_per_month(F.col("p_size"), F.col("p_retailprice") / 100, F.lit(0.5), F.lit(0.4)).alias("per_month"))


_SCORES = "s AS (SELECT event_type AS system, concat('m', user_id % 4) AS metric, avg(value) AS value FROM events GROUP BY 1, 2)"


@query("template_findings", f"""WITH {_SCORES}, t AS (SELECT min(system) AS t FROM s), b AS (SELECT metric, system, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, system) AS k FROM s, t WHERE system <> t)
SELECT s.metric, round(s.value, 6) AS template_score, b.system AS best_system, round(b.value, 6) AS best_score, b.value - s.value < 0.5 AS non_discriminative FROM s, t, b WHERE s.system = t AND b.metric = s.metric AND k = 1""")
def template_findings(spark, d):
    s = _t(spark, d, "events").groupBy(F.col("event_type").alias("system"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("metric")).agg(F.avg("value").alias("value"))
    f = evaluation.template_finding(s, s.agg(F.min("system")).first()[0], 0.5)
    return f.select("metric", F.round("template_score", 6).alias("template_score"), "best_system", F.round("best_score", 6).alias("best_score"), "non_discriminative")


_WORK = "a AS (SELECT c_custkey AS case_id, concat('t', c_custkey % 3) AS teacher, c_mktsegment AS stratum FROM customer), k AS (SELECT case_id FROM a WHERE case_id % 5 <> 0)"


def _work(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string")).alias("teacher"), F.col("c_mktsegment").alias("stratum"))
    return a, a.where("case_id % 5 <> 0").select("case_id")


@query("teacher_retention", f"WITH {_WORK} SELECT teacher, count(*) AS n, count(*) FILTER (case_id % 5 <> 0) AS n_kept, count(*) FILTER (case_id % 5 <> 0) / count(*) AS share FROM a GROUP BY 1")
def teacher_retention(spark, d):
    return evaluation.retention(*_work(spark, d), "teacher")


@query("teacher_balance", f"WITH {_WORK}, n AS (SELECT stratum, teacher, count(*) AS n FROM a JOIN k USING (case_id) GROUP BY 1, 2), g AS (SELECT stratum, sum(n) AS s, min(n) AS lo, max(n) AS hi, count(*) AS c FROM n GROUP BY 1) SELECT stratum, CASE WHEN c = 3 THEN lo / s ELSE 0.0 END AS least, hi / s AS most, hi / s - CASE WHEN c = 3 THEN lo / s ELSE 0.0 END AS spread FROM g")
def teacher_balance(spark, d):
    return evaluation.balance(*_work(spark, d), "stratum")


@query("extraction_cells", "SELECT CAST(p_size % 3 AS INTEGER) AS k, CAST(50 * (p_partkey % 3 + 1) AS BIGINT) AS n_max, count(*) AS n, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(p_size, 0.9) AS BIGINT) AS p90, round(avg(CASE WHEN p_partkey % 4 > 0 THEN least(p_partkey % 4, p_size % 4) / (p_partkey % 4) END), 9) AS recovery FROM part GROUP BY 1, 2")
def extraction_cells(spark, d):
    p = _t(spark, d, "part").select((F.col("p_size") % 3).alias("k"), (50 * (F.col("p_partkey") % 3 + 1)).alias("n_max"), F.col("p_size").alias("n_nodes"), (F.col("p_partkey") % 4).alias("n_flagged"), F.least(F.col("p_partkey") % 4, F.col("p_size") % 4).alias("n_flagged_seen"))
    return evaluation.extraction_cells(p).withColumn("recovery", F.round("recovery", 9))


@query("entailment_verdicts", """SELECT CAST(c_custkey AS VARCHAR) AS case_id, CAST(i AS INTEGER) AS "index", CASE WHEN i = 0 AND c_custkey % 2 = 0 THEN 'SUPPORTED' WHEN i = 1 AND c_custkey % 3 <> 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict,
 CASE WHEN i = 0 AND c_custkey % 2 = 0 THEN 'fits' WHEN i = 1 AND c_custkey % 3 <> 0 THEN 'differs' ELSE 'the judge returned no verdict for this claim' END AS rationale FROM customer, range(3) r(i)""")
def entailment_verdicts(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("case_id"))
    first = F.when(F.col("c_custkey") % 2 == 0, '{"index":0,"verdict":" supported ","rationale":"fits"},').otherwise("")
    second = F.when(F.col("c_custkey") % 3 != 0, '{"index":1,"verdict":"Contradicted","rationale":"differs"},').otherwise('{"index":1,"verdict":"perhaps"},')
    body = F.concat(F.lit('{"verdicts":['), first, second, F.lit('{"index":9,"verdict":"supported"}]}'))
    r = c.select("case_id", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), body)).alias("response"))
    return evaluation.parse_entailment(r, c.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("index")))


@query("reported_violations", "SELECT CAST(c_custkey AS VARCHAR) AS case_id, concat('s', i) AS sentence, 'r' AS reason FROM customer, range(2) r(i) WHERE c_custkey % 4 <> 0")
def reported_violations(spark, d):
    c = _t(spark, d, "customer")
    said = F.when(F.col("c_custkey") % 4 == 0, "none").otherwise('{"violations":[{"sentence":"s0","reason":"r"},{"sentence":"s1","reason":"r"}]}')
    return evaluation.parse_violations(c.select(F.col("c_custkey").cast("string").alias("case_id"), said.alias("response")))


RULES = [("cue-[a-z]+ ([0-9]+)", "a", "count"), ("([0-9]{4})", "b", "count"), ("([0-9]+)", "b", "count")]


@query("cue_claims", """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, regexp_extract_all(coalesce(text, ''), '([0-9]{4})', 1) AS y, regexp_extract_all(coalesce(text, ''), '([0-9]+)', 1) AS z, regexp_extract_all(coalesce(text, ''), 'cue-[a-z]+ ([0-9]+)', 1) AS a FROM documents),
 u AS (SELECT case_id, 'a' AS field_path, a AS v FROM t UNION ALL SELECT case_id, 'b', CASE WHEN len(y) > 0 THEN y ELSE z END FROM t) SELECT case_id, field_path, CAST(len(v) AS BIGINT) AS n, md5(array_to_string(v, ',')) AS raw FROM u WHERE len(v) > 0""")
def cue_claims(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("case_id"), "text")
    c = evaluation.claims_by_cues(docs, [evaluation.cue_rule(*r) for r in RULES])
    at = F.element_at(F.split("claim_id", ":"), -1).cast("int")
    return c.groupBy("case_id", "field_path").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), "raw"))), lambda x: x["raw"]), ",")).alias("raw"))


@query("derangement", "WITH h AS (SELECT c_custkey AS id, sha256(concat('17:', c_custkey)) AS h FROM customer), n AS (SELECT id, row_number() OVER (ORDER BY h) - 1 AS k, count(*) OVER () AS c FROM h) SELECT a.id, b.id AS other FROM n a JOIN n b ON b.k = (a.k + 1) % a.c")
def derangement(spark, d):
    return evaluation.derangement(_t(spark, d, "customer"), "c_custkey")


@query("auc_pr_interval")
def auc_pr_interval(spark, d):
    """Resampled (its draws can't be made in SQL: tested against the point value and by coverage)."""
    o = _t(spark, d, "customer").select((F.col("c_acctbal") > 4000).cast("int").alias("y"), (F.col("c_acctbal") + 3000 * F.sin(F.col("c_custkey"))).alias("s"), F.sin(F.col("c_custkey") * 7).alias("z"))
    return evaluation.bootstrap_auc_pr(o, "y", "s", "z", 200)


@query("paired_interval")
def paired_interval(spark, d):
    """Resampled differences (tested by coverage)."""
    p = _t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") - F.col("p_size")).alias("b"))
    return evaluation.paired_bootstrap(p, "p_brand", "p_partkey", "a", "b", 1000)


@query("active_probes")
def active_probes(spark, d):
    """Of few accounts a bucket the first that is active in a window (places come from Spark's own hash)."""
    c = _t(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("node_id")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.pmod(F.first("user_id"), F.lit(10)).alias("bucket"))
    w = _t(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    w = w.select(F.col("day").cast("string").alias("window_id"), "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("bucket")).withColumn("window_id", F.concat_ws("/", "window_id", "bucket"))
    return cases.probe_active(c, w)


@query("claim_kinds", f"""WITH {TXN_SQL}, o AS (SELECT src AS v, count(*) FILTER (src_bank <> dst_bank) / count(*) AS r, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS h, CASE WHEN bool_or(src_bank <> dst_bank) THEN 'true' ELSE 'false' END AS x, list_sort(list(DISTINCT dst_bank)) AS banks, ascii(md5(src)) % 3 AS m FROM txn GROUP BY 1),
 c AS (SELECT v, 'ratio' AS kind, m <> 2 AS ok FROM o UNION ALL SELECT v, 'duration', m <> 2 FROM o UNION ALL SELECT v, 'boolean', m = 0 OR (m = 1 AND x = 'true') FROM o UNION ALL SELECT v, 'sequence', m <> 1 FROM o UNION ALL SELECT v, 'entity', list_contains(banks, concat('N', m)) FROM o
  UNION ALL SELECT v, 'regulatory', m <> 0 FROM o UNION ALL SELECT v, 'unavailable', NULL FROM o)
SELECT concat(v, ':', kind) AS claim_id, CASE WHEN ok IS NULL THEN 'UNVERIFIABLE' WHEN ok THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict, CASE WHEN NOT ok THEN CASE kind WHEN 'ratio' THEN 'H2' WHEN 'duration' THEN 'H3' WHEN 'boolean' THEN 'H5' WHEN 'sequence' THEN 'H3' WHEN 'entity' THEN 'H1' ELSE 'H6' END END AS hallucination_class FROM c""")
def claim_kinds(spark, d):
    """Claims of the kinds that `claim_verdicts` lacks, each right, slightly off or wrong by the account's digest."""
    e = txn(spark, d)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cross = F.col("src_bank") != F.col("dst_bank")
    o = e.groupBy(F.col("src").alias("case_id")).agg((F.count_if(cross) / F.count("*")).alias("r"), ((F.max(us) - F.min(us)) / 3.6e9).alias("h"), F.when(F.max(cross), "true").otherwise("false").alias("x"), F.array_join(F.array_sort(F.collect_set("dst_bank")), claims.LIST).alias("banks"))
    o = o.withColumn("m", F.ascii(F.md5("case_id")) % 3)
    by = lambda a, b, c: F.when(F.col("m") == 0, a).when(F.col("m") == 1, b).otherwise(c)
    text = lambda x: F.lit(x).cast("string")
    number = lambda x: F.lit(x).cast("double") if x is None else x.cast("double")
    kinds = [  # kind, the fact's number and text, the claim's number, text and unit
        ("ratio", F.col("r"), text(None), F.col("r") + by(0.0, 0.005, 0.02), text(None), None),
        ("duration", F.col("h"), text(None), F.col("h") / 24 + by(0.0, 0.9, 1.5), text(None), "days"),
        ("boolean", None, F.col("x"), None, by(F.col("x"), F.lit("true"), F.lit("maybe")), None),
        ("sequence", None, F.lit("in,out"), None, by(F.lit("in,out"), F.lit("out,in"), F.lit("in,out")), None),
        ("entity", None, F.col("banks"), None, F.concat(F.lit("N"), F.col("m").cast("string")), None),
        ("regulatory", None, F.lit("rule 1; rule 2"), None, by(F.lit("rule 9"), F.lit("rule 1"), F.lit("rule 2")), None),
        ("unavailable", None, F.lit("x"), None, F.lit("x"), None),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("claim_type"), number(fn).alias("fn"), ft.alias("ft"), number(cn).alias("cn"), ct.alias("ct"), text(u).alias("u")) for k, fn, ft, cn, ct, u in kinds])
    every = o.select("case_id", F.explode(rows).alias("k")).select("case_id", "k.*").withColumn("field_path", F.col("claim_type"))
    f = every.select("case_id", "field_path", F.lit(True).alias("available"), text(None).alias("reason"), F.col("fn").alias("number"), F.col("ft").alias("text"), F.lit(None).cast("string").alias("unit"))
    c = every.select("case_id", F.concat_ws(":", "case_id", "claim_type").alias("claim_id"), "field_path", "claim_type", F.col("cn").alias("number"), F.col("ct").alias("text"), F.col("u").alias("unit"))
    return claims.check(c, f).select("claim_id", "verdict", "hallucination_class")
