"""Queries of claim checking and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, evaluation, facts, graph
from ..operators import statistics as st
from ..sources import stores
from ..sources.transactions import TXN_SQL, txn
from .registry import query

W = f"WITH {TXN_SQL}"
D = "CAST(sum(CAST({} AS DECIMAL(38,6))) AS DOUBLE)"

# --- claims about accounts: a synthetic claim set that is right, off by a little, off by a lot, or about nothing -------

FACTS_SQL = f"""{W}, o AS (SELECT src AS v, count(*) AS n, count(DISTINCT payment_currency) AS k, min(payment_currency) AS c, {D.format('amount_paid')} AS s, min(ts) AS t FROM txn GROUP BY 1),
 facts AS (SELECT v AS case_id, 'flow.n_out' AS field_path, true AS available, CAST(NULL AS VARCHAR) AS reason, CAST(n AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS unit FROM o
 UNION ALL SELECT v, 'flow.total_out', k = 1, CASE WHEN k > 1 THEN '{facts.MULTI_CURRENCY}' END, s, NULL, c FROM o UNION ALL SELECT v, 'temporal.first', true, NULL, epoch_us(t) / 1000000.0, NULL, NULL FROM o UNION ALL SELECT v, 'entity.bank', true, NULL, NULL, split_part(v, '|', 1), NULL FROM o),
 h AS (SELECT *, CAST(CAST(concat('0x', sha256(concat(case_id, field_path))[1:8]) AS BIGINT) % 10 AS BIGINT) AS m FROM facts),
 claims AS (SELECT case_id, concat(case_id, ':', field_path) AS claim_id, CASE WHEN m = 9 THEN 'unknown.field' ELSE field_path END AS field_path, CASE field_path WHEN 'flow.n_out' THEN 'count' WHEN 'flow.total_out' THEN 'money' WHEN 'temporal.first' THEN 'timestamp' ELSE 'categorical' END AS claim_type,
  number * CASE WHEN m = 8 THEN 1.5 WHEN m = 7 THEN 1.005 ELSE 1.0 END AS number, CASE WHEN m = 8 THEN 'N99' ELSE text END AS text, CASE WHEN m = 6 THEN 'X' ELSE unit END AS unit FROM h)"""


def fact_table(spark, d):
    e = txn(spark, d)
    o = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"), F.countDistinct("payment_currency").alias("k"), F.min("payment_currency").alias("c"), graph.total("amount_paid").alias("s"), F.min("ts").alias("t"))
    none = F.lit(None).cast("string")
    row = lambda p, a, r, n, t, u: F.struct(F.lit(p).alias("field_path"), a.alias("available"), r.alias("reason"), n.cast("double").alias("number"), t.alias("text"), u.alias("unit"))
    yes, one = F.lit(True), F.col("k") == 1
    return o.select(F.col("v").alias("case_id"), F.explode(F.array(
        row("flow.n_out", yes, none, F.col("n"), none, none),
        row("flow.total_out", one, F.when(~one, facts.MULTI_CURRENCY), F.col("s"), none, F.col("c")),
        row("temporal.first", yes, none, F.unix_micros(F.col("t").cast("timestamp")) / 1e6, none, none),
        row("entity.bank", yes, none, F.lit(None), F.split_part("v", F.lit("|"), F.lit(1)), none),
    )).alias("f")).select("case_id", "f.*")


def claim_table(spark, d):
    m = F.conv(F.substring(F.sha2(F.concat("case_id", "field_path"), 256), 1, 8), 16, 10).cast("long") % 10
    f = fact_table(spark, d).withColumn("m", m)
    kind = F.when(F.col("field_path") == "flow.n_out", "count").when(F.col("field_path") == "flow.total_out", "money").when(F.col("field_path") == "temporal.first", "timestamp").otherwise("categorical")
    return f.select("case_id", F.concat("case_id", F.lit(":"), "field_path").alias("claim_id"), F.when(F.col("m") == 9, "unknown.field").otherwise(F.col("field_path")).alias("field_path"), kind.alias("claim_type"), (F.col("number") * F.when(F.col("m") == 8, 1.5).when(F.col("m") == 7, 1.005).otherwise(1.0)).alias("number"), F.when(F.col("m") == 8, "N99").otherwise(F.col("text")).alias("text"), F.when(F.col("m") == 6, "X").otherwise(F.col("unit")).alias("unit"))


def checked(spark, d):
    return claims.check(claim_table(spark, d), fact_table(spark, d))


CHECKED_SQL = f"""{FACTS_SQL}, checked AS (SELECT c.case_id, claim_id, c.field_path, claim_type, CASE WHEN f.available IS NULL OR NOT f.available THEN 'UNVERIFIABLE'
  WHEN coalesce(CASE claim_type WHEN 'count' THEN c.number = f.number WHEN 'money' THEN c.unit = f.unit AND abs(c.number - f.number) <= greatest(abs(f.number) * 0.01, 0.01) WHEN 'timestamp' THEN abs(c.number - f.number) <= 60 ELSE c.text = f.text END, false) THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict,
  CASE WHEN f.available IS NULL THEN 'no_such_fact' WHEN NOT f.available THEN coalesce(f.reason, 'unavailable') END AS reason FROM claims c LEFT JOIN facts f ON c.case_id = f.case_id AND c.field_path = f.field_path),
 results AS (SELECT *, CASE WHEN verdict = 'CONTRADICTED' THEN CASE claim_type WHEN 'count' THEN 'H2' WHEN 'money' THEN 'H2' WHEN 'timestamp' THEN 'H3' ELSE 'H5' END END AS hallucination_class, split_part(case_id, '|', 1) AS bank FROM checked)"""


@query("claim_verdicts", f"{CHECKED_SQL} SELECT claim_id, verdict, reason, hallucination_class FROM results")
def claim_verdicts(spark, d):
    return checked(spark, d).select("claim_id", "verdict", "reason", "hallucination_class")


SCORES_SQL = f"""{CHECKED_SQL}, tall AS (SELECT case_id, count(*) AS n_claims, count(*) FILTER (verdict = 'SUPPORTED') AS n_supported, count(*) FILTER (verdict = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (verdict = 'UNVERIFIABLE') AS n_unverifiable FROM results GROUP BY 1),
 need AS (SELECT case_id, field_path FROM facts WHERE field_path IN ('flow.n_out', 'entity.bank')), cov AS (SELECT n.case_id, count(*) AS k, count(s.case_id) AS c FROM need n LEFT JOIN (SELECT DISTINCT case_id, field_path FROM results WHERE verdict <> 'CONTRADICTED') s ON n.case_id = s.case_id AND n.field_path = s.field_path GROUP BY 1),
 scores AS (SELECT case_id, n_claims, n_supported, n_contradicted, n_unverifiable, CASE WHEN n_claims > 0 THEN n_supported / n_claims ELSE 1.0 END AS precision, CASE WHEN k > 0 THEN c / k ELSE 1.0 END AS coverage FROM tall JOIN cov USING (case_id))"""


def scored(spark, d):
    need = fact_table(spark, d).where(F.col("field_path").isin("flow.n_out", "entity.bank")).select("case_id", "field_path")
    return claims.score_cases(checked(spark, d), need)


@query("faithfulness_cases", f"{SCORES_SQL} SELECT *, CASE WHEN precision + coverage > 0 THEN 2 * precision * coverage / (precision + coverage) ELSE 0.0 END AS f1 FROM scores")
def faithfulness_cases(spark, d):
    return claims.with_f1(scored(spark, d))


@query("faithfulness_aggregate", f"{SCORES_SQL} SELECT split_part(case_id, '|', 1) AS bank, count(*) AS n_cases, round(avg(precision), 9) AS macro_precision, round(avg(coverage), 9) AS macro_coverage, sum(n_supported) / sum(n_claims) AS micro_precision, sum(n_contradicted) / sum(n_claims) AS contradiction_rate, count(*) FILTER (n_claims = 0) AS n_without_claims, round(avg(CASE WHEN n_contradicted = 0 THEN 1.0 ELSE 0.0 END), 9) AS zero_hallucination_rate FROM scores GROUP BY 1")
def faithfulness_aggregate(spark, d):
    s = scored(spark, d).withColumn("bank", F.split_part("case_id", F.lit("|"), F.lit(1)))
    out = claims.aggregate(s, "bank")
    return out.withColumns({c: F.round(c, 9) for c in ("macro_precision", "macro_coverage", "zero_hallucination_rate")})


@query("taxonomy_scores", f"{CHECKED_SQL}, n AS (SELECT bank, count(DISTINCT case_id) AS k FROM results GROUP BY 1) SELECT bank, hallucination_class, count(*) AS n, count(DISTINCT case_id) AS n_cases, count(*) / any_value(k) AS per_case FROM results JOIN n USING (bank) WHERE hallucination_class IS NOT NULL GROUP BY 1, 2")
def taxonomy_scores(spark, d):
    return claims.taxonomy(checked(spark, d).withColumn("bank", F.split_part("case_id", F.lit("|"), F.lit(1))), "bank")


@query("taxonomy_crosstab", f"{CHECKED_SQL} SELECT claim_type, count(*) FILTER (verdict = 'SUPPORTED') AS SUPPORTED, count(*) FILTER (verdict = 'CONTRADICTED') AS CONTRADICTED, count(*) FILTER (verdict = 'UNVERIFIABLE') AS UNVERIFIABLE FROM results GROUP BY 1")
def taxonomy_crosstab(spark, d):
    return claims.cross_tab(checked(spark, d), "claim_type", "verdict", ["SUPPORTED", "CONTRADICTED", "UNVERIFIABLE"])


@query("guard_candidates", f"{SCORES_SQL}, s AS (SELECT split_part(case_id, '|', 1) AS bank, case_id AS candidate, 0.5 * (1 - n_contradicted / greatest(n_claims, 1)) + 0.35 * coverage + 0.15 * (1 - n_unverifiable / greatest(n_claims, 1)) AS score FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY score DESC, candidate) AS k FROM s) SELECT bank AS case_id, candidate, round(score, 9) AS score FROM r WHERE k = 1")
def guard_candidates(spark, d):
    s = claims.candidate_scores(scored(spark, d)).select(F.split_part("case_id", F.lit("|"), F.lit(1)).alias("g"), F.col("case_id").alias("candidate"), "score")
    return claims.best_candidate(s.withColumnRenamed("g", "case_id")).withColumn("score", F.round("score", 9))


@query("worst_cases", f"{SCORES_SQL}, f AS (SELECT *, split_part(case_id, '|', 1) AS bank, CASE WHEN precision + coverage > 0 THEN 2 * precision * coverage / (precision + coverage) ELSE 0.0 END AS f1 FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY n_contradicted DESC, f1, case_id) AS rank FROM f) SELECT bank, case_id, n_contradicted, f1, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def worst_cases(spark, d):
    s = claims.with_f1(scored(spark, d)).withColumn("bank", F.split_part("case_id", F.lit("|"), F.lit(1)))
    return claims.worst(s, "bank", 3).select("bank", "case_id", "n_contradicted", "f1", "rank")


@query("omissions", f"{FACTS_SQL} SELECT f.case_id, 'activity_stated' AS rule FROM facts f WHERE field_path = 'flow.n_out' AND available AND number > 10 AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.case_id = f.case_id AND c.field_path = 'flow.n_out')")
def omissions(spark, d):
    f = fact_table(spark, d).where("field_path = 'flow.n_out'").select("case_id", F.lit("activity_stated").alias("rule"), (F.col("available") & (F.col("number") > 10)).alias("holds"))
    m = claim_table(spark, d).where("field_path = 'flow.n_out'").select("case_id", F.lit("activity_stated").alias("rule"))
    return claims.omissions(f, m)


@query("span_alignment")
def span_alignment(spark, d):
    """Sentences of two readings of a conversation matched by overlap (greedy, so tested against known spans)."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("id"), (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.length("text") % 90 + 10).alias("end"))
    return claims.align_spans(c, c.withColumn("start", F.col("start") + F.col("id") % 7))


# --- statistics ----------------------------------------------------------------------------------------

EVENT_MEANS = "SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2"


def event_means(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))


@query("midranks", "SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS midrank FROM events")
def midranks(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", st.midrank("value", "event_type").alias("midrank"))


@query("friedman", f"""WITH m AS ({EVENT_MEANS}), w AS (SELECT user_id FROM m GROUP BY 1 HAVING count(*) = 5), r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2 AS r FROM m JOIN w USING (user_id)),
 s AS (SELECT event_type, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT coalesce(sum(t * t * t - t), 0) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY user_id, r)) SELECT round((12.0 / (max(n) * 5 * 6) * sum(s * s) - 3.0 * max(n) * 6) / (1 - any_value(ties) / (max(n) * 5 * 24)), 9) AS chi2, count(*) AS k, max(n) AS n FROM s, t""")
def friedman(spark, d):
    return st.friedman(event_means(spark, d), "user_id", "event_type", "v").withColumn("chi2", F.round("chi2", 9))


@query("durbin", """WITH b AS (SELECT * FROM (VALUES (1,'a',3.0),(1,'b',1.0),(2,'b',2.0),(2,'c',5.0),(3,'a',4.0),(3,'c',4.5)) t(block, treatment, v)), r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY v) + (count(*) OVER (PARTITION BY block, v) - 1) / 2 AS r FROM b), s AS (SELECT treatment, sum(r) AS s, count(*) AS n FROM r GROUP BY 1) SELECT round(12 * (3 - 1) * sum((s - 2 * 3 / 2) * (s - 2 * 3 / 2)) / (2 * 3 * (2 - 1) * (2 + 1)), 9) AS durbin, count(*) AS t, CAST(2 AS BIGINT) AS k, max(n) AS r FROM s""")
def durbin(spark, d):
    rows = [(1, "a", 3.0), (1, "b", 1.0), (2, "b", 2.0), (2, "c", 5.0), (3, "a", 4.0), (3, "c", 4.5)]
    return st.durbin(spark.createDataFrame(rows, "block int, treatment string, v double"), "block", "treatment", "v").withColumn("durbin", F.round("durbin", 9))


@query("holm", "WITH p AS (SELECT n_name AS name, 1.0 / (n_nationkey * n_nationkey + 2) AS p FROM nation), r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS x FROM p) SELECT name, p, least(1.0, max(x) OVER (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM r")
def holm(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return st.holm(n.select(F.col("n_name").alias("name"), (F.lit(1.0) / (F.col("n_nationkey") * F.col("n_nationkey") + 2)).alias("p")))


@query("cliffs_delta", "WITH x AS (SELECT value FROM events WHERE event_type = (SELECT min(event_type) FROM events)), y AS (SELECT value FROM events WHERE event_type = (SELECT max(event_type) FROM events)), c AS (SELECT sum(CASE WHEN x.value > y.value THEN 1 WHEN x.value < y.value THEN -1 ELSE 0 END) AS s FROM x, y), d AS (SELECT s / ((SELECT count(*) FROM x) * (SELECT count(*) FROM y)) AS delta FROM c) SELECT delta, (SELECT count(*) FROM x) AS n_a, (SELECT count(*) FROM y) AS n_b, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS band FROM d")
def cliffs_delta(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = e.agg(F.min("event_type"), F.max("event_type")).first()
    return st.cliffs_delta(e, "event_type", "value", a, b)


@query("cohens_d", "SELECT round((avg(value) FILTER (event_type = a) - avg(value) FILTER (event_type = b)) / sqrt(((count(*) FILTER (event_type = a) - 1) * var_samp(value) FILTER (event_type = a) + (count(*) FILTER (event_type = b) - 1) * var_samp(value) FILTER (event_type = b)) / (count(*) FILTER (event_type IN (a, b)) - 2)), 9) AS d, count(*) FILTER (event_type = a) AS n_a, count(*) FILTER (event_type = b) AS n_b FROM events, (SELECT min(event_type) AS a, max(event_type) AS b FROM events) t")
def cohens_d(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = e.agg(F.min("event_type"), F.max("event_type")).first()
    return st.cohens_d(e, "event_type", "value", a, b).withColumn("d", F.round("d", 9))


PAIRS = "SELECT user_id, floor(avg(value) FILTER (event_id % 2 = 0)) AS a, floor(avg(value) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0"


def pairs(spark, d):
    half = lambda k: F.floor(st.mean(F.when(F.col("event_id") % 2 == k, F.col("value")))).cast("double")
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


@query("wilcoxon", f"""WITH d AS (SELECT a - b AS d FROM ({PAIRS}) WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d), t AS (SELECT coalesce(sum(t * t * t - t), 0) AS t FROM (SELECT count(*) AS t FROM d GROUP BY abs(d))), s AS (SELECT sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, count(*) AS n FROM r)
SELECT w_plus, w_minus, n, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 9) AS z FROM s, t""")
def wilcoxon(spark, d):
    return st.wilcoxon(pairs(spark, d), "a", "b").withColumn("z", F.round("z", 9))


@query("cohens_kappa", "WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) FILTER (a = b) / count(*) AS observed, count(*) AS n FROM c), e AS (SELECT sum(x.k * y.k) / ((SELECT n FROM s) * (SELECT n FROM s)) AS expected FROM (SELECT a, count(*) AS k FROM c GROUP BY 1) x JOIN (SELECT b, count(*) AS k FROM c GROUP BY 1) y ON a = b) SELECT CASE WHEN expected = 1 THEN 1.0 ELSE (observed - expected) / (1 - expected) END AS kappa, observed, expected, n FROM s, e")
def cohens_kappa(spark, d):
    return st.cohens_kappa(spark.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


RATINGS = "SELECT user_id, least(6, CAST(floor(value / 20) AS INTEGER)) AS c FROM events"


def ratings(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", F.least(F.lit(6), F.floor(F.col("value") / 20).cast("int")).alias("c"))


_ALPHA = """WITH v AS (SELECT user_id, c, count(*) AS n FROM ({r}) GROUP BY 1, 2), m AS (SELECT user_id, sum(n) AS m FROM v GROUP BY 1 HAVING sum(n) > 1), w AS (SELECT v.*, m FROM v JOIN m USING (user_id)), t AS (SELECT c, sum(n) AS t FROM w GROUP BY 1), p AS (SELECT c, t, sum(t) OVER (ORDER BY c) - t / 2 AS mid FROM t),
 o AS (SELECT a.c, b.c AS k, sum(a.n * b.n / (a.m - 1)) AS o FROM w a JOIN w b USING (user_id) WHERE a.c <> b.c GROUP BY 1, 2), x AS (SELECT x.t AS tc, y.t AS tk, {dist} AS d, coalesce(o, 0) AS o FROM p x JOIN p y ON x.c <> y.c LEFT JOIN o ON o.c = x.c AND o.k = y.c) SELECT round(1 - ((SELECT sum(t) FROM t) - 1) * sum(o * d) / sum(tc * tk * d), 9) AS alpha, (SELECT CAST(sum(t) AS BIGINT) FROM t) AS n_pairable FROM x"""


@query("krippendorff_nominal", _ALPHA.format(r=RATINGS, dist="1.0"))
def krippendorff_nominal(spark, d):
    return st.krippendorff_alpha(ratings(spark, d), "user_id", "c").withColumn("alpha", F.round("alpha", 9))


@query("krippendorff_ordinal", _ALPHA.format(r=RATINGS, dist="(x.mid - y.mid) * (x.mid - y.mid)"))
def krippendorff_ordinal(spark, d):
    return st.krippendorff_alpha(ratings(spark, d), "user_id", "c", True).withColumn("alpha", F.round("alpha", 9))


@query("correlations", """WITH r AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS ry FROM part), s AS (SELECT corr(p_size, p_retailprice) AS p, corr(rx, ry) AS q, count(*) AS n FROM r)
SELECT round(p, 9) AS pearson, round(q, 9) AS spearman, n, round(tanh(atanh(p) - 1.959963984540054 / sqrt(n - 3)), 9) AS low, round(tanh(atanh(p) + 1.959963984540054 / sqrt(n - 3)), 9) AS high FROM s""")
def correlations(spark, d):
    out = st.correlations(spark.read.parquet(f"{d}/part.parquet").select("p_size", "p_retailprice"), "p_size", "p_retailprice")
    return out.withColumns({c: F.round(c, 9) for c in ("pearson", "spearman", "low", "high")})


@query("ranking_metrics", """WITH s AS (SELECT d.n_chars AS score, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), t AS (SELECT sum(p) AS pos, sum(n) AS total FROM g), c AS (SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p / pos * tp / k), 9) AS auc_pr, round(sum((n - p) * (tp - p / 2)) / max(pos * (total - pos)), 9) AS auc_roc, round(max(2 * tp / (k + pos)), 9) AS best_f1, CAST(max(total) AS BIGINT) AS n, CAST(max(pos) AS BIGINT) AS n_positive FROM c, t""")
def ranking_metrics(spark, d):
    s = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("y"))
    return st.ranking_metrics(s, "score", "y").withColumns({c: F.round(c, 9) for c in ("auc_pr", "auc_roc", "best_f1")})


@query("score_percentile", "SELECT doc_id, lang, 100.0 * (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS percentile FROM documents")
def score_percentile(spark, d):
    return st.score_percentile(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "n_chars", "lang")


@query("knn_purity", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, b.vec_id AS other, CAST(a.label = b.label AS INTEGER) AS same, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p), m AS (SELECT vec_id, label, avg(same) AS p FROM r WHERE k <= 10 GROUP BY 1, 2) SELECT label, round(avg(p), 9) AS purity, count(*) AS n FROM m GROUP BY 1""")
def knn_purity(spark, d):
    return st.knn_purity(spark.read.parquet(f"{d}/embeddings.parquet")).withColumn("purity", F.round("purity", 9))


@query("silhouette", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS d FROM v a JOIN v b ON true), g AS (SELECT vec_id, label, other, sum(d) AS s, count(*) AS n FROM p GROUP BY 1, 2, 3),
 m AS (SELECT vec_id, label, max(s / greatest(n - 1, 1)) FILTER (label = other) AS a, max(n) FILTER (label = other) AS k, min(s / n) FILTER (label <> other) AS b FROM g GROUP BY 1, 2) SELECT label, round(avg(CASE WHEN k > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette, count(*) AS n FROM m GROUP BY 1""")
def silhouette(spark, d):
    return st.silhouette(spark.read.parquet(f"{d}/embeddings.parquet")).withColumn("silhouette", F.round("silhouette", 6))


@query("seed_summary", "SELECT event_type, round(avg(value), 9) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) END, 6) AS std, count(*) AS n_seeds FROM events GROUP BY 1")
def seed_summary(spark, d):
    return st.seed_summary(spark.read.parquet(f"{d}/events.parquet"), "event_type").withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 6))


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    """Percentile intervals from hash-drawn resamples (the draws are Spark's hash: tested for coverage)."""
    return evaluation.bootstrap(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id", "value")


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return st.latency(spark.read.parquet(f"{d}/events.parquet"), "value", "event_type").withColumn("mean", F.round("mean", 9))


@query("inverse_frequency_weights", "WITH g AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, n, (1 / n) / (SELECT avg(1 / n) FROM g) AS weight FROM g")
def inverse_frequency_weights(spark, d):
    return st.inverse_frequency_weights(spark.read.parquet(f"{d}/labels.parquet"), "quality")


# --- JSON, hashes, stores --------------------------------------------------------------------------------

@query("json_events", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_type", F.from_json("props", "k bigint").getField("k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("id_list_hash", "SELECT sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS ids_sha256, count(*) AS n FROM documents")
def id_list_hash(spark, d):
    return stores.id_list_hash(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    return stores.pending(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query("latest_by_key", "WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1")
def latest_by_key(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return stores.keep_latest(e, ["user_id", "event_type"], "event_id")


@query("content_hash")
def content_hash(spark, d):
    """A row-order-independent hash of a table (Spark's row hash)."""
    return stores.content_hash(spark.read.parquet(f"{d}/orders.parquet"))
