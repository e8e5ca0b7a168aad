"""Queries of the case, split and audit operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases, graph
from ..sources.transactions import TXN_SQL, txn
from .registry import query

W = f"WITH {TXN_SQL}"
CASES = f"""{W}, cases AS (SELECT case_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_edges, count(*) FILTER (is_laundering) AS n_flagged, CASE WHEN count(*) FILTER (is_laundering) > 0 THEN 'positive' ELSE 'negative' END AS case_class,
 CASE WHEN count(*) <= 5 THEN 'small' WHEN count(*) <= 20 THEN 'medium' ELSE 'large' END AS size_bucket, CAST(year(min(ts)) AS INTEGER) AS year FROM txn GROUP BY 1)"""
FIRST, SECOND = "1999-07-01 00:00:00", "2000-07-01 00:00:00"
SPLITS = f"""{CASES}, marked AS (SELECT *, CASE WHEN (start < TIMESTAMP '{FIRST}' AND TIMESTAMP '{FIRST}' < "end") OR (start < TIMESTAMP '{SECOND}' AND TIMESTAMP '{SECOND}' < "end") THEN 'straddles'
 WHEN least(abs(epoch_us(start) - epoch_us(TIMESTAMP '{FIRST}')), abs(epoch_us("end") - epoch_us(TIMESTAMP '{FIRST}'))) < 86400000000 OR least(abs(epoch_us(start) - epoch_us(TIMESTAMP '{SECOND}')), abs(epoch_us("end") - epoch_us(TIMESTAMP '{SECOND}'))) < 86400000000 THEN 'within_buffer' END AS drop_reason FROM cases),
 splits AS (SELECT *, CASE WHEN drop_reason IS NULL THEN CASE WHEN "end" <= TIMESTAMP '{FIRST}' THEN 'train' WHEN "end" <= TIMESTAMP '{SECOND}' THEN 'val' ELSE 'test' END END AS split FROM marked)"""
STREAMS = f"""{SPLITS}, members AS (SELECT DISTINCT s.case_id, split, concat(pattern_id, '-', src_bank) AS pattern_id FROM splits s JOIN txn USING (case_id) WHERE pattern_id IS NOT NULL AND split IS NOT NULL)"""
NODES = f"""{SPLITS}, nodes AS (SELECT DISTINCT split, case_id, v AS node_id FROM (SELECT case_id, dst AS v FROM txn) JOIN splits USING (case_id))"""
ts = lambda x: F.lit(x).cast("timestamp_ntz")


def index(spark, d):
    return cases.case_index(txn(spark, d))


def split(spark, d):
    return cases.assign_splits(index(spark, d), ts(FIRST), ts(SECOND), 24.0)


def streams(spark, d):
    """Flagged streams by pattern and sender's bank."""
    e = txn(spark, d).where("pattern_id IS NOT NULL").select("case_id", F.concat("pattern_id", F.lit("-"), "src_bank").alias("pattern_id")).distinct()
    return split(spark, d).where("split IS NOT NULL").select("case_id", "split").join(e, "case_id")


def receivers(spark, d):
    return txn(spark, d).select("case_id", F.col("dst").alias("node_id")).distinct()


@query("case_index", f"{CASES} SELECT * FROM cases")
def case_index(spark, d):
    return index(spark, d)


@query("activity_buckets", f"{W}, n AS (SELECT v, count(*) AS degree FROM (SELECT src AS v FROM txn UNION ALL SELECT dst FROM txn) GROUP BY 1) SELECT v AS node_id, CAST(least(9, floor(ln(1 + degree) / (SELECT max(ln(1 + degree)) FROM n) * 10)) AS BIGINT) AS bucket FROM n")
def activity_buckets(spark, d):
    return cases.activity_buckets(graph.node_table(txn(spark, d)))


@query("case_stratification", f"{CASES} SELECT 'case_class' AS dimension, case_class AS value, count(*) AS n FROM cases GROUP BY 2 UNION ALL SELECT 'size_bucket', size_bucket, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM cases GROUP BY 2")
def case_stratification(spark, d):
    return cases.stratification(index(spark, d))


@query("stratified_sample", f"{CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY case_class, size_bucket ORDER BY sha256(concat('17:', case_id))) AS k FROM cases) SELECT case_id, case_class, size_bucket FROM r WHERE k <= 25")
def stratified_sample(spark, d):
    return cases.stratified_sample(index(spark, d), ["case_class", "size_bucket"], 25).select("case_id", "case_class", "size_bucket")


@query("round_robin_sample", f"{CASES}, r AS (SELECT *, row_number() OVER (PARTITION BY size_bucket ORDER BY sha256(concat('17:', case_id))) AS k FROM cases) SELECT case_id, size_bucket FROM r ORDER BY k, size_bucket LIMIT 50")
def round_robin_sample(spark, d):
    return cases.round_robin(index(spark, d), "size_bucket", 50).select("case_id", "size_bucket")


@query("worker_assignment", f"{CASES} SELECT case_id, size_bucket, (row_number() OVER (PARTITION BY size_bucket ORDER BY sha256(concat('17:', case_id))) - 1 + CAST(concat('0x', sha256(size_bucket)[1:8]) AS BIGINT)) % 3 AS worker FROM cases")
def worker_assignment(spark, d):
    return cases.assign_workers(index(spark, d), "size_bucket", 3)


@query("matched_negatives", f"""{CASES}, n AS (SELECT *, row_number() OVER (PARTITION BY size_bucket ORDER BY sha256(concat('17:', case_id)), case_id) - 1 AS k, count(*) OVER (PARTITION BY size_bucket) AS c FROM cases WHERE n_flagged = 0),
 j AS (SELECT p.case_id AS positive, n.case_id AS negative, (k - CAST(concat('0x', sha256(concat('17:', p.case_id))[1:15]) AS BIGINT) % c + c) % c AS turn FROM cases p JOIN n ON p.n_flagged > 0 AND p.size_bucket = n.size_bucket AND p.start <= n."end" AND n.start <= p."end"),
 r AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY turn) AS o FROM j) SELECT positive, negative FROM r WHERE o <= 2""")
def matched_negatives(spark, d):
    return cases.match_negatives(index(spark, d), 2)


@query("bounded_windows", f"""{CASES}, m AS (SELECT case_id, epoch_us(start) AS a, epoch_us("end") AS b FROM cases) SELECT case_id, make_timestamp(CASE WHEN b - a + 172800000000 > 864000000000 THEN CAST(floor((a + b) / 2) AS BIGINT) - 432000000000 ELSE a - 86400000000 END) AS window_start, make_timestamp(CASE WHEN b - a + 172800000000 > 864000000000 THEN CAST(floor((a + b) / 2) AS BIGINT) + 432000000000 ELSE b + 86400000000 END) AS window_end FROM m""")
def bounded_windows(spark, d):
    return cases.bounded_window(index(spark, d), "start", "end", 24.0, 240.0).select("case_id", "window_start", "window_end")


@query("boundary_grid", f"""{CASES}, c AS (SELECT DISTINCT date_trunc('month', ts) AS b FROM txn), n AS (SELECT count(*) AS n FROM cases), p AS (SELECT x.b AS b1, y.b AS b2 FROM c x JOIN c y ON x.b < y.b),
 g AS (SELECT b1, b2, count(*) FILTER (NOT ((start < b1 AND b1 < "end") OR (start < b2 AND b2 < "end"))) AS kept, count(*) FILTER ("end" <= b1) AS n_train, count(*) FILTER (start >= b2 AND "end" > b2) AS n_test FROM p CROSS JOIN cases GROUP BY 1, 2),
 s AS (SELECT b1, b2, n_train, kept - n_train - n_test AS n_val, n_test, round(abs(n_train / kept - 0.7) + abs((kept - n_train - n_test) / kept - 0.15) + abs(n_test / kept - 0.15) + 1.5 * (1 - kept / (SELECT n FROM n)), 9) AS score FROM g WHERE kept > 0)
SELECT * FROM s ORDER BY score, b1, b2 LIMIT 1""")
def boundary_grid(spark, d):
    months = txn(spark, d).select(F.date_trunc("month", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("b")).distinct()
    return cases.boundary_grid(index(spark, d), months)


@query("split_assign", f"{SPLITS} SELECT case_id, split, drop_reason FROM splits")
def split_assign(spark, d):
    return split(spark, d).select("case_id", "split", "drop_reason")


@query("stream_atomicity", f"{STREAMS} SELECT pattern_id, count(DISTINCT split) AS n_splits FROM members GROUP BY 1 HAVING count(DISTINCT split) > 1")
def stream_atomicity(spark, d):
    return cases.broken_streams(streams(spark, d))


_O = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


@query("stream_enforced", f"{STREAMS}, h AS (SELECT pattern_id, min({_O}) AS home FROM members GROUP BY 1), bad AS (SELECT case_id FROM members JOIN h USING (pattern_id) WHERE {_O} > home) SELECT DISTINCT case_id, split FROM members WHERE case_id NOT IN (SELECT case_id FROM bad)")
def stream_enforced(spark, d):
    return cases.enforce_atomicity(streams(spark, d))


@query("overlap_rates", f"{NODES}, u AS (SELECT DISTINCT split, node_id FROM nodes WHERE split IS NOT NULL) SELECT split, count(*) AS n_nodes, count(*) FILTER (node_id IN (SELECT node_id FROM u WHERE split = 'train')) AS n_shared, count(*) FILTER (node_id IN (SELECT node_id FROM u WHERE split = 'train')) / count(*) AS rate FROM u WHERE split <> 'train' GROUP BY 1")
def overlap_rates(spark, d):
    return cases.overlap_rates(split(spark, d).select("case_id", "split").join(receivers(spark, d), "case_id").select("split", "node_id").where("split IS NOT NULL"))


@query("near_duplicate_cases", f"""{W}, m AS (SELECT DISTINCT case_id, dst AS node_id FROM txn), n AS (SELECT case_id, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.case_id AS a, b.case_id AS b, count(*) AS common FROM m a JOIN m b USING (node_id) WHERE a.case_id < b.case_id GROUP BY 1, 2)
SELECT a, b, common, x.n + y.n - common AS "union" FROM p JOIN n x ON a = x.case_id JOIN n y ON b = y.case_id WHERE common * 100 >= (x.n + y.n - common) * 90""")
def near_duplicate_cases(spark, d):
    return cases.near_duplicate_cases(receivers(spark, d))


@query("structural_hash", f"{W} SELECT case_id, sha256(string_agg(DISTINCT dst, ',' ORDER BY dst))[1:16] AS hash FROM txn GROUP BY 1")
def structural_hash(spark, d):
    return cases.structural_hash(receivers(spark, d))


@query("split_audit", f"""{NODES}, st AS (SELECT DISTINCT s.case_id, split, concat(pattern_id, '-', src_bank) AS p FROM splits s JOIN txn USING (case_id) WHERE pattern_id IS NOT NULL AND split IS NOT NULL), sp AS (SELECT * FROM splits WHERE split IS NOT NULL), bo AS (SELECT {_O} AS o, min(start) AS lo, max("end") AS hi FROM sp GROUP BY 1),
 ha AS (SELECT case_id, sha256(string_agg(DISTINCT dst, ',' ORDER BY dst))[1:16] AS hash FROM txn GROUP BY 1), r AS (SELECT 'temporal_order' AS "check", (SELECT count(*) FROM bo x JOIN bo y ON y.o = x.o + 1 WHERE y.lo < x.hi) AS n_violations UNION ALL SELECT 'case_in_two_splits', (SELECT count(*) FROM (SELECT case_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1))
 UNION ALL SELECT 'stream_atomicity', (SELECT count(*) FROM (SELECT p FROM st GROUP BY 1 HAVING count(DISTINCT split) > 1)) UNION ALL SELECT 'exact_duplicates', (SELECT count(*) FROM (SELECT hash FROM sp JOIN ha USING (case_id) GROUP BY 1 HAVING count(DISTINCT split) > 1))
 UNION ALL SELECT 'label_leakage_n_edges', (SELECT CAST(max(lo) > min(hi) AS BIGINT) FROM (SELECT n_flagged > 0 AS y, min(n_edges) AS lo, max(n_edges) AS hi FROM sp GROUP BY 1)) UNION ALL SELECT 'test_cases_sharing_accounts', (SELECT count(DISTINCT case_id) FROM nodes WHERE split = 'test' AND node_id IN (SELECT node_id FROM nodes WHERE split = 'train')))
SELECT "check", CAST(n_violations AS BIGINT) AS n_violations, n_violations = 0 AS passed FROM r""")
def split_audit(spark, d):
    s = split(spark, d).join(cases.structural_hash(receivers(spark, d)), "case_id")
    n = s.where("split IS NOT NULL").select("case_id", "split").join(receivers(spark, d), "case_id").withColumn("pattern_id", F.lit(None).cast("string"))
    return cases.audit(s, n.unionByName(streams(spark, d).withColumn("node_id", F.lit(None).cast("string"))))


@query("stream_windows", f"{W} SELECT pattern_id, min(ts) AS first_ts, max(ts) AS last_ts, make_timestamp(CAST(floor(quantile_cont(epoch_us(ts), 0.5)) AS BIGINT)) AS centre, count(*) AS n FROM txn WHERE pattern_id IS NOT NULL GROUP BY 1")
def stream_windows(spark, d):
    return cases.stream_windows(txn(spark, d))
