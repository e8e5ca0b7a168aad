"""Queries of the graph and fact operators over the transaction view, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, graph, motif_scores
from ..sources.transactions import TXN_SQL, TYPOLOGIES, txn
from .registry import query

W = f"WITH {TXN_SQL}"
D = "CAST(sum(CAST({} AS DECIMAL(38,6))) AS DOUBLE)"

#: The typology of a flagged order line stands for a pattern file's; every second flagged order is in it.
PATTERNS_SQL = """patterns AS (SELECT DISTINCT transaction_key, pattern_id, CASE pattern_id WHEN 'p0' THEN 'fan_in' WHEN 'p1' THEN 'fan_out' WHEN 'p2' THEN 'cycle' WHEN 'p3' THEN 'stack' WHEN 'p4' THEN 'bipartite' ELSE 'random' END AS typology
 FROM txn WHERE is_laundering AND CAST(split_part(transaction_key, '|', 1) AS BIGINT) % 2 = 0)"""


def patterns(spark, d):
    p = F.col("pattern_id")
    name = F.when(p == "p0", "fan_in").when(p == "p1", "fan_out").when(p == "p2", "cycle").when(p == "p3", "stack").when(p == "p4", "bipartite").otherwise("random")
    even = F.split_part("transaction_key", F.lit("|"), F.lit(1)).cast("long") % 2 == 0
    return txn(spark, d).where(F.col("is_laundering") & even).select("transaction_key", "pattern_id", name.alias("typology")).distinct()


def typed(spark, d):
    return graph.attach_typologies(txn(spark, d), patterns(spark, d))


TYPED_SQL = f"""{PATTERNS_SQL}, firsts AS (SELECT transaction_key, arg_min(pattern_id, pattern_id) AS p, arg_min(typology, pattern_id) AS t FROM patterns GROUP BY 1),
 typed AS (SELECT txn.* EXCLUDE (pattern_id), p AS pattern_id, CASE WHEN is_laundering THEN coalesce(t, 'unclassified') END AS typology FROM txn LEFT JOIN firsts USING (transaction_key))"""


@query("graph_node_table", f"""{W}, o AS (SELECT src AS node_id, count(*) AS out_degree, {D.format('amount_paid')} AS total_sent, min(ts) AS a1, max(ts) AS a2 FROM txn GROUP BY 1),
 i AS (SELECT dst AS node_id, count(*) AS in_degree, {D.format('amount_received')} AS total_received, min(ts) AS b1, max(ts) AS b2 FROM txn GROUP BY 1)
SELECT node_id, split_part(node_id, '|', 1) AS bank, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) + coalesce(out_degree, 0) AS degree, coalesce(total_received, 0.0) AS total_received, coalesce(total_sent, 0.0) AS total_sent, least(a1, b1) AS first_seen, greatest(a2, b2) AS last_seen FROM o FULL JOIN i USING (node_id)""")
def graph_node_table(spark, d):
    return graph.node_table(txn(spark, d))


@query("typology_attach", f"{W}, {TYPED_SQL} SELECT typology, pattern_id, count(*) AS n, count(DISTINCT transaction_key) AS n_keys FROM typed GROUP BY 1, 2")
def typology_attach(spark, d):
    return typed(spark, d).groupBy("typology", "pattern_id").agg(F.count("*").alias("n"), F.countDistinct("transaction_key").alias("n_keys"))


@query("typology_counts", f"{W}, {PATTERNS_SQL} SELECT typology, count(*) AS n_transactions FROM patterns GROUP BY 1 UNION ALL SELECT 'unclassified', count(*) FROM txn WHERE is_laundering AND NOT EXISTS (SELECT 1 FROM patterns p WHERE p.transaction_key = txn.transaction_key)")
def typology_counts(spark, d):
    return graph.typology_counts(txn(spark, d), patterns(spark, d))


@query("degree_stats", f"{W}, n AS (SELECT v, count(*) AS degree FROM (SELECT src AS v FROM txn UNION ALL SELECT dst FROM txn) GROUP BY 1) SELECT count(degree) AS n, min(degree) AS least, max(degree) AS most, avg(degree) AS mean, round(stddev_samp(degree), 6) AS std, quantile_disc(degree, 0.5) AS p50_nearest_rank, quantile_disc(degree, 0.9) AS p90_nearest_rank, quantile_disc(degree, 0.99) AS p99_nearest_rank, quantile_disc(degree, 0.999) AS p999_nearest_rank FROM n")
def degree_stats(spark, d):
    return graph.numeric_summary(graph.node_table(txn(spark, d)), "degree").withColumn("std", F.round("std", 6))


@query("structural_stats", f"{W}, p AS (SELECT src, dst, count(*) AS n FROM txn GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_edges, CAST(sum(CASE WHEN src = dst THEN n ELSE 0 END) AS BIGINT) AS n_self_loops, count(*) AS n_distinct_pairs, count(*) FILTER (n > 1) AS n_multi_pairs, max(n) AS max_parallel FROM p")
def structural_stats(spark, d):
    return graph.structural_statistics(txn(spark, d))


@query("temporal_stats", f"{W} SELECT min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS span_days, count(DISTINCT ts) AS n_timestamps, count(DISTINCT second(ts)) AS n_seconds, count(DISTINCT minute(ts)) AS n_minutes FROM txn")
def temporal_stats(spark, d):
    return graph.temporal_statistics(txn(spark, d))


@query("value_counts_format", f"{W} SELECT payment_format AS value, count(*) AS n FROM txn WHERE payment_format IS NOT NULL GROUP BY 1")
def value_counts_format(spark, d):
    return graph.value_counts(txn(spark, d), "payment_format")


@query("value_counts_currency", f"{W} SELECT receiving_currency AS value, count(*) AS n FROM txn GROUP BY 1")
def value_counts_currency(spark, d):
    return graph.value_counts(txn(spark, d), "receiving_currency")


@query("class_balance", f"{W} SELECT count(*) AS n_edges, count(*) FILTER (is_laundering) AS n_flagged, count(*) FILTER (is_laundering) / count(*) AS share, CAST(floor(count(*) / count(*) FILTER (is_laundering)) AS BIGINT) AS one_in FROM txn")
def class_balance(spark, d):
    return graph.class_balance(txn(spark, d))


def _some_nodes(spark, d):
    return graph.node_table(txn(spark, d)).where("degree >= 20")


_SOME = f"{W}, nodes AS (SELECT v AS node_id FROM (SELECT src AS v FROM txn UNION ALL SELECT dst FROM txn) GROUP BY 1 HAVING count(*) >= 20)"


@query("referential_integrity", f"{_SOME} SELECT 'src' AS side, src AS node_id, count(*) AS n FROM txn WHERE src NOT IN (SELECT node_id FROM nodes) GROUP BY 2 UNION ALL SELECT 'dst', dst, count(*) FROM txn WHERE dst NOT IN (SELECT node_id FROM nodes) GROUP BY 2")
def referential_integrity(spark, d):
    return graph.missing_endpoints(txn(spark, d), _some_nodes(spark, d))


@query("induced_subgraph", f"{_SOME} SELECT src, dst, count(*) AS n FROM txn WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes) GROUP BY 1, 2")
def induced_subgraph(spark, d):
    return graph.induced(txn(spark, d), _some_nodes(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("subgraph_labels", "SELECT c_nationkey AS subgraph_id, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS label, count(DISTINCT c_custkey) AS n_nodes, count(DISTINCT c_mktsegment) AS n_labels FROM customer GROUP BY 1")
def subgraph_labels(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return graph.subgraph_labels(c.select(F.col("c_nationkey").alias("subgraph_id"), F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("label")))


@query("weak_components", f"""WITH RECURSIVE {TXN_SQL}, e AS (SELECT DISTINCT src, dst FROM txn), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 r(node_id, c) USING KEY (node_id) AS (SELECT src AS node_id, src AS c FROM b GROUP BY 1 UNION SELECT b.dst AS node_id, min(r.c) AS c FROM r JOIN b ON r.node_id = b.src JOIN recurring.r AS old ON old.node_id = b.dst WHERE r.c < old.c GROUP BY b.dst) SELECT node_id, c AS component FROM r""")
def weak_components(spark, d):
    """Components of all transfers."""
    return graph.weak_components(txn(spark, d))


@query("flow_by_currency", f"{W} SELECT case_id, 'out' AS direction, payment_currency AS currency, {D.format('amount_paid')} AS value, count(*) AS n_transfers FROM txn GROUP BY 1, 3 UNION ALL SELECT case_id, 'in', receiving_currency, {D.format('amount_received')}, count(*) FROM txn GROUP BY 1, 3")
def flow_by_currency(spark, d):
    return facts.flow_by_currency(txn(spark, d))


_FLOW = f"""{W}, a AS (SELECT src AS node_id, 'out' AS d, payment_currency AS c, amount_paid AS v FROM txn UNION ALL SELECT dst, 'in', receiving_currency, amount_received FROM txn),
 g AS (SELECT node_id, count(*) FILTER (d = 'in') AS n_in, count(DISTINCT c) FILTER (d = 'in') AS k_in, CAST(sum(CAST(v AS DECIMAL(38,6))) FILTER (d = 'in') AS DOUBLE) AS s_in, max(v) FILTER (d = 'in') AS m_in, min(c) FILTER (d = 'in') AS c_in,
  count(*) FILTER (d = 'out') AS n_out, count(DISTINCT c) FILTER (d = 'out') AS k_out, CAST(sum(CAST(v AS DECIMAL(38,6))) FILTER (d = 'out') AS DOUBLE) AS s_out, max(v) FILTER (d = 'out') AS m_out, min(c) FILTER (d = 'out') AS c_out FROM a GROUP BY 1),
 r AS (SELECT *, CASE WHEN n_in = 0 THEN '{facts.NO_TRANSFERS}' WHEN k_in > 1 THEN '{facts.MULTI_CURRENCY}' END AS ri, CASE WHEN n_out = 0 THEN '{facts.NO_TRANSFERS}' WHEN k_out > 1 THEN '{facts.MULTI_CURRENCY}' END AS ro,
  CASE WHEN NOT coalesce(n_in > 0 AND n_out > 0 AND k_in = 1 AND k_out = 1 AND c_in = c_out, false) THEN '{facts.MULTI_CURRENCY}' WHEN s_in - s_out < 0 THEN '{facts.OUTFLOW_EXCEEDS}' END AS rr FROM g)"""


@query("flow_totals", f"""{_FLOW} SELECT node_id, CASE WHEN ri IS NULL THEN s_in END AS total_in, ri AS total_in_reason, CASE WHEN ro IS NULL THEN s_out END AS total_out, ro AS total_out_reason, CASE WHEN ri IS NULL THEN m_in END AS max_in, ri AS max_in_reason, CASE WHEN ro IS NULL THEN m_out END AS max_out, ro AS max_out_reason, CASE WHEN rr IS NULL THEN s_in - s_out END AS retained, rr AS retained_reason FROM r""")
def flow_totals(spark, d):
    return facts.flatten(facts.account_flow(txn(spark, d)), "total_in", "total_out", "max_in", "max_out", "retained")


@query("near_threshold", f"{W} SELECT case_id, count(*) FILTER (payment_currency = 'A' AND amount_paid >= 10000.0 * (1 - 0.1) AND amount_paid < 10000.0) AS n_near FROM txn GROUP BY 1")
def near_threshold(spark, d):
    return facts.near_threshold(txn(spark, d), "A", 10000.0, 0.1)


@query("case_structure", f"""{W}, p AS (SELECT case_id, src, dst, count(*) AS n FROM txn GROUP BY 1, 2, 3), v AS (SELECT case_id, count(DISTINCT x) AS n_nodes FROM (SELECT case_id, src AS x FROM p UNION SELECT case_id, dst FROM p) GROUP BY 1),
 q AS (SELECT * FROM p WHERE src <> dst), m AS (SELECT case_id, count(*) AS k FROM q WHERE EXISTS (SELECT 1 FROM q z WHERE z.case_id = q.case_id AND z.src = q.dst AND z.dst = q.src) GROUP BY 1),
 o AS (SELECT case_id, max(k) AS k FROM (SELECT case_id, src, count(*) AS k FROM q GROUP BY 1, 2) GROUP BY 1), i AS (SELECT case_id, max(k) AS k FROM (SELECT case_id, dst, count(*) AS k FROM q GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT case_id, CAST(sum(n) AS BIGINT) AS n_edges, CAST(coalesce(sum(n) FILTER (src = dst), 0) AS BIGINT) AS n_self_loops, count(*) FILTER (src <> dst) AS n_pairs FROM p GROUP BY 1)
SELECT s.case_id, n_edges, n_nodes, n_self_loops, n_pairs, CASE WHEN n_nodes > 1 THEN n_pairs / (n_nodes * (n_nodes - 1)) ELSE 0.0 END AS density, CASE WHEN n_pairs > 0 THEN coalesce(m.k, 0) / n_pairs ELSE 0.0 END AS reciprocity, coalesce(o.k, 0) AS max_out_degree, coalesce(i.k, 0) AS max_in_degree
FROM s JOIN v USING (case_id) LEFT JOIN m USING (case_id) LEFT JOIN o USING (case_id) LEFT JOIN i USING (case_id)""")
def case_structure(spark, d):
    return facts.structure(txn(spark, d))


@query("burst_window", """WITH e AS (SELECT user_id, ts, epoch_us(ts) AS m FROM events), w AS (SELECT user_id, count(*) OVER f AS n, min(ts) OVER f AS s, m - min(m) OVER f AS span FROM e WINDOW f AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, span, s) AS k FROM w WHERE n >= 5) SELECT user_id, n AS burst_n, s AS burst_start, span / 3600000000.0 AS burst_span_hours FROM r WHERE k = 1""")
def burst_window(spark, d):
    return facts.burst(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts")


@query("phase_ordering", f"""{W}, a AS (SELECT src AS node_id, true AS o, ts FROM txn WHERE src <> dst UNION ALL SELECT dst, false, ts FROM txn WHERE src <> dst), g AS (SELECT node_id, min(ts) FILTER (o) AS o1, max(ts) FILTER (o) AS o2, min(ts) FILTER (NOT o) AS i1, max(ts) FILTER (NOT o) AS i2 FROM a GROUP BY 1)
SELECT node_id, CASE WHEN o1 IS NULL THEN 'inflow_only' WHEN i1 IS NULL THEN 'outflow_only' WHEN i2 <= o1 THEN 'inflow_then_outflow' WHEN o2 <= i1 THEN 'outflow_then_inflow' ELSE 'interleaved' END AS phase FROM g""")
def phase_ordering(spark, d):
    e = txn(spark, d).where("src <> dst")
    both = e.select(F.col("src").alias("node_id"), F.lit(True).alias("o"), "ts").unionByName(e.select(F.col("dst").alias("node_id"), F.lit(False).alias("o"), "ts"))
    return facts.phases(both, "node_id", F.col("o"))


@query("case_extent", f"{W} SELECT case_id, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS span_hours, count(*) AS n_edges FROM txn GROUP BY 1")
def case_extent(spark, d):
    return facts.extent(txn(spark, d))


_HIT = "hit AS (SELECT src AS v FROM txn WHERE is_laundering UNION SELECT dst FROM txn WHERE is_laundering)"


@query("counterparty_labels", f"{W}, {_HIT}, n AS (SELECT src AS node_id, dst AS other FROM txn WHERE src <> dst UNION SELECT dst, src FROM txn WHERE src <> dst) SELECT node_id, count(*) FILTER (other IN (SELECT v FROM hit)) AS n_illicit, count(*) FILTER (other NOT IN (SELECT v FROM hit)) AS n_licit FROM n GROUP BY 1")
def counterparty_labels(spark, d):
    return facts.counterparties(txn(spark, d))


@query("illicit_inflow_share", f"""{W}, g AS (SELECT dst AS node_id, count(DISTINCT receiving_currency) AS k, {D.format('amount_received')} AS v, CAST(coalesce(sum(CAST(amount_received AS DECIMAL(38,6))) FILTER (is_laundering), 0) AS DOUBLE) AS f FROM txn GROUP BY 1), r AS (SELECT *, CASE WHEN k > 1 THEN '{facts.MULTI_CURRENCY}' WHEN v <= 0 THEN '{facts.NO_TRANSFERS}' END AS why FROM g)
SELECT node_id, CASE WHEN why IS NULL THEN f / v END AS share, why AS share_reason FROM r""")
def illicit_inflow_share(spark, d):
    return facts.flatten(facts.illicit_inflow_share(txn(spark, d)), "share")


@query("hops_to_flagged", f"""WITH RECURSIVE {TXN_SQL}, {_HIT}, e AS (SELECT DISTINCT src, dst FROM txn WHERE src <> dst), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), nodes AS (SELECT src AS v FROM txn UNION SELECT dst FROM txn),
 r(v, h) USING KEY (v) AS (SELECT v, 0 AS h FROM hit UNION SELECT b.dst AS v, min(r.h) + 1 AS h FROM r JOIN b ON b.src = r.v WHERE b.dst NOT IN (SELECT v FROM recurring.r) GROUP BY b.dst)
SELECT nodes.v AS node_id, h AS hops FROM nodes LEFT JOIN r ON r.v = nodes.v""")
def hops_to_flagged(spark, d):
    return facts.hops_to_flagged(txn(spark, d))


_COUNTS = """p AS (SELECT DISTINCT {k} src, dst FROM txn WHERE src <> dst), n AS (SELECT {k} src AS v FROM txn UNION SELECT {k} dst FROM txn), i AS (SELECT {k} dst AS v, count(*) AS a FROM p GROUP BY ALL), o AS (SELECT {k} src AS v, count(*) AS b FROM p GROUP BY ALL),
 t AS (SELECT {k} v, count(*) AS c FROM (SELECT {k} src AS v, dst AS w FROM p UNION SELECT {k} dst, src FROM p) GROUP BY ALL)"""


@query("focal_role", f"""{W}, {_COUNTS.format(k='')}, j AS (SELECT n.v AS node_id, coalesce(a, 0) AS n_senders, coalesce(b, 0) AS n_receivers FROM n LEFT JOIN i USING (v) LEFT JOIN o USING (v))
SELECT *, CASE WHEN n_senders + n_receivers = 0 THEN 'terminal' WHEN n_senders = 0 THEN 'originator' WHEN n_receivers = 0 THEN 'beneficiary' WHEN least(n_senders, n_receivers) >= 5 THEN 'hub' WHEN n_senders = 1 AND n_receivers = 1 THEN 'pass_through' ELSE 'intermediary' END AS role FROM j""")
def focal_role(spark, d):
    return facts.roles(txn(spark, d))


@query("focal_entity", f"""{W}, {_COUNTS.format(k='case_id,')}, j AS (SELECT n.case_id, n.v, coalesce(c, 0) AS c, n.v = split_part(n.case_id, '/', 1) AND md5(n.case_id)[1] < '8' AS seed FROM n LEFT JOIN t USING (case_id, v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seed DESC, c DESC, v) AS k FROM j) SELECT case_id, v AS node_id, CASE WHEN seed THEN 'extraction_seed' ELSE 'max_degree' END AS rule FROM r WHERE k = 1""")
def focal_entity(spark, d):
    """Half of the cases know their seed."""
    e = txn(spark, d)
    seeds = e.select("case_id").distinct().where(F.substring(F.md5("case_id"), 1, 1) < "8").withColumn("seed_node", F.split_part("case_id", F.lit("/"), F.lit(1)))
    return facts.select_focal(e, seeds)


_ORDER = ", ".join(f"'{t}'" for t in TYPOLOGIES)


@query("dominant_typology", f"{W}, {TYPED_SQL}, g AS (SELECT src_bank, typology, count(*) AS n FROM typed WHERE typology IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src_bank ORDER BY n DESC, list_position([{_ORDER}], typology)) AS k FROM g) SELECT src_bank, typology, n FROM r WHERE k = 1")
def dominant_typology(spark, d):
    return facts.dominant_typology(typed(spark, d), TYPOLOGIES, "src_bank")


def _star(centre: str, other: str) -> str:
    return f"""{W}, g AS (SELECT case_id, {centre} AS v, count(DISTINCT {other}) FILTER (src <> dst) AS w, (epoch_us(max(ts) FILTER (src <> dst)) - epoch_us(min(ts) FILTER (src <> dst))) / 3600000000.0 AS h FROM txn GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w DESC, v) AS k FROM g) SELECT case_id, w >= 3 AS present, CASE WHEN w >= 3 THEN v END AS node_id, CASE WHEN w >= 3 THEN w END AS width, CASE WHEN w >= 3 THEN h END AS window_hours FROM r WHERE k = 1"""


@query("motif_fan_out", _star("src", "dst"))
def motif_fan_out(spark, d):
    return facts.fan_out(txn(spark, d))


@query("motif_fan_in", _star("dst", "src"))
def motif_fan_in(spark, d):
    return facts.fan_in(txn(spark, d))


@query("motif_gather_scatter", f"{W}, i AS (SELECT src_bank, dst AS v, count(DISTINCT src) AS a FROM txn WHERE src <> dst GROUP BY 1, 2), o AS (SELECT src_bank, src AS v, count(DISTINCT dst) AS b FROM txn WHERE src <> dst GROUP BY 1, 2), r AS (SELECT src_bank, v AS node_id, least(a, b) AS width, row_number() OVER (PARTITION BY src_bank ORDER BY least(a, b) DESC, v) AS k FROM i JOIN o USING (src_bank, v)) SELECT src_bank, node_id, width FROM r WHERE k = 1 AND width >= 2")
def motif_gather_scatter(spark, d):
    return facts.gather_scatter(txn(spark, d), "src_bank")


@query("motif_scatter_gather", f"{W}, p AS (SELECT DISTINCT src_bank, src, dst FROM txn WHERE src <> dst), g AS (SELECT a.src_bank, a.src AS origin, b.dst AS destination, count(*) AS width FROM p a JOIN p b ON a.src_bank = b.src_bank AND a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY src_bank ORDER BY width DESC, origin, destination) AS k FROM g) SELECT src_bank, origin, destination, width FROM r WHERE k = 1 AND width >= 2")
def motif_scatter_gather(spark, d):
    return facts.scatter_gather(txn(spark, d), "src_bank")


#: Flagged transfers in cases that stay small however many there are: a few neighbouring orders each.
MOTIF_CASE_SQL = "mc AS (SELECT CAST(CAST(split_part(transaction_key, '|', 1) AS BIGINT) // 1164 AS VARCHAR) AS g, * FROM txn WHERE is_laundering)"


def motif_cases(spark, d):
    return txn(spark, d).where("is_laundering").withColumn("g", F.expr("CAST(CAST(split_part(transaction_key, '|', 1) AS BIGINT) div 1164 AS STRING)"))


@query("motif_shapes", f"""WITH RECURSIVE {TXN_SQL}, {MOTIF_CASE_SQL}, p AS MATERIALIZED (SELECT DISTINCT g, src, dst FROM mc WHERE src <> dst), u AS MATERIALIZED (SELECT g, src, dst FROM p UNION SELECT g, dst, src FROM p), n AS MATERIALIZED (SELECT g, src AS v FROM mc UNION SELECT g, dst FROM mc),
 uw(g, s, v, d) AS (SELECT g, v, v, 0 FROM n UNION SELECT uw.g, s, u.dst, d + 1 FROM uw JOIN u ON u.g = uw.g AND u.src = uw.v WHERE d < 60), ud AS MATERIALIZED (SELECT g, s, v, min(d) AS d FROM uw GROUP BY 1, 2, 3),
 dw(g, s, v, d) AS (SELECT g, v, v, 0 FROM n UNION SELECT dw.g, s, p.dst, d + 1 FROM dw JOIN p ON p.g = dw.g AND p.src = dw.v WHERE d < 60), dd AS MATERIALIZED (SELECT g, s, v, min(d) AS d FROM dw GROUP BY 1, 2, 3),
 walk(g, v, way) AS (SELECT g, v, [v] FROM n UNION ALL SELECT walk.g, p.dst, list_append(way, p.dst) FROM walk JOIN p ON p.g = walk.g AND p.src = walk.v WHERE NOT list_contains(way, p.dst)),
 size AS (SELECT g, count(*) AS n FROM n GROUP BY 1), dia AS (SELECT g, max(d) AS diameter FROM ud GROUP BY 1), chain AS (SELECT g, max(len(way)) - 1 AS chain_length FROM walk GROUP BY 1),
 cyc AS (SELECT p.g, CAST(min(d) + 1 AS BIGINT) AS cycle_length FROM p JOIN dd ON dd.g = p.g AND dd.s = p.dst AND dd.v = p.src WHERE d + 1 BETWEEN 3 AND 8 GROUP BY 1),
 root AS (SELECT g, v, min(s) AS s FROM ud GROUP BY 1, 2), side AS MATERIALIZED (SELECT g, v, d % 2 AS odd FROM root JOIN ud USING (g, s, v)),
 halves AS (SELECT g, count(*) FILTER (odd = 0) AS l, count(*) FILTER (odd = 1) AS r FROM side GROUP BY 1),
 cross_ AS (SELECT mc.g, count(*) AS e, count(*) FILTER (x.odd <> y.odd) AS c FROM mc JOIN side x ON x.g = mc.g AND x.v = src JOIN side y ON y.g = mc.g AND y.v = dst WHERE src <> dst GROUP BY 1),
 starts AS (SELECT g, v FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = n.g AND p.dst = n.v) UNION SELECT g, v FROM n WHERE g NOT IN (SELECT g FROM n m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = m.g AND p.dst = m.v))),
 lay AS (SELECT dd.g, s, d, count(*) AS w FROM dd JOIN starts ON starts.g = dd.g AND starts.v = dd.s WHERE d > 0 GROUP BY 1, 2, 3), deep AS (SELECT g, s, d, w, min(w) OVER (PARTITION BY g, s ORDER BY d) AS narrowest FROM lay),
 stacks AS (SELECT g, s, count(*) AS k, list(w ORDER BY d) AS ws FROM deep WHERE narrowest >= 2 GROUP BY 1, 2), best AS (SELECT g, k, ws, row_number() OVER (PARTITION BY g ORDER BY k DESC, s) AS o FROM stacks),
 j AS (SELECT *, coalesce(e > 0 AND c = e AND least(l, r) >= 2, false) AS two FROM size LEFT JOIN dia USING (g) LEFT JOIN chain USING (g) LEFT JOIN cyc USING (g) LEFT JOIN halves USING (g) LEFT JOIN cross_ USING (g) LEFT JOIN (SELECT g, k, ws FROM best WHERE o = 1) USING (g))
SELECT g, cycle_length, CAST(chain_length AS BIGINT) AS chain_length, chain_length >= 3 AS chain, two AS bipartite, CASE WHEN e > 0 THEN round(c / e * least(l, r) / greatest(l, r), 6) ELSE 0.0 END AS bipartite_score, CASE WHEN two THEN l END AS left_size, CASE WHEN two THEN r END AS right_size,
 CASE WHEN k >= 3 THEN k END AS stack_depth, CASE WHEN k >= 3 THEN array_to_string(ws, ',') END AS layer_widths, CASE WHEN n > 1 THEN CAST(diameter AS BIGINT) END AS diameter FROM j""")
def motif_shapes(spark, d):
    """Cycles, longest paths, colouring, layers and diameter of small flagged cases."""
    return facts.shape_motifs(motif_cases(spark, d), "g").withColumn("layer_widths", F.array_join(F.col("layer_widths").cast("array<string>"), ","))


_FIRED = """fo AS (SELECT g, src AS v, count(DISTINCT dst) AS w FROM mc WHERE src <> dst GROUP BY 1, 2), fi AS (SELECT g, dst AS v, count(DISTINCT src) AS w FROM mc WHERE src <> dst GROUP BY 1, 2),
 f AS (SELECT g, coalesce(max(fo.w) >= 3, false) AS fan_out FROM (SELECT DISTINCT g FROM mc) LEFT JOIN fo USING (g) GROUP BY 1), h AS (SELECT g, coalesce(max(fi.w) >= 3, false) AS fan_in FROM (SELECT DISTINCT g FROM mc) LEFT JOIN fi USING (g) GROUP BY 1)"""


@query("inferred_typology", f"""{W}, {MOTIF_CASE_SQL}, {_FIRED} SELECT g, CASE WHEN fan_out THEN 'fan_out' WHEN fan_in THEN 'fan_in' ELSE 'unclassified' END AS typology, CASE WHEN fan_out OR fan_in THEN 'inferred' ELSE 'none' END AS source,
 CASE WHEN fan_out AND fan_in THEN 0.7 WHEN fan_out OR fan_in THEN 0.5 ELSE 0.0 END AS confidence, 'case_structure' AS scope FROM f JOIN h USING (g)""")
def inferred_typology(spark, d):
    """What the fans alone say of cases without a known typology."""
    e = motif_cases(spark, d)
    j = facts.fan_out(e, "g").select("g", F.col("present").alias("fan_out")).join(facts.fan_in(e, "g").select("g", F.col("present").alias("fan_in")), "g")
    j = j.withColumns({m: F.lit(False) for m in facts.SHAPE_PRIORITY if not m.startswith("fan")})
    return facts.resolve_typology(j, False).select("g", "typology", "source", "confidence", "scope")


@query("khop_cut")
def khop_cut(spark, d):
    """Accounts within two capped hops of every sender on a flagged edge, 30 days around it."""
    e = txn(spark, d)
    seeds = e.where("is_laundering").groupBy(F.col("src").alias("node_id")).agg(F.min("ts").alias("m")).select(F.concat(F.lit("case-"), F.col("node_id")).alias("case_id"), "node_id", (F.col("m") - F.expr("INTERVAL 30 DAYS")).alias("start"), (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    return graph.expand(e, seeds, 2, 64)


@query("case_prune")
def case_prune(spark, d):
    """Case edges that fit in 150 accounts, protected ones first (order-dependent).

    A case is some neighbouring orders, so that its protected edges leave room for others however many orders there are.
    """
    e = txn(spark, d).select(F.expr("CAST(CAST(split_part(transaction_key, '|', 1) AS BIGINT) div 1164 AS STRING)").alias("case_id"), "src", "dst", "amount_paid", "is_laundering", "transaction_key")
    return graph.prune(e)


@query("edge_gap", f"{W}, t AS (SELECT DISTINCT v, epoch_us(ts) AS m FROM (SELECT src AS v, ts FROM txn UNION ALL SELECT dst, ts FROM txn)), l AS (SELECT v, m, lag(m) OVER (PARTITION BY v ORDER BY m) AS prev FROM t) SELECT transaction_key, src, ts, (epoch_us(ts) - prev) / 3600000000.0 AS gap_hours FROM txn JOIN l ON src = v AND epoch_us(ts) = m")
def edge_gap(spark, d):
    return facts.gap_since_touch(txn(spark, d))


@query("feature_zscore", f"{W}, x AS (SELECT transaction_key, payment_currency, ln(1 + greatest(amount_paid, 0.0)) AS x, ts < TIMESTAMP '1999-01-01' AS tr FROM txn), s AS (SELECT payment_currency, avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE tr GROUP BY 1), g AS (SELECT avg(x) AS gm, stddev_pop(x) AS gs FROM x WHERE tr) SELECT transaction_key, payment_currency, round(greatest(-8.0, least(8.0, (x - coalesce(m, gm)) / CASE WHEN coalesce(sd, gs) > 0 THEN coalesce(sd, gs) ELSE 1.0 END)), 4) AS z FROM x LEFT JOIN s USING (payment_currency) CROSS JOIN g")
def feature_zscore(spark, d):
    return facts.zscores(txn(spark, d), F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("z", F.round("z", 4))


@query("soft_branching_scores", f"""{W}, p AS (SELECT DISTINCT src_bank, src, dst FROM txn WHERE src <> dst), fo AS (SELECT src_bank, max(n) AS a FROM (SELECT src_bank, src, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1), fi AS (SELECT src_bank, max(n) AS b FROM (SELECT src_bank, dst, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
 q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.src_bank = p.src_bank AND z.src = p.dst AND z.dst = p.src)), i AS (SELECT src_bank, dst AS v, count(*) AS i FROM q GROUP BY 1, 2), o AS (SELECT src_bank, src AS v, count(*) AS o FROM q GROUP BY 1, 2), h AS (SELECT src_bank, max(least(i, o)) AS h FROM i JOIN o USING (src_bank, v) GROUP BY 1),
 m AS (SELECT src_bank, max(n) AS m FROM (SELECT x.src_bank, x.src, y.dst, count(*) AS n FROM p x JOIN p y ON x.src_bank = y.src_bank AND x.dst = y.src WHERE x.src <> y.dst GROUP BY 1, 2, 3) GROUP BY 1)
SELECT src_bank, least(1.0, greatest(0.0, (a - 3) / 13)) AS fan_out, least(1.0, greatest(0.0, (b - 3) / 13)) AS fan_in, least(1.0, greatest(0.0, (coalesce(h, 0) - 2) / 6)) AS gather_scatter, least(1.0, greatest(0.0, (coalesce(m, 0) - 2) / 6)) AS scatter_gather FROM fo JOIN fi USING (src_bank) LEFT JOIN h USING (src_bank) LEFT JOIN m USING (src_bank)""")
def soft_branching_scores(spark, d):
    return motif_scores.branching_scores(txn(spark, d), "src_bank")


@query("soft_motif_scores")
def soft_motif_scores(spark, d):
    """All seven scores of the cases (three follow order: tested against known shapes)."""
    return motif_scores.motif_scores(txn(spark, d))


@query("licit_nodes", f"{W}, {_HIT} SELECT DISTINCT v AS node_id FROM (SELECT src AS v FROM txn UNION SELECT dst FROM txn) WHERE v NOT IN (SELECT v FROM hit)")
def licit_nodes(spark, d):
    e = txn(spark, d)
    return graph.node_table(e).select("node_id").join(facts.flagged_nodes(e), "node_id", "left_anti")


@query("positive_seeds", f"""{W}, s AS (SELECT pattern_id, src AS v, count(*) AS n FROM txn WHERE pattern_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT pattern_id, dst, count(*) FROM txn WHERE pattern_id IS NOT NULL GROUP BY 1, 2), g AS (SELECT pattern_id, v, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, v) AS k FROM g) SELECT pattern_id, v AS node_id, n FROM r WHERE k <= 12""")
def positive_seeds(spark, d):
    return graph.positive_seeds(txn(spark, d))


@query("graph_reference_check", f"""{W}, n AS (SELECT case_id, count(DISTINCT v) AS stored_nodes FROM (SELECT case_id, src AS v FROM txn UNION SELECT case_id, dst FROM txn) GROUP BY 1), e AS (SELECT case_id, count(*) AS stored_edges FROM txn GROUP BY 1), f AS (SELECT case_id, n_edges FROM (SELECT case_id, count(*) AS n_edges FROM txn WHERE payment_currency <> 'R' GROUP BY 1))
SELECT concat('store#', case_id) AS graph_ref, stored_nodes, stored_edges, n_edges, coalesce(stored_edges = n_edges, false) AS resolves FROM n JOIN e USING (case_id) FULL JOIN f USING (case_id)""")
def graph_reference_check(spark, d):
    e = txn(spark, d)
    f = e.where("payment_currency <> 'R'").groupBy("case_id").agg(F.count("*").alias("n_edges"))
    return graph.reference_check(e, f, "store")


@query("published_statistics", f"{W} SELECT 'n_edges' AS name, CAST(count(*) AS DOUBLE) AS observed, 60000.0 AS published, CAST(count(*) - 60000 AS DOUBLE) AS delta FROM txn UNION ALL SELECT 'n_nodes', CAST(count(*) AS DOUBLE), 1000.0, CAST(count(*) - 1000 AS DOUBLE) FROM (SELECT src FROM txn UNION SELECT dst FROM txn)")
def published_statistics(spark, d):
    e = txn(spark, d)
    seen = e.agg(F.lit("n_edges").alias("name"), F.count("*").cast("double").alias("observed")).unionByName(graph.node_table(e).agg(F.lit("n_nodes").alias("name"), F.count("*").cast("double").alias("observed")))
    return graph.compare_to_published(seen, {"n_edges": 60000.0, "n_nodes": 1000.0})
