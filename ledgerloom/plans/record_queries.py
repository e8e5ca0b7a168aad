"""Queries of records, stores and corpora, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import cases, facts, records
from ..sources import corpora, stores
from ..sources.transactions import TXN_SQL, TYPOLOGIES, txn
from .case_queries import CASES, SPLITS, index, split
from .evaluation_queries import FACTS_SQL, fact_table
from .graph_queries import MOTIF_CASE_SQL, TYPED_SQL, motif_cases, typed
from .registry import query

W = f"WITH {TXN_SQL}"
SMALL = f"""{W}, {MOTIF_CASE_SQL}, sm AS (SELECT * EXCLUDE (case_id, g), g AS case_id FROM mc)"""


def small(spark, d):
    return motif_cases(spark, d).drop("case_id").withColumnRenamed("g", "case_id")


def _folder(spark) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "/tmp/checkpoints/ledgerloom"
    return f"{root}/store-{uuid.uuid4().hex}"


def seeds(e):
    return e.groupBy("case_id").agg(F.min("src").alias("seed_node"))


_FOCAL = """focal AS (SELECT case_id, min(src) AS node_id FROM sm GROUP BY 1)"""


@query("case_records", f"""{SMALL}, {_FOCAL}, p AS (SELECT DISTINCT case_id, src, dst FROM sm WHERE src <> dst), n AS (SELECT case_id, src AS v FROM sm UNION SELECT case_id, dst FROM sm),
 i AS (SELECT case_id, dst AS v, count(*) AS a FROM p GROUP BY 1, 2), o AS (SELECT case_id, src AS v, count(*) AS b FROM p GROUP BY 1, 2), size AS (SELECT case_id, count(*) AS n_nodes FROM n GROUP BY 1),
 r AS (SELECT f.case_id, node_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM focal f LEFT JOIN i ON i.case_id = f.case_id AND i.v = node_id LEFT JOIN o ON o.case_id = f.case_id AND o.v = node_id),
 l AS (SELECT case_id, count(*) AS n_edges, count(*) FILTER (is_laundering) AS n_illicit, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS span_hours FROM sm GROUP BY 1),
 k AS (SELECT case_id, count(DISTINCT b) AS n_banks FROM (SELECT case_id, src_bank AS b FROM sm UNION SELECT case_id, dst_bank FROM sm) GROUP BY 1)
SELECT case_id, n_nodes, n_edges, n_banks, node_id AS focal, CASE WHEN a + b = 0 THEN 'terminal' WHEN a = 0 THEN 'originator' WHEN b = 0 THEN 'beneficiary' WHEN least(a, b) >= 5 THEN 'hub' WHEN a = 1 AND b = 1 THEN 'pass_through' ELSE 'intermediary' END AS role,
 span_hours, n_illicit, n_nodes AS n_illicit_accounts, 'unclassified' AS typology, n_nodes AS inventory FROM size JOIN r USING (case_id) JOIN l USING (case_id) JOIN k USING (case_id)""")
def case_records(spark, d):
    """One record per small flagged case, some of its fields."""
    e = small(spark, d).withColumn("typology", F.lit(None).cast("string"))
    r = records.extract_facts(e, seeds(e), order=TYPOLOGIES)
    return r.select("case_id", "structure.n_nodes", "structure.n_edges", "structure.n_banks", F.col("focal_entity.node_id").alias("focal"), "focal_entity.role", "temporal.span_hours", F.col("labels.n_illicit_transactions").alias("n_illicit"), "labels.n_illicit_accounts", "typology.typology", F.size("entity_inventory").cast("long").alias("inventory"))


@query("fact_panel", f"{SMALL}, n AS (SELECT case_id, src AS v FROM sm UNION SELECT case_id, dst FROM sm) SELECT case_id, 'labels' AS section, 'n_illicit_transactions' AS label, CAST(count(*) AS VARCHAR) AS value FROM sm GROUP BY 1 UNION ALL SELECT case_id, 'labels', 'n_illicit_accounts', CAST(count(*) AS VARCHAR) FROM n GROUP BY 1")
def fact_panel(spark, d):
    e = small(spark, d).withColumn("typology", F.lit(None).cast("string"))
    return records.fact_panel(records.extract_facts(e, seeds(e), order=TYPOLOGIES), "case_id", ["labels"])


@query("record_round_trip", f"{SMALL} SELECT case_id, count(*) AS n_edges, 'n' AS path, true AS populated FROM sm GROUP BY 1")
def record_round_trip(spark, d):
    """Records as JSON, read back as typed records that must give the same JSON again, and their leaves."""
    r = small(spark, d).groupBy("case_id").agg(F.struct(F.struct(F.count("*").alias("n")).alias("structure")).alias("record"))
    told = r.select("case_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("json"))
    back = corpora.load_case_facts(told, "json", r.schema["record"].dataType.simpleString())
    leaves = canonical.leaf_paths(back.withColumn("structure", F.col("facts.structure")), "case_id", "structure")
    return back.select("case_id", F.col("facts.structure.n").alias("n_edges")).join(leaves, "case_id")


@query("case_store_round_trip", f"{SMALL} SELECT case_id, count(*) AS n_edges, count(DISTINCT src) AS n_senders FROM sm WHERE CAST(case_id AS BIGINT) % 2 = 0 GROUP BY 1")
def case_store_round_trip(spark, d):
    """Cases written, read again, cut down to a half, and their edges gathered."""
    e = small(spark, d)
    path = _folder(spark)
    corpora.CaseStore.of(e, e.groupBy("case_id").agg(F.count("*").alias("n_edges"))).save(path)
    half = corpora.CaseStore.load(spark, path)
    half = half.subset(half.cases.where("CAST(case_id AS BIGINT) % 2 = 0"))
    return corpora.canonical_sort(half.materialise(e)).groupBy("case_id").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_senders"))


@query("case_ids", f"""{W} SELECT DISTINCT src AS seed_node, concat('set-', sha256(concat('{{"k_hops":2,"seed_node":"', src, '"}}'))[1:16]) AS case_id FROM txn""")
def case_ids(spark, d):
    s = txn(spark, d).select(F.col("src").alias("seed_node"), F.lit(2).alias("k_hops")).distinct()
    return s.select("seed_node", canonical.case_id_for(s, "set", "seed_node", "k_hops").alias("case_id"))


@query("case_banks", f"{W} SELECT case_id, n_banks, cross_bank FROM (SELECT case_id, count(DISTINCT b) AS n_banks FROM (SELECT case_id, src_bank AS b FROM txn UNION SELECT case_id, dst_bank FROM txn) GROUP BY 1) JOIN (SELECT case_id, bool_or(src_bank <> dst_bank) AS cross_bank FROM txn GROUP BY 1) USING (case_id)")
def case_banks(spark, d):
    return records.banks(txn(spark, d))


@query("focal_flow", f"""{SMALL}, {_FOCAL}, x AS (SELECT s.*, node_id FROM sm s JOIN focal USING (case_id) WHERE src <> dst), o AS (SELECT case_id, count(DISTINCT payment_currency) AS k, CAST(sum(CAST(amount_paid AS DECIMAL(38,6))) AS DOUBLE) AS v FROM x WHERE src = node_id GROUP BY 1),
 i AS (SELECT case_id, count(DISTINCT receiving_currency) AS k, CAST(sum(CAST(amount_received AS DECIMAL(38,6))) AS DOUBLE) AS v FROM x WHERE dst = node_id GROUP BY 1), u AS (SELECT case_id FROM o UNION SELECT case_id FROM i)
SELECT u.case_id, CASE WHEN o.k = 1 THEN o.v END AS total_out, CASE WHEN o.k IS NULL THEN '{facts.NO_TRANSFERS}' WHEN o.k > 1 THEN '{facts.MULTI_CURRENCY}' END AS total_out_reason, CASE WHEN i.k = 1 THEN i.v END AS total_in, CASE WHEN i.k IS NULL THEN '{facts.NO_TRANSFERS}' WHEN i.k > 1 THEN '{facts.MULTI_CURRENCY}' END AS total_in_reason
FROM u LEFT JOIN o USING (case_id) LEFT JOIN i USING (case_id)""")
def focal_flow(spark, d):
    e = small(spark, d)
    return facts.flatten(records.focal_flow(e, seeds(e).withColumnRenamed("seed_node", "node_id")).select("case_id", "total_out", "total_in"), "total_out", "total_in")


@query("displayed_accounts", f"""{SMALL}, {_FOCAL}, p AS (SELECT DISTINCT case_id, src, dst FROM sm WHERE src <> dst), n AS (SELECT case_id, src AS v FROM sm UNION SELECT case_id, dst FROM sm),
 g AS (SELECT n.case_id, v, (SELECT count(*) FROM p WHERE p.case_id = n.case_id AND p.src = v) + (SELECT count(*) FROM p WHERE p.case_id = n.case_id AND p.dst = v) AS degree,
  CASE WHEN v = node_id THEN 0 WHEN EXISTS (SELECT 1 FROM p WHERE p.case_id = n.case_id AND ((src = v AND dst = node_id) OR (dst = v AND src = node_id))) THEN 1 ELSE 2 END AS tier FROM n JOIN focal USING (case_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY tier, degree DESC, v) AS k, count(*) OVER (PARTITION BY case_id) AS c FROM g) SELECT case_id, v AS node_id, greatest(c - 10, 0) AS n_hidden FROM r WHERE k <= 10""")
def displayed_accounts(spark, d):
    e = small(spark, d)
    return records.displayed(e, seeds(e).withColumnRenamed("seed_node", "node_id"), 10)


@query("case_timeline", f"{W}, e AS (SELECT case_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM txn GROUP BY 1) SELECT case_id, CAST(CASE WHEN b > a THEN least(23, floor((epoch_us(ts) - a) * 24 / (b - a))) ELSE 0 END AS INTEGER) AS bucket, count(*) AS n FROM txn JOIN e USING (case_id) GROUP BY 1, 2")
def case_timeline(spark, d):
    return records.timeline(txn(spark, d))


@query("case_encodings", f"""{SMALL}, u AS (SELECT case_id, src AS v, dst AS w FROM sm WHERE src <> dst UNION SELECT case_id, dst, src FROM sm WHERE src <> dst), d AS (SELECT case_id, v, count(*) AS k FROM u GROUP BY 1, 2), n AS (SELECT case_id, src AS v FROM sm UNION SELECT case_id, dst FROM sm),
 b AS (SELECT u.case_id, u.v, sum(1.0 / (x.k * y.k)) AS s FROM u JOIN d x ON x.case_id = u.case_id AND x.v = u.v JOIN d y ON y.case_id = u.case_id AND y.v = u.w GROUP BY 1, 2) SELECT n.case_id, n.v AS node_id, round(coalesce(s, 0.0), 5) AS back_in_two, CAST(8 AS INTEGER) AS n_laplacian FROM n LEFT JOIN b ON b.case_id = n.case_id AND b.v = n.v""")
def case_encodings(spark, d):
    """The chance that a walk is back after two steps."""
    e = records.encodings(small(spark, d))
    return e.select("case_id", "node_id", F.round(F.col("walk_pe")[1].cast("double"), 5).alias("back_in_two"), F.size("laplacian_pe").alias("n_laplacian"))


_POOL = "pool AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS typology FROM customer WHERE c_custkey % 10 = 0), asked AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id FROM customer WHERE c_custkey % 5 = 0)"


@query("exemplars", f"""WITH {_POOL}, t AS (SELECT a.case_id, coalesce(p.typology, '') AS typology, list_sum(list_transform(string_split(a.case_id, ''), lambda c: ascii(c))) AS off FROM asked a LEFT JOIN pool p USING (case_id)),
 c AS (SELECT t.case_id, off, p.case_id AS x, CASE WHEN p.typology = t.typology THEN 0 ELSE 1 END AS side FROM t JOIN pool p ON p.case_id <> t.case_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY case_id, side) AS n FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY side, (k - off % n + n) % n) AS place FROM r)
SELECT case_id, CAST(place - 1 AS INTEGER) AS rank, x AS exemplar FROM o WHERE place <= 3""")
def exemplars(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("typology"), F.lit("train").alias("split"))
    return records.exemplars(c.where("CAST(case_id AS INT) % 5 = 0"), c.where("CAST(case_id AS INT) % 10 = 0"), 3)


@query("side_by_side", f"""WITH {_POOL}, r AS (SELECT *, sha256(concat('17:', case_id)) AS h FROM pool), k AS (SELECT *, row_number() OVER (PARTITION BY typology ORDER BY h, case_id) AS k FROM r), o AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE 1 END AS f FROM k)
SELECT case_id, CAST(row_number() OVER (ORDER BY f, CASE WHEN f = 0 THEN typology END NULLS FIRST, h, case_id) AS INTEGER) AS place FROM o ORDER BY place LIMIT 12""")
def side_by_side(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 10 = 0")
    return records.side_by_side(c.select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("typology")))


DESCRIPTORS = [("busy", "flow.n_out", ">= 20"), ("quiet", "flow.n_out", "< 5"), ("large sums", "flow.total_out", "> 100000"), ("steady", "flow.n_out", ">= 10")]
_HOLDS = """ds(descriptor, place, path) AS (VALUES ('busy', 0, 'flow.n_out'), ('quiet', 1, 'flow.n_out'), ('large sums', 2, 'flow.total_out'), ('steady', 3, 'flow.n_out')),
 holding AS (SELECT case_id, descriptor, CAST(place AS INTEGER) AS place, number AS bound FROM facts JOIN ds ON path = field_path WHERE available AND number IS NOT NULL AND CASE descriptor WHEN 'busy' THEN number >= 20 WHEN 'quiet' THEN number < 5 WHEN 'large sums' THEN number > 100000 ELSE number >= 10 END)"""


@query("holding_descriptors", f"{FACTS_SQL}, {_HOLDS} SELECT * FROM holding")
def holding_descriptors(spark, d):
    return records.holding_descriptors(fact_table(spark, d), DESCRIPTORS)


@query("indicators", f"""{FACTS_SQL}, {_HOLDS}, g AS (SELECT case_id, list(descriptor ORDER BY place) AS l, count(*) AS n FROM holding GROUP BY 1), a AS (SELECT *, CAST(CAST(concat('0x', sha256(concat(case_id, ':indicators'))[1:16]) AS UBIGINT) % n AS INTEGER) AS o FROM g)
SELECT case_id, array_to_string(list_concat(l[o + 1:], l[:o])[:3], '; ') AS descriptors FROM a""")
def indicators(spark, d):
    i = records.indicators(records.holding_descriptors(fact_table(spark, d), DESCRIPTORS))
    return i.select("case_id", F.array_join("descriptors", "; ").alias("descriptors"))


@query("qualitative_verdicts", f"""{FACTS_SQL}, c AS (SELECT DISTINCT case_id FROM facts), q AS (SELECT case_id, concat(case_id, ':', t) AS claim_id, t FROM c, (VALUES ('Busy'), ('large sums'), ('odd')) v(t)),
 j AS (SELECT q.*, f.available AS a, f.number AS n FROM q LEFT JOIN facts f ON f.case_id = q.case_id AND f.field_path = CASE t WHEN 'Busy' THEN 'flow.n_out' WHEN 'large sums' THEN 'flow.total_out' END),
 v AS (SELECT case_id, claim_id, CASE WHEN NOT coalesce(a, false) OR n IS NULL THEN 'UNVERIFIABLE' WHEN CASE t WHEN 'Busy' THEN n >= 20 ELSE n > 100000 END THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict FROM j) SELECT *, CASE WHEN verdict = 'CONTRADICTED' THEN 'H2' END AS hallucination_class FROM v""")
def qualitative_verdicts(spark, d):
    f = fact_table(spark, d)
    t = F.explode(F.array(*map(F.lit, ("Busy", "large sums", "odd"))))
    c = f.select("case_id").distinct().select("case_id", t.alias("text")).withColumn("claim_id", F.concat_ws(":", "case_id", "text"))
    return records.check_qualitative(c, f, DESCRIPTORS)


@query("typology_verdicts", f"""{W}, {TYPED_SQL}, g AS (SELECT src_bank AS case_id, min(typology) AS typology, CASE WHEN md5(src_bank)[1] < '8' THEN 'ground_truth' ELSE 'inferred' END AS source FROM typed WHERE typology IS NOT NULL GROUP BY 1),
 v AS (SELECT case_id, concat(case_id, ':', t) AS claim_id, CASE WHEN t = typology THEN CASE source WHEN 'ground_truth' THEN 'SUPPORTED' ELSE 'UNVERIFIABLE' END ELSE 'CONTRADICTED' END AS verdict FROM g, (VALUES ('cycle'), ('fan_in'), ('bipartite')) c(t)) SELECT *, CASE WHEN verdict = 'CONTRADICTED' THEN 'H5' END AS hallucination_class FROM v""")
def typology_verdicts(spark, d):
    t = typed(spark, d).where("typology IS NOT NULL").groupBy(F.col("src_bank").alias("case_id")).agg(F.min("typology").alias("typology"))
    t = t.withColumn("source", F.when(F.substring(F.md5("case_id"), 1, 1) < "8", "ground_truth").otherwise("inferred"))
    c = t.select("case_id", F.explode(F.array(*map(F.lit, ("cycle", "fan_in", "bipartite")))).alias("text")).withColumn("claim_id", F.concat_ws(":", "case_id", "text"))
    return records.check_typology(c, t)


@query("template_families", f"""{CASES}, n AS (SELECT case_id, count(DISTINCT v) AS n FROM (SELECT case_id, src AS v FROM txn UNION SELECT case_id, dst FROM txn) GROUP BY 1), t AS (SELECT case_id, min(pattern_id) AS t FROM txn GROUP BY 1)
SELECT case_id, CASE WHEN n <= 2 THEN 'minimal' WHEN t = 'p0' THEN 'collection' WHEN n_flagged > 0 THEN 'unclassified_suspicious' ELSE 'no_finding' END AS family FROM cases JOIN n USING (case_id) JOIN t USING (case_id)""")
def template_families(spark, d):
    e = txn(spark, d)
    n = e.select("case_id", F.col("src").alias("v")).union(e.select("case_id", "dst")).distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    g = e.groupBy("case_id").agg(F.min("pattern_id").alias("t"), F.count_if("is_laundering").alias("k")).join(n, "case_id")
    return g.select("case_id", records.family(F.lit(True), F.col("n"), F.col("t"), F.col("k"), {"p0": "collection"}).alias("family"))


@query("strict_splits", f"""{SPLITS}, m AS (SELECT DISTINCT case_id, dst AS v FROM txn), seen AS (SELECT v FROM m JOIN splits USING (case_id) WHERE split = 'train'), bad AS (SELECT DISTINCT case_id FROM m JOIN splits USING (case_id) WHERE split = 'test' AND v IN (SELECT v FROM seen))
SELECT case_id, CASE WHEN case_id NOT IN (SELECT case_id FROM bad) THEN split END AS split, CASE WHEN case_id IN (SELECT case_id FROM bad) THEN 'node_overlap_strict' ELSE drop_reason END AS drop_reason FROM splits""")
def strict_splits(spark, d):
    m = txn(spark, d).select("case_id", F.col("dst").alias("node_id")).distinct()
    return cases.strict_splits(split(spark, d), m).select("case_id", "split", "drop_reason")


_SCORED = """n AS (SELECT case_id, date_trunc('quarter', start) AS w, CAST(CAST(concat('0x', sha256(case_id)[1:4]) AS BIGINT) AS DOUBLE) / 65536 AS motif_score FROM cases WHERE n_flagged = 0)"""


@query("partitioned_negatives", f"""{CASES}, {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY motif_score DESC, case_id) AS k, count(*) OVER (PARTITION BY w) AS c FROM n), p AS (SELECT case_id, CASE WHEN k <= round_even(c * 0.3, 0) AND motif_score >= 0.5 THEN 'hard' ELSE 'easy' END AS kind, sha256(concat('17:', case_id)) AS h FROM r),
 hard AS (SELECT case_id, kind FROM p WHERE kind = 'hard' ORDER BY h, case_id LIMIT 60) SELECT * FROM hard UNION ALL (SELECT case_id, kind FROM p WHERE kind = 'easy' ORDER BY h, case_id LIMIT (SELECT 200 - count(*) FROM hard))""")
def partitioned_negatives(spark, d):
    n = index(spark, d).where("n_flagged = 0").select("case_id", F.date_trunc("quarter", F.col("start").cast("timestamp")).alias("window_start"), F.lit(0).alias("window_end"), (F.conv(F.substring(F.sha2("case_id", 256), 1, 4), 16, 10).cast("double") / 65536).alias("motif_score"))
    return cases.partition_negatives(n, 200)


@query("gold_sample", f"{CASES}, r AS (SELECT case_id, size_bucket AS block, row_number() OVER (PARTITION BY size_bucket ORDER BY sha256(concat('17:', case_id)), case_id) AS rank FROM cases) SELECT case_id, block, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE block WHEN 'small' THEN 30 WHEN 'medium' THEN 10 ELSE 0 END")
def gold_sample(spark, d):
    return cases.gold_sample(index(spark, d).withColumnRenamed("size_bucket", "block"), {"small": 30, "medium": 10})[0]


@query("split_gates", f"""{SPLITS}, s AS (SELECT split, count(*) AS n FROM splits WHERE split IS NOT NULL GROUP BY 1) SELECT 'hard_negatives' AS gate, avg(CASE WHEN size_bucket = 'medium' THEN 1.0 ELSE 0.0 END) AS value, avg(CASE WHEN size_bucket = 'medium' THEN 1.0 ELSE 0.0 END) >= 0.2 AS passed FROM cases WHERE n_flagged = 0
 UNION ALL SELECT 'smallest_split', min(n) / sum(n), min(n) / sum(n) >= 0.05 FROM s""")
def split_gates(spark, d):
    """Medium cases stand for hard negatives."""
    c = index(spark, d).withColumn("case_class", F.when(F.col("n_flagged") > 0, "positive").when(F.col("size_bucket") == "medium", "hard_negative").otherwise("negative"))
    return cases.gate_findings(c, split(spark, d))


@query("background_counts", f"{W} SELECT 'nodes' AS name, count(*) AS n FROM (SELECT src FROM txn UNION SELECT dst FROM txn) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src, dst FROM txn)")
def background_counts(spark, d):
    """Nodes and edges written as files of the second substrate's form, and scanned."""
    e, path = txn(spark, d), _folder(spark)
    n = e.select(F.col("src").alias("clId")).union(e.select("dst")).distinct()
    n.withColumnRenamed("clId", "clusterId").write.option("header", True).csv(f"{path}/background_nodes.csv")
    e.select(F.col("src").alias("clusterId1"), F.col("dst").alias("clusterId2")).distinct().write.option("header", True).csv(f"{path}/background_edges.csv")
    n.limit(1).write.option("header", True).csv(f"{path}/connected_components.csv")
    return corpora.load_background_graph(spark, path).counts()


@query("system_outputs", "SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS system, CAST(NULL AS INTEGER) AS seed, 'balanced' AS stream, length(text) AS n_chars, turn AS fact FROM conversations WHERE text IS NOT NULL AND length(trim(text)) > 0")
def system_outputs(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").where("text IS NOT NULL AND length(trim(text)) > 0")
    key = F.concat_ws(":", "conv_id", "turn", "role", F.md5("text"))
    rows = c.select(key.alias("case_id"), F.col("role").alias("system"), F.lit(" ").alias("narrative"), "text")
    f = c.select(key.alias("case_id"), F.col("conv_id").cast("string").alias("c"), F.col("turn").alias("fact")).distinct()
    out = corpora.pair_outputs_with_facts(corpora.load_system_outputs(rows), f)
    return out.select(F.col("c").alias("case_id"), "system", "seed", "stream", F.length("narrative").cast("long").alias("n_chars"), "fact")


@query("training_records", "SELECT doc_id AS case_id, source AS tier FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0")
def training_records(spark, d):
    """One split's records, none of them reserved."""
    c = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("case_id"), F.col("source").alias("tier"), F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 3 == 0, "train").otherwise("val").alias("split"))
    held = c.where("split = 'test'").select("case_id")
    return corpora.load_training_records(c, "train", held).select("case_id", "tier")


_RUNS = "runs AS (SELECT event_type AS system, CAST(user_id % 5 AS INTEGER) AS seed, value > 10 AS completed, event_id AS moment FROM events), specs AS (SELECT DISTINCT event_type AS system, CAST(s AS INTEGER) AS seed FROM events, range(6) r(s))"


@query("latest_runs", f"WITH {_RUNS} SELECT system, seed, max(moment) AS moment FROM runs WHERE completed GROUP BY 1, 2")
def latest_runs(spark, d):
    return corpora.latest_runs(*_runs(spark, d))[0].select("system", "seed", F.col("at").alias("moment"))


@query("missing_runs", f"WITH {_RUNS} SELECT system, seed FROM specs WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE completed AND r.system = specs.system AND r.seed = specs.seed)")
def missing_runs(spark, d):
    return corpora.latest_runs(*_runs(spark, d))[1]


def _runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    runs = e.select(F.col("event_type").alias("system"), (F.col("user_id") % 5).cast("int").alias("seed"), (F.col("value") > 10).alias("completed"), F.col("event_id").alias("at"))
    return runs, runs.select("system").distinct().select("system", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seed"))


@query("dataset_digest", f"{W} SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS ids_sha256, count(*) AS n FROM (SELECT DISTINCT transaction_key AS k FROM txn)")
def dataset_digest(spark, d):
    return stores.id_list_hash(txn(spark, d).select("transaction_key").distinct(), "transaction_key")


