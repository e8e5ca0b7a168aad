"""Case stores, corpora of training records, outputs of systems, append-only logs, and the second substrate's graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stores import VERSION, id_list_hash, read_json, write_json
from .transactions import resolve_column


class Refused(ValueError):
    """A corpus that must not be used as asked."""


def none_of(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows; reading one for which `bad` holds raises (in the plan, without a job of its own)."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


# --- cases ----------------------------------------------------------------------------------------------

@dataclass
class CaseStore:
    """cases (case_id, ...), case_nodes (case_id, node_id), case_edges (case_id, transaction_key)."""

    cases: DataFrame
    case_nodes: DataFrame
    case_edges: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, cases: DataFrame) -> CaseStore:
        """From edges that carry their case."""
        nodes = edges.select("case_id", F.col("src").alias("node_id")).union(edges.select("case_id", "dst")).distinct()
        return cls(cases, nodes, edges.select("case_id", "transaction_key").distinct())

    def save(self, path: str) -> None:
        """Cases as JSON lines, memberships as Parquet, and a manifest with the hash of the ids."""
        spark = self.cases.sparkSession
        self.cases.write.mode("overwrite").json(f"{path}/cases")
        for name in ("case_nodes", "case_edges"):
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        row = id_list_hash(self.cases, "case_id").first()
        write_json(spark, f"{path}/manifest.json", {"version": VERSION, "ids_sha256": row["ids_sha256"], "n": row["n"], "schema": self.cases.schema.json()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CaseStore:
        """The store, if its version is known and its ids are those of the manifest."""
        import json

        from pyspark.sql.types import StructType

        about = read_json(spark, f"{path}/manifest.json")
        if about["version"] != VERSION:
            raise ValueError(f"version {about['version']} instead of {VERSION}")
        cases = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).json(f"{path}/cases")
        if id_list_hash(cases, "case_id").first()["ids_sha256"] != about["ids_sha256"]:
            raise ValueError("the ids of the cases have changed")
        return cls(cases, spark.read.parquet(f"{path}/case_nodes"), spark.read.parquet(f"{path}/case_edges"))

    def subset(self, ids: DataFrame) -> CaseStore:
        own = ids.select("case_id").distinct()
        return CaseStore(*(t.join(own, "case_id", "left_semi") for t in (self.cases, self.case_nodes, self.case_edges)))

    def materialise(self, edges: DataFrame) -> DataFrame:
        """The cases' edges, in place order within each case when sorted by `canonical_sort`."""
        return edges.drop("case_id").join(self.case_edges, "transaction_key")

    def edges_of(self, edges: DataFrame) -> DataFrame:
        """Edges of any of the cases, once each."""
        return edges.join(self.case_edges.select("transaction_key").distinct(), "transaction_key", "left_semi")


def canonical_sort(edges: DataFrame) -> DataFrame:
    """Edges by case, time, ends, amounts and key: a sort inside each case, not of the whole table."""
    order = ["ts", "src", "dst", "amount_received", "amount_paid", "transaction_key"]
    return edges.repartition("case_id").sortWithinPartitions("case_id", *order)


def passthrough_case(edges: DataFrame, case_id: str) -> DataFrame:
    """A graph given as it is becomes one case."""
    return edges.withColumn("case_id", F.lit(case_id))


def check_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Case edges whose ends the case's nodes hold; reading one that dangles raises."""
    known = nodes.select("case_id", "node_id").distinct().withColumn("_k", F.lit(True))
    a = known.select("case_id", F.col("node_id").alias("src"), F.col("_k").alias("_a"))
    b = known.select("case_id", F.col("node_id").alias("dst"), F.col("_k").alias("_b"))
    j = edges.join(a, ["case_id", "src"], "left").join(b, ["case_id", "dst"], "left")
    return none_of(j, F.col("_a").isNull() | F.col("_b").isNull(), "an edge's end is not in its case").select(*edges.columns)


def require_transaction_keys(df: DataFrame) -> DataFrame:
    if "transaction_key" not in df.columns:
        raise ValueError("transactions need their transaction_key")
    return df


# --- the second substrate ---------------------------------------------------------------------------------

BACKGROUND = ("background_nodes.csv", "background_edges.csv", "connected_components.csv")


def is_available(spark: SparkSession, path: str) -> bool:
    """Whether all of its files are there."""
    at = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
    return all(at(n).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(n)) for n in BACKGROUND)


@dataclass
class BackgroundGraph:
    """Lazy scans: nodes (node_id, features), edges (src, dst, features)."""

    nodes: DataFrame
    edges: DataFrame

    def counts(self) -> DataFrame:
        """name, n: no row leaves the executors."""
        return self.nodes.agg(F.lit("nodes").alias("name"), F.count("*").alias("n")).unionByName(self.edges.agg(F.lit("edges").alias("name"), F.count("*").alias("n")))


def load_background_graph(spark: SparkSession, path: str) -> BackgroundGraph:
    """Columns of ids are found by their names, whatever the case; ids are read as text."""
    if not is_available(spark, path):
        raise FileNotFoundError(f"{path} lacks one of {BACKGROUND}")
    nodes, edges = (spark.read.option("header", True).csv(f"{path}/{n}") for n in BACKGROUND[:2])
    i = resolve_column(nodes, "clusterId", "node_id", "id")
    a, b = resolve_column(edges, "clusterId1", "src", "source"), resolve_column(edges, "clusterId2", "dst", "target")
    return BackgroundGraph(nodes.withColumnRenamed(i, "node_id"), edges.withColumnRenamed(a, "src").withColumnRenamed(b, "dst"))


# --- records, outputs, corpora ----------------------------------------------------------------------------

def load_case_facts(records: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON texts as typed records; one that doesn't give the same JSON again raises when read (unknown, missing or mistyped fields)."""
    out = records.withColumn("facts", F.from_json(column, schema, {"mode": "FAILFAST"}))
    again = F.to_json("facts", {"ignoreNullFields": "false"})
    return none_of(out, ~again.eqNullSafe(F.col(column)), "a record does not read back as it is written")


def load_reservation(spark: SparkSession, path: str, placed: DataFrame | None = None) -> DataFrame:
    """(case_id) held back for the gold set; with (case_id, split), one outside the test split raises."""
    ids = spark.read.option("multiLine", True).json(path).select(F.explode("case_ids").alias("case_id")).distinct()
    if placed is None:
        return ids
    j = ids.join(placed.select("case_id", "split"), "case_id", "left")
    return none_of(j, ~F.col("split").eqNullSafe("test"), "a reserved case is not in the test split").select("case_id")


def not_reserved(rows: DataFrame, reservation: DataFrame) -> DataFrame:
    """The rows; reading one whose case is reserved raises."""
    j = rows.join(reservation.select("case_id", F.lit(True).alias("_held")), "case_id", "left")
    return none_of(j, F.col("_held").isNotNull(), "a reserved case must not be used").drop("_held")


def load_training_records(corpus: DataFrame, split: str, reservation: DataFrame | None = None, allow_gold: bool = False) -> DataFrame:
    """One split's records. Gold records and reserved cases raise, unless gold is asked for."""
    own = corpus.where(F.col("split") == split)
    if not allow_gold:
        own = none_of(own, F.col("tier") == "gold", "gold records are for evaluation alone")
    return own if reservation is None or allow_gold else not_reserved(own, reservation)


def first_narrative(df: DataFrame) -> Column:
    """The first of narrative, target_narrative, text and texts[0] that isn't blank."""
    some = lambda c: F.when(F.trim(c) != "", c)
    found = [some(F.col(c)) for c in ("narrative", "target_narrative", "text") if c in df.columns]
    found += [some(F.get("texts", F.lit(0)))] if "texts" in df.columns else []
    if not found:
        raise Refused(f"none of narrative, target_narrative, text, texts in {df.columns}")
    return F.coalesce(*found)


def load_system_outputs(rows: DataFrame, system: str | None = None, seed: int | None = None, stream: str = "balanced", limit: int | None = None) -> DataFrame:
    """case_id, system, seed, stream, narrative. Rows without a case or a narrative raise when read. limit: a report's first rows by case."""
    names = [F.lit(system)] if system else [F.col(c) for c in ("system", "tier") if c in rows.columns]
    if not names:
        raise Refused("outputs name no system")
    out = rows.select("case_id", F.coalesce(*names).alias("system"), (F.lit(seed) if seed is not None else F.col("seed") if "seed" in rows.columns else F.lit(None)).cast("int").alias("seed"), F.lit(stream).alias("stream"), first_narrative(rows).alias("narrative"))
    out = none_of(out, F.col("case_id").isNull() | F.col("narrative").isNull(), "an output lacks its case or its narrative")
    return out if limit is None else out.orderBy("case_id").limit(limit)


def load_bronze_corpus(rows: DataFrame) -> DataFrame:
    """case_id, split, narrative, facts of corpus records."""
    return rows.select("case_id", "split", first_narrative(rows).alias("narrative"), "facts")


def pair_outputs_with_facts(outputs: DataFrame, facts: DataFrame, references: DataFrame | None = None, on_missing: str = "raise") -> DataFrame:
    """Outputs with their facts, and their reference where there is one. A case without facts raises when read, or is left out (`skip`)."""
    j = outputs.join(facts.withColumn("_there", F.lit(True)), "case_id", "left")
    j = none_of(j, F.col("_there").isNull(), "an output's case has no facts") if on_missing == "raise" else j.where("_there")
    j = j.drop("_there")
    return j if references is None else j.join(references.select("case_id", F.col("narrative").alias("reference")), "case_id", "left")


def latest_runs(runs: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (system, seed, completed, at, ...) the newest completed run of each registered (system, seed), and the pairs that have none."""
    done = runs.where("completed").join(specs.select("system", "seed").distinct(), ["system", "seed"], "left_semi")
    first = done.withColumn("_n", F.row_number().over(W.partitionBy("system", "seed").orderBy(F.desc("at")))).where("_n = 1").drop("_n")
    return first, specs.select("system", "seed").distinct().join(done, ["system", "seed"], "left_anti")


#: Keys of a blinded pool that would give its system away.
REVEALING = ("system", "tier", "generator", "model", "seed", "run_id")


def load_narratives(rows: DataFrame) -> DataFrame:
    """(item, text) of a blinded pool: a column that gives the system away and a repeated item raise."""
    if told := sorted(set(rows.columns) & set(REVEALING)):
        raise Refused(f"{told} would unblind the pool")
    n = rows.select("item", "text").withColumn("_n", F.count("*").over(W.partitionBy("item")))
    return none_of(n, F.col("_n") > 1, "an item comes twice").drop("_n")


def read_jsonl_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema. A broken last line of a file (a writer that was stopped) is left out; one before it raises when read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    parsed = lines.where(F.trim("value") != "").withColumn("_x", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = W.partitionBy("_f").orderBy(F.desc("_at"))
    broken = parsed.where(F.col("_x._bad").isNotNull()).select("_f", "_at").withColumn("_k", F.row_number().over(last))
    ends = parsed.groupBy("_f").agg(F.max("_at").alias("_end"))
    wrong = broken.join(ends, "_f").where((F.col("_k") > 1) | (F.col("_at") != F.col("_end"))).limit(1)
    if wrong.take(1):
        raise ValueError(f"a line of {path} is broken before its end")
    return parsed.where(F.col("_x._bad").isNull()).select("_x.*").drop("_bad")


# --- append-only logs -------------------------------------------------------------------------------------

@dataclass
class Log:
    """An append-only table: every append is a commit of its own files, in the order of `at`."""

    spark: SparkSession
    path: str
    schema: str
    by: tuple[str, ...] = ()

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("at", F.current_timestamp()).write.mode("append").partitionBy(*self.by).parquet(self.path)

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"{self.schema}, at timestamp")
        return self.spark.read.schema(f"{self.schema}, at timestamp").parquet(self.path)


def error_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, "case_id string, kind string, message string")


def annotation_store(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, "case_id string, annotator string, payload string", ("annotator",))


class ResponseCache:
    """Responses by the content of their request: a request is answered from here or is still to be sent."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, "request_key string, response string")

    def put(self, responses: DataFrame) -> None:
        self.log.append(responses.select("request_key", "response"))

    def split(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Requests (request_key, ...) with their first kept response, and those without one."""
        first = self.log.read().groupBy("request_key").agg(F.min_by("response", F.struct("at", "response")).alias("response"))
        return requests.join(first, "request_key"), requests.join(first, "request_key", "left_anti")


def generate_pending(requests: DataFrame, cache: ResponseCache, errors: Log, call, key: str = "case_id") -> DataFrame:
    """Answers what the cache lacks, by partition, with a client that `call` makes (once a task): its failures go to the log.

    Returns all requests that have a response now.
    """
    from .stores import scratch_table

    _, rest = cache.split(requests)

    def run(batches):
        import pandas as pd

        client = call()
        for b in batches:
            out = []
            for k, prompt, i in zip(b["request_key"], b["prompt"], b[key], strict=True):
                try:
                    out.append((k, client(prompt), i, None, None))
                except Exception as e:  # a failed request is a row of the log
                    out.append((k, None, i, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["request_key", "response", "case_id", "kind", "message"])

    done = scratch_table(requests.sparkSession, rest.select("request_key", "prompt", key).mapInPandas(run, "request_key string, response string, case_id string, kind string, message string"))
    cache.put(done.where("response IS NOT NULL"))
    errors.append(done.where("kind IS NOT NULL").select("case_id", "kind", "message"))
    return cache.split(requests)[0]
