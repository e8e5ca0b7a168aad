"""Sinks and stores: graphs, cases, JSON lines, manifests with id hashes, resumable work, file checks, release."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = "1.0.0"


def scratch_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder (spark.checkpoint.dir; one of our own only where it is unset on this machine alone) and read again.

    The tables go when the interpreter ends, if its session still lives then.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "/tmp/checkpoints/ledgerloom"
    path = f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Hadoop's file systems: written beside its place, then renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = to.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(text.encode("utf-8"))
    out.close()
    if fs.exists(to):
        fs.delete(to, False)
    fs.rename(part, to)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value) -> None:
    _write_text(spark, path, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def read_json(spark: SparkSession, path: str):
    return json.loads(_read_text(spark, path))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, about: dict | None = None) -> None:
    nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/edges")
    write_json(nodes.sparkSession, f"{path}/graph.json", {"version": VERSION} | (about or {}))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    about = read_json(spark, f"{path}/graph.json")
    if about.get("version") != VERSION:
        raise ValueError(f"version {about.get('version')} instead of {VERSION}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), about


def id_list_hash(ids: DataFrame, column: str) -> DataFrame:
    """One row: sha256 of the sorted ids joined by line feeds, and their number.

    Ids are sorted by range on the executors and pass the driver one partition at a time, so no list of all is formed.
    """
    import hashlib

    digest, n = hashlib.sha256(), 0
    sorted_ = ids.select(F.col(column).cast("string").alias("i")).where("i IS NOT NULL").orderBy("i")
    for row in sorted_.toLocalIterator(prefetchPartitions=True):
        digest.update((b"\n" if n else b"") + row[0].encode())
        n += 1
    return ids.sparkSession.createDataFrame([(digest.hexdigest(), n)], "ids_sha256 string, n long")


def file_digests(spark: SparkSession, path: str, large: int = 1 << 30) -> DataFrame:
    """name, bytes, sha256 of the files in a folder. Executors hash files up to `large` bytes; longer ones, which no cell
    holds, stream through a digest on the driver."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    out = files.where(F.col("length") < large).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = []
    for r in files.where(F.col("length") >= large).select("path", name, "length").collect():  # a folder's few large files
        p = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
        rows.append((r["name"], r["length"], spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        stream.close()
    return out.unionByName(spark.createDataFrame(rows, out.schema)) if rows else out


def folder_hash(spark: SparkSession, path: str) -> str:
    """sha256 of the ordered list name:digest of a folder's files."""
    import hashlib

    listing = file_digests(spark, path).select(F.concat_ws(":", "name", "sha256").alias("x")).orderBy("x")
    return hashlib.sha256("\n".join(r[0] for r in listing.collect()).encode()).hexdigest()


def content_hash(df: DataFrame) -> DataFrame:
    """A hash of all rows that doesn't depend on their order."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("content_hash"), F.count("*").alias("n"))


def save_split_manifest(splits: DataFrame, path: str) -> None:
    """Ids by split as text, and a manifest with each list's hash. Splits are few; ids stay on the executors but for the hash."""
    spark = splits.sparkSession
    splits.select("case_id", "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/ids")
    out = {}
    for name in sorted(r[0] for r in splits.select("split").distinct().collect()):
        row = id_list_hash(splits.where(F.col("split") == name), "case_id").first()
        out[name] = {"sha256": row["ids_sha256"], "n": row["n"]}
    write_json(spark, f"{path}/splits.json", {"version": VERSION, "splits": out})


def load_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, split), after every list's hash was found to hold."""
    about = read_json(spark, f"{path}/splits.json")
    ids = spark.read.parquet(f"{path}/ids")
    for name, want in about["splits"].items():
        if id_list_hash(ids.where(F.col("split") == name), "case_id").first()["ids_sha256"] != want["sha256"]:
            raise ValueError(f"the ids of {name} have changed")
    return ids


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines under a declared schema (a DDL text); a broken last line is left out, one before it raises."""
    from .corpora import read_jsonl_tail

    return read_jsonl_tail(spark, path, schema)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that no completed row has, for runs that go on where they stopped."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def keep_latest(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Of each key the last row in file order (not the newest time stamp)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(line)))).where("_n = 1").drop("_n")


def verify_files(spark: SparkSession, path: str, registered: DataFrame) -> DataFrame:
    """name, status (`ok`, `missing`, `size`, `sha256`, `unregistered`) of files against (name, bytes, sha256)."""
    found = file_digests(spark, path).select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    j = registered.join(found, "name", "full")
    return j.select("name", F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unregistered").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "sha256").otherwise("ok").alias("status"))


def prepare_release(ratings: DataFrame, blind_key: DataFrame, salt: str, design_salt: str) -> DataFrame:
    """Ratings without free text and personal data: raters renamed by salted hash order, systems unblinded, flagged rows withheld."""
    if salt == design_salt:
        raise ValueError("a release needs a salt of its own")
    raters = ratings.select("rater").distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(salt), "rater"), 256))
    names = raters.withColumn("rater_label", F.format_string("R%02d", F.row_number().over(W.orderBy("_h"))))  # raters are a handful of people
    return ratings.where(~F.col("has_personal_data")).join(names.select("rater", "rater_label"), "rater").join(blind_key, "item").drop("rater", "free_text", "has_personal_data")
