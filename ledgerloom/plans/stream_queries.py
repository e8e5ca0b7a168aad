"""Queries over event streams and of the value formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import formatting as fm
from ..streaming import events as ev
from .registry import query


def _events(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("stream_sliding_bursts", """WITH w AS (SELECT user_id, value, unnest(range(0, 4)) AS k, ts FROM events), s AS (SELECT user_id, value, make_timestamp(epoch_us(ts) - epoch_us(ts) % 43200000000 - k * 43200000000) AS window_start FROM w)
SELECT user_id, window_start, window_start + INTERVAL 48 HOUR AS window_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY 1, 2 HAVING count(*) >= 5""")
def stream_sliding_bursts(spark, d):
    out = ev.drain(ev.sliding_bursts(_events(spark, d), late="3650 days"), f"bursts_{uuid.uuid4().hex}", "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("window_start"), ntz("window_end"), "n", F.round("total", 6).alias("total"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    out = ev.drain(ev.sessions(_events(spark, d), late="3650 days"), f"sessions_{uuid.uuid4().hex}", "complete")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("session_start"), ntz("session_end"), "n", F.round("total", 6).alias("total"))


@query("stream_fullest_burst")
def stream_fullest_burst(spark, d):
    """Custom state (arbitrary order across batches: tested against the batch burst)."""
    return ev.drain(ev.fullest_burst(_events(spark, d)), f"fullest_{uuid.uuid4().hex}", "update")


@query("format_values", """SELECT p_partkey, format('{:,}', CAST(p_size * 1000 AS BIGINT)) AS count_text, concat(CAST(CAST(round(p_size / 200.0 * 100) AS INTEGER) AS VARCHAR), '%') AS percent_text, printf('%.3f', p_size / 8.0) AS density_text, CASE WHEN p_size >= 48 THEN concat(printf('%.1f', p_size / 24.0), ' days') ELSE concat(printf('%.1f', CAST(p_size AS DOUBLE)), ' hours') END AS duration_text FROM part WHERE p_size >= 1""")
def format_values(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size >= 1")
    x = F.col("p_size")
    return p.select("p_partkey", fm.format_count((x * 1000).cast("long")).alias("count_text"), fm.format_percent(x / 200).alias("percent_text"), fm.format_density(x / 8).alias("density_text"), fm.format_duration(x.cast("double")).alias("duration_text"))


@query("chosen_share", "SELECT doc_id, CAST(concat('0x', sha256(concat('audit:', doc_id))[1:15]) AS BIGINT) / 1152921504606846976.0 < 0.25 AS chosen FROM documents")
def chosen_share(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fm.chosen(0.25, F.lit("audit"), F.col("doc_id").cast("string")).alias("chosen"))
