"""Sources: transaction files, pattern files, membership files, and the transaction view over the order tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The header of a transactions file, and the names its columns get by position.
HEADER = ("Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering")
COLUMNS = ("timestamp", "src_bank", "src_account", "dst_bank", "dst_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")
#: The fields of the natural key, as text, in order.
KEY_FIELDS = ("timestamp", "src_bank", "src_account", "dst_bank", "dst_account", "amount_paid")
TIMESTAMP = "yyyy/MM/dd HH:mm"
#: Typologies in the order that breaks ties.
TYPOLOGIES = ("fan_in", "fan_out", "gather_scatter", "scatter_gather", "cycle", "random", "bipartite", "stack", "unclassified")

_MARK = re.compile(r"^(BEGIN|END) LAUNDERING ATTEMPT - ([A-Z\- ]+?)(?::\s*(.*))?$")


class SchemaDrift(ValueError):
    """A file that is not laid out as declared."""


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    first = spark.read.text(path).limit(1).collect()
    return tuple(x.strip() for x in first[0][0].lstrip("﻿").split(",")) if first else ()


def assert_header(spark: SparkSession, path: str) -> None:
    if (found := read_header(spark, path)) != HEADER:
        raise SchemaDrift(f"header {found} instead of {HEADER}")


def load_transactions(spark: SparkSession, path: str, n_rows: int | None = None) -> DataFrame:
    """Typed transactions with their natural key, which is built from the text before any cast. `n_rows` caps rows on request."""
    assert_header(spark, path)
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])).option("header", True).option("enforceSchema", True).csv(path)
    if n_rows is not None:
        raw = raw.limit(n_rows)
    return raw.withColumn("transaction_key", F.concat_ws("|", *KEY_FIELDS)).withColumns({
        "timestamp": F.to_timestamp_ntz("timestamp", F.lit(TIMESTAMP)),
        "amount_received": F.col("amount_received").cast("double"),
        "amount_paid": F.col("amount_paid").cast("double"),
        "is_laundering": F.col("is_laundering").cast("int").cast("boolean"),
    })


def account_key(bank: str, account: str):
    return F.concat_ws("|", F.col(bank), F.col(account))


def edges_of(transactions: DataFrame) -> DataFrame:
    """Transactions as edges between bank|account nodes."""
    return transactions.withColumn("src", account_key("src_bank", "src_account")).withColumn("dst", account_key("dst_bank", "dst_account"))


def parse_patterns(text: str, source: str = "<text>") -> Iterator[tuple]:
    """Rows (pattern_id, typology, typology_detail, transaction_key, position) of one pattern file; bad grammar raises."""
    open_: tuple[str, str] | None = None
    number = position = 0
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line:
            continue
        at = f"{source}:{n}"
        if mark := _MARK.match(line):
            kind, name, detail = mark.groups()
            name = re.sub(r"[^a-z]+", "_", name.strip().lower())
            if kind == "BEGIN":
                if open_:
                    raise SchemaDrift(f"{at}: a stream inside a stream")
                if name not in TYPOLOGIES[:-1]:
                    raise SchemaDrift(f"{at}: unknown typology {name}")
                open_, position = (name, (detail or "").strip()), 0
            else:
                if not open_:
                    raise SchemaDrift(f"{at}: an end without a begin")
                if name != open_[0]:
                    raise SchemaDrift(f"{at}: {open_[0]} ends as {name}")
                if not position:
                    raise SchemaDrift(f"{at}: an empty stream")
                open_, number = None, number + 1
            continue
        if not open_:
            raise SchemaDrift(f"{at}: a row outside a stream")
        fields = line.split(",")
        if len(fields) != len(COLUMNS):
            raise SchemaDrift(f"{at}: {len(fields)} fields")
        row = dict(zip(COLUMNS, fields, strict=True))
        yield f"{open_[0]}_{number:05d}", open_[0], open_[1], "|".join(row[f] for f in KEY_FIELDS), position
        position += 1
    if open_:
        raise SchemaDrift(f"{source}: a stream is not closed")


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern files, each parsed whole (streams are numbered by file)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for text, name in zip(pdf["value"], pdf["source"], strict=True):
                yield pd.DataFrame(list(parse_patterns(text, name)), columns=["pattern_id", "typology", "typology_detail", "transaction_key", "position_in_stream"])

    files = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    return files.mapInPandas(run, "pattern_id string, typology string, typology_detail string, transaction_key string, position_in_stream int")


def resolve_column(df: DataFrame, *names: str) -> str:
    """The first of the names that the frame has, whatever its case; refuses to guess."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return have[n.lower()]
    raise SchemaDrift(f"none of {names} in {df.columns}")


def load_memberships(spark: SparkSession, path: str) -> DataFrame:
    """(subgraph_id, node_id, label) with labels 1/suspicious/illicit and 2/licit told apart; others raise when read."""
    raw = spark.read.option("header", True).csv(path)
    label = F.lower(F.trim(F.col(resolve_column(raw, "ccLabel", "label", "class"))))
    known = F.when(label.isin("1", "suspicious", "illicit"), "suspicious").when(label.isin("2", "licit"), "licit")
    return raw.select(F.col(resolve_column(raw, "ccId", "subgraph_id")).alias("subgraph_id"), F.col(resolve_column(raw, "clusterId", "node_id")).alias("node_id"), F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null"))))).alias("label"))


# --- the transaction view over lineitem, orders, customer and supplier ------------------------------

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


FOLD = 25
"""So many customers (parts, on the receiving side) of a nation share an account; accounts grow with the tables."""


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines seen as transfers between accounts; a case is a sender's calendar quarter."""
    li, o, c, s = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    text = lambda x: F.col(x).cast("string")
    flagged = F.col("l_orderkey") % 97 == 0
    src = F.concat(F.lit("N"), text("c_nationkey"), F.lit("|A"), F.expr(f"c_custkey div {FOLD}").cast("string"))
    return j.select(
        F.concat_ws("|", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("transaction_key"),
        src.alias("src"),
        F.concat(F.lit("N"), text("s_nationkey"), F.lit("|A"), F.expr(f"l_partkey div {FOLD}").cast("string")).alias("dst"),
        F.concat(F.lit("N"), text("c_nationkey")).alias("src_bank"),
        F.concat(F.lit("N"), text("s_nationkey")).alias("dst_bank"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("amount_paid"),
        F.col("l_returnflag").alias("payment_currency"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"),
        F.when(F.col("l_linenumber") % 5 == 0, "R").otherwise(F.col("l_returnflag")).alias("receiving_currency"),
        F.col("o_orderpriority").alias("payment_format"),
        flagged.alias("is_laundering"),
        F.when(flagged, F.concat(F.lit("p"), (F.col("l_orderkey") % 7).cast("string"))).alias("pattern_id"),
        F.concat(src, F.lit("/"), F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("case_id"),
    )


#: Fixed value: so many bits of an account's number are its block's; its bank's stand above them.
BLOCK_BITS = 42


def account_number(bank, block):
    """An account of the view as one number, in sixteen bytes less than its name; keys beyond its bits are refused."""
    half, most = 1 << BLOCK_BITS - 1, 1 << 62 - BLOCK_BITS
    bank, block = F.col(bank).cast("long"), block.cast("long")
    whole = F.when(block.between(-half, half - 1) & bank.between(-most, most - 1), F.shiftleft(bank, BLOCK_BITS) + block)
    return F.when(bank.isNotNull() & block.isNotNull(), F.coalesce(whole, F.raise_error(F.concat(F.lit("account beyond its number: "), bank.cast("string"), F.lit(", "), block.cast("string"))).cast("long")))


def account_name(number):
    bank = F.shiftright(number + F.lit(1 << BLOCK_BITS - 1), BLOCK_BITS)
    return F.concat(F.lit("N"), bank.cast("string"), F.lit("|A"), (number - F.shiftleft(bank, BLOCK_BITS)).cast("string"))


def numbered_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's src and dst as account numbers, ts, amounts and currencies: what accounts are summed from.

    Either side is made narrow before the lines meet their orders, which is the one join that moves them.
    """
    li, o, c, s = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    lines = li.join(s, F.col("l_suppkey") == s["s_suppkey"]).select("l_orderkey", account_number("s_nationkey", F.expr(f"l_partkey div {FOLD}")).alias("dst"), "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag", (F.col("l_linenumber") % 5 == 0).alias("fifth"))
    senders = o.join(c, F.col("o_custkey") == c["c_custkey"]).select("o_orderkey", account_number("c_nationkey", F.expr(f"c_custkey div {FOLD}")).alias("src"))
    return lines.join(senders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "src", "dst", F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("amount_paid"), F.col("l_returnflag").alias("payment_currency"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"), F.when(F.col("fifth"), "R").otherwise(F.col("l_returnflag")).alias("receiving_currency"),
    )


#: The same view for SQL engines.
TXN_SQL = f"""txn AS (SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')) AS transaction_key,
 concat('N', c_nationkey, '|A', c_custkey // {FOLD}) AS src, concat('N', s_nationkey, '|A', l_partkey // {FOLD}) AS dst, concat('N', c_nationkey) AS src_bank, concat('N', s_nationkey) AS dst_bank,
 l_shipdate AS ts, l_extendedprice AS amount_paid, l_returnflag AS payment_currency, l_extendedprice * (1 - l_discount) AS amount_received,
 CASE WHEN l_linenumber % 5 = 0 THEN 'R' ELSE l_returnflag END AS receiving_currency, o_orderpriority AS payment_format, l_orderkey % 97 = 0 AS is_laundering,
 CASE WHEN l_orderkey % 97 = 0 THEN concat('p', l_orderkey % 7) END AS pattern_id,
 concat('N', c_nationkey, '|A', c_custkey // {FOLD}, '/', year(l_shipdate), 'Q', quarter(l_shipdate)) AS case_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
