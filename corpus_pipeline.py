"""A corpus pipeline: the documents table through five stages, each written and read again.

1. quality classifier (regularised quadratic discriminant): rejected documents go;
2. n-gram Jaccard join: of each group of near-duplicates the document with the smallest id stays;
3. suffix-array dedup: long stretches that repeat anywhere are cut from the texts;
4. benchmark decontamination: documents that overlap with a benchmark item go;
5. best-fit packing: the kept documents as rows of packed sequences.

All stages but the last return the columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, table
from ledgerloom.llm.decontamination import decontaminate
from ledgerloom.llm.jaccard import jaccard_groups
from ledgerloom.llm.packing import best_fit_packing
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.repeats import without_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is one half or more. A row without an id can't be matched with its score and is kept.

    Ids that repeat are kept if any of their rows is good.
    """
    scores = quality_scores(spark, docs, table(spark, sf_dir, "labels"))
    bad = scores.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("score").alias("_score")).where("_score < 0.5").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id (a row without an id only if none has one); texts without
    words stay. Rows are told apart by a number of their own, so rows that repeat an id are judged one by one."""
    scratch = Scratch(spark, "one-of-each")
    rows = scratch.keep(docs.withColumn("_number", F.monotonically_increasing_id()))
    groups = jaccard_groups(rows.select(F.col("_number").alias("doc_id"), "text"))
    members = scratch.keep(groups.where("n_shingles > 0").select(F.col("doc_id").alias("_number"), "component_id").join(rows.select("_number", "doc_id"), "_number"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_number")).alias("x")).select("component_id", F.col("x._number").alias("_first"))
    gone = members.join(first, "component_id").where("_number <> _first").select("_number")
    return rows.join(gone, "_number", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches that repeat; bytes of characters that a cut has split go too, n_chars is counted anew.

    A null text stays null.
    """
    cut = without_repeats(docs.withColumn("_null", F.col("text").isNull()))
    out = cut.withColumn("text", F.when(~F.col("_null"), F.col("kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with token ids, in packed sequences."""
    return best_fit_packing(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written to the shared folder and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
