"""A corpus pipeline over documents: quality rules, line dedup, near-duplicate removal, mixing, encoding.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and returns the documents that it leaves, with the
columns of documents, the last one their encodings. run() writes each stage's result as Parquet and reads it again for
the next, so a stage can be rerun from what the one before it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_automaton, line_dedup, mixing, ngram_join, quality
from ledgerloom.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those of which nothing is left go, n_chars follows the text."""
    found = line_dedup.dedup(docs)
    left = (F.col("_n_deleted") == 0) | (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0)
    return found.filter(left).withColumn("n_chars", F.when(F.col("_n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of least id, of rows that repeat an id one, and one without an id only if none has one.

    Rows are numbered in a table first, so that a row is told from another of its id."""
    numbered = Scratch(spark, "near").keep(docs.select("*", F.monotonically_increasing_id().alias("_row")), "numbered")
    found = ngram_join.components(numbered, "_row").select("_id", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")
    ids = found.join(numbered.select("_row", "doc_id"), F.col("_id") == F.col("_row")).select("component_id", order.alias("o"))
    first = ids.groupBy("component_id").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = ids.join(first, "component_id").filter("o._row != first._row").select(F.col("o._row").alias("_row"))
    return numbered.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows of one id and source are taken together."""
    rounds = mixing.queue(docs).filter("rounds > 0").groupBy(F.col("_id"), F.col("source").alias("_source")).agg(F.max("rounds").alias("_rounds"))
    found = docs.join(rounds, docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")))
    return found.withColumn("_round", F.explode(F.sequence(F.lit(1), F.col("_rounds")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers

    return bpe_automaton.digests(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix),
    ("BPE encoding", encode),
]

#: Quality rules, encoding and the tokenizer's tables are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
