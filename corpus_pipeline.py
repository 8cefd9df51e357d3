"""The corpus pipeline: rules, near-duplicates, repeated passages, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; the next one reads
what it returned from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, decontaminate, near_copies, quality_rules, queries, suffix_dedup
from tramline.llm.shared import shared_dir, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't say what a suffix array or a tokenizer does; the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard >= 4/5) stays: the one with the smallest id."""
    return near_copies.keep_first(docs.select(*COLUMNS))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go, and characters that a cut has halved; a null text stays null."""
    done = suffix_dedup.dedup(docs.select(*COLUMNS).withColumn("none", F.col("text").isNull()), carry=("lang", "source", "none", "n_chars"), as_text=True)
    text = F.when(~F.col("none"), F.col("kept"))
    return done.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text again."""
    v = queries.vocabulary()
    coded = bpe.encode(docs.select("doc_id", "text"), v, with_bytes=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("bytes").cast("long").alias("n_bytes"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each returns is written and read again."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
