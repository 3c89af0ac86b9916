"""The corpus pipeline: raw documents to token ids, in five stages.

Every stage takes the documents its predecessor kept and returns those it
keeps, with the columns of ``documents`` (the last one returns token ids).
``run`` writes each stage as Parquet under ``spark.checkpoint.dir`` and reads
it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontaminate, line_dedup, minmax_dedup, quality_bt, sp_tokens
from vigil.llm.common import Scratch, table
from vigil.llm.queries import model_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the labels are those of all documents."""
    return quality_bt.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` follows, documents left without a line go."""
    out = line_dedup.keep_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minmax_dedup.keep_first(docs, width=5, percent=80)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    return sp_tokens.encode(docs, model_bytes(), with_text=True).drop("same")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmarks), ("sentencepiece", tokens)]

#: No SQL: two stages fit models or hash; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
