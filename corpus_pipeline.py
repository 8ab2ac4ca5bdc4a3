"""A corpus pipeline of five of the ``tidewright.llm`` operators: language ID, line dedup, near copies, benchmark items, mixing.

Each stage works on all rows that the one before it kept, and is written as Parquet and read again in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.containment import decontaminated
from tidewright.llm.curriculum import curriculum_mix
from tidewright.llm.language_bitmask import identified, learn
from tidewright.llm.line_chunks import dedup_lines
from tidewright.llm.ngram_jaccard import ngram_jaccard_join
from tidewright.llm.queries import settings
from tidewright.session import shared_folder

MIN_SCORE = 0.7  # of the language filters, between texts of learned languages and of others (figures in the README); a text under it is in none of the learned languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the corpus; a text that is null, has no letter or fits none goes."""
    settings(spark)
    return identified(docs, learn(docs), MIN_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier document has; those of which nothing is left go."""
    settings(spark)
    left = dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; texts without a word stay."""
    settings(spark)
    found = ngram_jaccard_join(docs)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__copy")).distinct().hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"] == gone["__copy"], "left_anti")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    settings(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each and the training time of its first use, in that order."""
    settings(spark)
    return curriculum_mix(docs).filter("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("mix", mix)]
ORACLE_SQL = None  # the filters of language ID are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
