"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; the last returns the manifest
of the mix: a row for each document that it takes, with the words taken (repeats counted).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import cnn, mixing
from quantloom.llm.common import shared_folder, table
from quantloom.llm.decontaminate import decontaminate
from quantloom.llm.line_dedup import dedup_lines
from quantloom.llm.similar import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.7)."""
    scored = cnn.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("predicted") == 1).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that an earlier document (or place) has."""
    out = dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, then text hash.

    Near-duplicates have sets of 5-word shingles at Jaccard similarity 0.8 or more, or the same words. The
    links come from the SimHash index and, for what its 2 bits don't reach, from signatures. Texts are told
    apart by doc_id and text, so neither a shared nor a missing doc_id loses a text of its own.
    """
    return similar_documents(docs, keep=COLUMNS, one_of_each=True).select(COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents taken, their size, their source's target, and the words taken."""
    mixed = mixing.mix(docs, keep=["doc_id", "lang", "source", "n_chars"])
    return mixed.where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_dups),
    ("benchmark decontamination", benchmark_free),
    ("mixing", mixture),
]

#: The first stage scores with a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
    return docs
