"""The registered query of each operator: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.llm import cnn, decontaminate as benchmark, language, line_dedup, mixing, pseudonyms, quality_rules as rules, toxicity
from quantloom.llm.common import table
from quantloom.llm.decontaminate import decontaminate
from quantloom.llm.quality_rules import quality_rules
from quantloom.llm.simhash import near_duplicates
from quantloom.llm.suffix_dedup import dedup_substrings

#: Setting that names the key of the pseudonyms; the key that stands here is for demonstration only.
KEY_SETTING, DEMO_KEY = "spark.quantloom.pseudonym.key", "quantloom-demo-key"


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op2_language(spark, sf_dir):
    return language.classify(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op4_pseudonyms(spark, sf_dir):
    key = spark.conf.get(KEY_SETTING, DEMO_KEY).encode()
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), key, keep=["doc_id"])


def op5_suffix_dedup(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.md5("text").alias("kept_md5"))


def op7_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_quality(spark, sf_dir):
    return cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, keep=["doc_id"])
    return out.withColumn("broken", F.concat_ws(",", "broken"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language": op2_language,
        "op3_decontaminate": op3_decontaminate,
        "op4_pseudonyms": op4_pseudonyms,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_mix": op7_mix,
        "op8_simhash": op8_simhash,
        "op9_quality": op9_quality,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict:
    return {"op3_decontaminate": benchmark.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_mix": mixing.ORACLE, "op10_quality_rules": rules.ORACLE}
