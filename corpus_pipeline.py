"""A corpus from raw documents to token files: five stages, each on all that the one before kept.

Order: language ID drops what no language claims, SimHash near-dedup keeps one document of each group linked by five-word Jaccard similarity
of 0.8 or more (links of op6's index confirmed, the rest found exactly; its three words and two bits bind only its query), decontamination drops documents with benchmark passages, mixing repeats or leaves out documents to meet the sources' targets, and the rest is
encoded to framed token files that are read back. Every stage's result is written as Parquet in the shared folder and
read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import decontaminate, language, mixing, nearcopy, tokenfile
from sievemark.llm.common import materialize, table
from sievemark.llm.queries import FRAMED_END_ID, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unknown(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopy.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_targets(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(docs, tokenizer_path(), FRAMED_END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Hyperdimensional profiles, XXH64 fingerprints and a trained tokenizer aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
