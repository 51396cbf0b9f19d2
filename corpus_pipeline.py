"""A training corpus from ``documents``: language, near-duplicates, secrets, mixture and packing, one stage after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import language, mixing, neardup, packing, secrets
from marquee.llm.queries import QUERIES, VOCABULARY
from marquee.runtime import write_once


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, with ``lang`` as predicted from the whole text; null and letterless texts go."""
    found = language.identify(docs).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-equal texts."""
    return neardup.deduplicate(docs).select(*docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that look live are replaced by a mark, copied examples stay."""
    return secrets.redact(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it, to the nearest whole time; most not at all, once or twice."""
    taken = mixing.mix(docs).filter("taken > 0")
    times = taken.withColumn("_times", F.round(F.col("taken") / F.col("size")).cast("int")).filter("_times > 0")
    return times.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4,096 tokens with the same mixture in each."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", known_language), ("near_duplicates", one_of_each), ("secrets", no_secrets), ("mixing", mixed), ("packing", packed),
]

# models, sampling and token ids are not for SQL; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
