"""From documents to packed training sequences, in four stages.

Each stage reads what the one before it kept, as Parquet; its decisions take
effect. Toxic documents go, then those of low quality, then all but one document
of each group of near duplicates; what is left is packed into sequences by the
length of its encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import ngram_join, packing, quality, toxicity
from wordmill.llm.common import Table
from wordmill.llm.queries import BYTE_BPE, tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_encoded(docs, tokenizer(BYTE_BPE))


STAGES = [("toxicity", without_toxic), ("quality rules", good_quality), ("n-gram Jaccard join", one_of_each), ("best-fit packing", packed)]

#: No stage's method can be written in SQL; tests/llm compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
