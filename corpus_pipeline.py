"""A training-data pipeline over ``documents``: toxic texts out, one document per group of near
copies, sources mixed to their weights, and token ids of what is left.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame;
``run`` stores each result as Parquet in the shared folder and hands on what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import mixing, ngram_join, queries, toxicity
from triagelake.session import configure, cut_lineage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay. The model learns from ``labels`` alone."""
    model = toxicity.fit(queries.table(spark, sf_dir, "documents"),
                         queries.training_labels(spark, sf_dir))
    return toxicity.keep_clean(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams at Jaccard 0.8 or more, the smallest id stays."""
    return ngram_join.one_per_component(docs, k=5, num=8, den=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.bpe_digests(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_copies_out),
    ("mixing", mixed),
    ("byte_bpe", token_ids),
]

#: A trained model decides, so there is no SQL twin; tests hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
