"""A corpus pipeline of five stages; each works on all that the one before it kept.

toxicity        documents that score 0.3 or more go
near_duplicates of each group of near copies (5-word n-grams, similarity 0.8) the one with the least id stays
decontamination documents that hold a benchmark item within its error budget go
private_data    personal data become surrogates
mix             how often each document is taken so that sources come near their targets; texts with copies > 0

Rows with a null id are judged by their own text, are in no group, and stay. Rows that share an id but not the text are
documents of their own; of rows equal in both one stays. Columns beyond those of documents are carried along; the last
stage adds copies, taken and source_target (with an underscore before a name that is in use). Each stage gives an empty
table for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import decontaminate, mixing, overlap, pii, queries, toxicity
from presswork.llm.shared import dropped, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, queries.toxic_index(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlap.drop_near_duplicates(docs, n=5, num=8, den=10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told_in = pii.free_name(docs)
    out = pii.distinct(lambda key: pii.rewrite_texts(docs, key), queries.surrogate_key(spark), told_in).drop(told_in)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", replace_private_data),
    ("mix", mix),
]

#: SQL can't express the first four stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                dropped(before)  # what the stage has read
            before = docs
    return docs
