"""A training corpus from raw documents: five stages, each written as Parquet and read again.

toxicity          documents scored 0.5 or more go
line_dedup        lines that a document with a smaller id has go from the text
jaccard_join      of documents that near copies link (five words, 0.8), the one with the smallest id stays
decontamination   documents that hold a benchmark item, whole or nearly, go
packing           what is left, as pieces of windows of 1024 tokens

A row with a null id is judged by its text where a stage needs no id, and kept where it does. Null
texts count as empty. Columns beside the id and the text come through as they are, but that
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import table, written
from fieldtally.llm.decontamination import drop_contaminated
from fieldtally.llm.jaccard_join import similar_classes
from fieldtally.llm.line_dedup import dedup_documents
from fieldtally.llm.packing import pack_documents
from fieldtally.llm.toxicity import drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = similar_classes(docs, shingle=5, percent=80).filter("component_id < doc_id").select(F.col("doc_id").alias("copy id"))
    return docs.join(copies, F.col("doc_id") == F.col("copy id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("packing", packing)]

#: The toxicity stage is a fitted model, which SQL can't express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
