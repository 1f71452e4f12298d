"""The corpus pipeline: five stages over `documents`, each one operator of cadastra.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet to the shared folder and hands the table to the next stage. All but
the last return the columns of `documents`, whatever columns these are.

Defined cases, for every stage: an empty table passes through; a null or empty
text is neither toxic nor a copy, leak or secret and is kept; rows with a null
doc_id are kept but for what their own text says; rows are judged one by one,
save near duplicates, which go by doc_id: rows that repeat one are one document,
whose texts stay once each or go together; ties between copies go to the least
doc_id; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch
from cadastra.llm.decontaminate import clean
from cadastra.llm.minhash import near_duplicates
from cadastra.llm.packing import pack
from cadastra.llm.secrets import redact
from cadastra.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the segment model predicts as toxic go; without labels of both classes none does."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least doc_id, each of its texts once."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows it (null for a null text)."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences along the Hilbert curve, with their token ids; a null text is the end id alone."""
    return pack(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL has no MinHash, segment model or tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's rows."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tmp.save(stage(spark, docs, sf_dir), name)
    return docs
