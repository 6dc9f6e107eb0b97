"""A training corpus in stages: each takes the documents that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import scratch, table
from sigspark.llm.encode import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labels of the training rows and the documents at hand."""
    from sigspark.llm.quality import accepted, train

    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    from sigspark.llm.near_duplicates import kept

    return kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    from sigspark.llm.decontamination import clean

    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with every secret in their text replaced by a mark."""
    from sigspark.llm.secrets import clean

    return clean(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids at most; the ids as a digest."""
    from sigspark.llm.packing import pack

    out = pack(docs, vocabulary("byte_bpe_50k.json"), size=1024, end_id=0, kept=KEPT)
    length = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", packing)]

#: Pieces that packing's encoder keeps: fewer than alone, as the stages before it have filled the executors' heaps.
KEPT = 100_000

#: A trained model and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{name.replace(' ', '-')}"))
        docs = spark.read.parquet(path)
    return docs
