"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import bounded, dropped, scratch, stored  # noqa: F401  some are for this folder's modules

#: Fixed value: a word is a run of characters outside these ASCII ranges, that is of digits, letters and anything non-ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The letters that lower-casing touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and turns every ASCII character that no word holds into a space, so that split(" ") finds words.
WORD_TABLE = {c: " " for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]} | {ord(a): b for a, b in zip(UPPER, LOWER)}
#: The same over the bytes of UTF-8: no byte of a longer character is touched.
WORD_BYTES = bytes(ord(WORD_TABLE.get(i, chr(i))) if i < 128 else i for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: later stages don't recompute it when executors are lost."""
    return stored(df, what)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, taken by position: other columns may have any names, also such as differ in letter case alone."""
    have = df.columns
    lower = [c.lower() for c in have]
    at = [have.index(n) if n in have else lower.index(n.lower()) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(have))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def through(df: DataFrame, task) -> DataFrame:
    """df passed through task, which maps Arrow batches and keeps their columns: by place, so columns may have any names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(task, plain.schema).toDF(*df.columns)
