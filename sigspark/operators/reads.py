"""Reads, their signal files and the index between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_reads(alignments: DataFrame, sequences: DataFrame, index: DataFrame) -> DataFrame:
    """Alignments with their read's sequence and signal file; reads without either are left out."""
    return alignments.join(sequences, "read_id").join(index, "read_id")


def missing(alignments: DataFrame, sequences: DataFrame) -> DataFrame:
    return alignments.select("read_id").distinct().join(sequences, "read_id", "left_anti")


def index_files(files: DataFrame, summary: DataFrame, sequences: DataFrame, groups: DataFrame) -> DataFrame:
    """read_id, path of known reads: by the summary where it names the file, else by what the file itself holds. files:
    path; summary: filename, read_id; groups: path, read_id as found in the files."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("filename", name)
    by_summary = named.join(summary, "filename").select("read_id", "path")
    others = named.join(summary.select("filename").distinct(), "filename", "left_anti").select("path").join(groups, "path").select("read_id", "path")
    found = by_summary.unionAll(others).join(sequences.select("read_id").distinct(), "read_id", "left_semi")
    return found.groupBy("read_id").agg(F.min("path").alias("path"))


def located(sequences: DataFrame, index: DataFrame) -> DataFrame:
    """How many reads have a file: all, found, files, share."""
    j = sequences.select("read_id").distinct().join(index, "read_id", "left")
    return j.agg(F.count("*").alias("reads"), F.count("path").alias("found"), F.count_distinct("path").alias("files")).withColumn("share", F.try_divide(F.col("found"), F.col("reads")))


def crowded_files(reads: DataFrame, expected: int = 4000, least: int = 20) -> DataFrame:
    """Files with more reads than the commonest number (if over least files have it; of equals the smallest), else than expected."""
    n = reads.groupBy("path").agg(F.count("*").alias("n"))
    mode = n.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(1)
    most = mode.select(F.when(F.col("k") > least, F.col("n")).otherwise(F.lit(expected)).alias("most"))
    return n.join(F.broadcast(most)).filter("n > most").select("path", "n")


def in_region(alignments: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    return alignments.filter((F.col("contig") == contig) & (F.col("start_pos") < end) & (F.col("end_pos") >= start))


def shard(rows: DataFrame, key: Column, of: int, own: int) -> DataFrame:
    return rows.filter(F.pmod(key, F.lit(of)) == own)


def check_signal(index: DataFrame, signal: DataFrame) -> DataFrame:
    """A status for each read: OK, no samples, or no signal at all."""
    j = index.join(signal.select("read_id", F.size("samples").alias("n")), "read_id", "left")
    return j.select("read_id", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") <= 0, "EMPTY").otherwise("OK").alias("status"))


def quality_tag(length: Column, samples: Column, var: Column | None = None, events_per_base: Column | None = None) -> Column:
    """Why a read fails before scoring, or PASS."""
    tag = F.when(length <= 20, "TOO_SHORT").when(samples.isNull(), "NO_SIGNAL").when(F.size(samples) == 0, "NO_SIGNAL")
    if var is not None:
        tag = tag.when(var.isNull() | (var > 2.5), "BAD_CALIBRATION")
    if events_per_base is not None:
        tag = tag.when(events_per_base > 5.0, "BAD_RATIO")
    return tag.otherwise("PASS")


def renamed(sequences: DataFrame) -> DataFrame:
    """Reads with a number before their name. Numbers are unique and ascend in reading order, with gaps between partitions."""
    return sequences.withColumn("read_id", F.concat_ws(".", F.monotonically_increasing_id().cast("string"), F.col("read_id").cast("string")))


def paths_of(index: DataFrame) -> DataFrame:
    return index.select("path").distinct()


def first_alignments(alignments: DataFrame, most: int) -> DataFrame:
    """The first alignments in order of place, as many as asked for."""
    return alignments.orderBy("contig", "start_pos", "end_pos", "read_id").limit(most)


def with_alternatives(sequences: DataFrame, others: DataFrame) -> DataFrame:
    """Reads whose sequence another base-caller's replaces, where it has one; their events stay as they are."""
    j = sequences.join(others.select("read_id", F.col("seq").alias("_other")), "read_id", "left")
    return j.withColumn("replaced", F.col("_other").isNotNull()).withColumn("seq", F.coalesce("_other", "seq")).drop("_other")


def counters(tagged: DataFrame, tag: str = "tag") -> DataFrame:
    """One row: how many reads there are, and how many of each outcome of quality_tag."""
    n = lambda x: F.count_if(F.col(tag) == x)
    return tagged.agg(F.count("*").alias("total"), n("PASS").alias("passed"), *[n(x).alias(x.lower()) for x in ("TOO_SHORT", "NO_SIGNAL", "BAD_CALIBRATION", "BAD_RATIO")])
