"""Watching a folder: files of signal and of sequences that arrive in any order, each called once when both are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import methylation

CALLS = "read_id long, chromosome string, start_pos long, end_pos long, num_motifs int, llr double"


def calls_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Call files under folder as a stream."""
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def paired(signal: DataFrame, sequences: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of both halves of a file by base name (columns name, at); state older than delay goes."""
    a = signal.withWatermark("at", delay).alias("a")
    b = sequences.withColumnsRenamed({"at": "at_b", "name": "name_b"}).withWatermark("at_b", delay)
    return a.join(b, F.expr(f"name = name_b and at_b between at - interval {delay} and at + interval {delay}"))


def counts(calls: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Running frequency of each site, as the batch operator gives it."""
    return methylation.frequency(calls, threshold)


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes each batch's clear calls under its batch number, and ends when all files are read. A batch that is repeated
    after a failure overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.filter(F.abs("llr") >= 2.0 * F.col("num_motifs")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batch_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the tables through the stream, file by file, then aggregated: equal to the batch query."""
    from ..fixtures import view
    from ..sources.tables import scratch, stored

    calls = view(spark, sf_dir, "v_calls").select("read_id", "chromosome", "start_pos", "end_pos", F.col("num_motifs").cast("int"), "llr")
    folder = stored(calls.repartition(8), "incoming").inputFiles()[0].rsplit("/", 1)[0]
    called = scratch(spark, "called")
    run(calls_stream(spark, folder, 2), called, scratch(spark, "progress"))
    return counts(spark.read.parquet(called))
