"""Tail report: segmentation, rate, length and tag of each read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hmm, signal


def report(samples: DataFrame, rates: DataFrame, sample_rate: float) -> DataFrame:
    """samples: read_id, scaled samples; rates: read_id, median duration in microseconds of a base. A read without a rate is
    kept with null length."""
    regions = hmm.segment_reads(samples).join(rates.select("read_id", (F.lit(1e6) / F.nullif("median", F.lit(0))).alias("read_rate")), "read_id", "left")
    tail = signal.tail_length(F.col("adapter"), F.col("polya"), F.lit(sample_rate), F.col("read_rate"))
    bases = (F.col("adapter") - F.col("leader")) / sample_rate * F.col("read_rate")
    return regions.select("read_id", "start", "leader", "adapter", "polya", "cliffs", "read_rate", F.when(F.col("read_rate").isNotNull(), tail).alias("polya_length"), signal.tail_tag(F.col("adapter") - F.col("leader"), F.col("polya") - F.col("adapter"), F.coalesce(bases, F.lit(0.0))).alias("qc_tag"))


def class_tag(polyi_samples, polya_samples, least: int = 200):
    """Which of the two tails a read has, by samples."""
    i, a = polyi_samples >= least, polya_samples >= least
    return F.when(i & a, "A+I").when(a, "POLYA-ONLY").when(i, "POLYI-ONLY").otherwise("NONE")


def tail_classes(samples: DataFrame) -> DataFrame:
    """Regions with the two kinds of tail told apart, and the tag of what was detected."""
    r = hmm.segment_reads(samples, mixed_tail=True)
    n = F.col("polya") - F.col("adapter")
    i = F.when(F.col("polyi_end") >= 0, F.col("polyi_end") + 1).otherwise(0)
    a = F.when(F.col("polya_start") >= 0, n - F.col("polya_start")).otherwise(0)
    return r.withColumn("detected", class_tag(i, a))
