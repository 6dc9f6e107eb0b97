"""Maps between events, k-mers, samples and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_event_map(aligned: DataFrame, by: str = "read_id", kmer: str = "ref_pos", event: str = "event_idx") -> DataFrame:
    """First and last event of each k-mer of a read."""
    return aligned.groupBy(by, kmer).agg(F.min(event).alias("ev_start"), F.max(event).alias("ev_stop"))


def event_states(events: DataFrame, by: str = "read_id", order: str = "event_idx", rank: str = "kmer_rank") -> DataFrame:
    """M where the k-mer changes, E where an event goes on with the one before."""
    last = F.lag(rank).over(Window.partitionBy(by).orderBy(order))
    return events.withColumn("state", F.when(last == F.col(rank), "E").otherwise("M"))


def durations(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.coalesce(F.sum("dur_us"), F.lit(0)).cast("long").alias("duration"))


def sample_range(start: Column, duration: Column, rate: float) -> tuple[Column, Column]:
    """First sample of an event and the one after its last, from seconds."""
    return F.floor(start * rate), F.floor((start + duration) * rate)


def kmer_moves(events: DataFrame, by: str = "read_id", kmer: str = "kmer_rank") -> DataFrame:
    """Of each k-mer the events that step to it, stay on it, and skip to it."""
    move = F.col("ref_pos") - F.lag("ref_pos").over(Window.partitionBy(by).orderBy("event_idx"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    e = events.withColumn("_m", F.coalesce(move, F.lit(1)))
    return e.groupBy(kmer).agg(n(F.col("_m") == 1).alias("num_matches"), n(F.col("_m") == 0).alias("num_stays"), n(F.col("_m") > 1).alias("num_skips"))


def anchors(pairs: DataFrame, by: str, position: str, value: str, stride: int = 50) -> DataFrame:
    """The last value seen at or before every stride-th position of a span."""
    slot = F.ceil(F.col(position) / stride) * stride
    last = pairs.groupBy(by, slot.alias("slot")).agg(F.max_by(value, position).alias("value"))
    ends = pairs.groupBy(by).agg(F.min(F.ceil(F.col(position) / stride) * stride).alias("a"), F.max(F.floor(F.col(position) / stride) * stride).alias("b")).filter("a <= b")
    every = ends.select(by, F.explode(F.sequence("a", "b", F.lit(stride).cast("long"))).alias("slot"))
    w = Window.partitionBy(by).orderBy("slot")
    return every.join(last, [by, "slot"], "left").select(by, "slot", F.last("value", ignorenulls=True).over(w).alias("value"))


def region(text: Column) -> Column:
    """contig:start-end, with commas in numbers, as a struct."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    at = r"^(.*):(\d+)-(\d+)$"
    return F.struct(F.regexp_extract(plain, at, 1).alias("contig"), F.regexp_extract(plain, at, 2).cast("long").alias("start_pos"), F.regexp_extract(plain, at, 3).cast("long").alias("end_pos"))


def bounded(first_event: Column, last_event: Column, first: Column, last: Column, most: float = 20.0, strict: bool = False) -> Column:
    """Whether a stretch of events may be scored: both ends known and over ten events; strict also bounds events a base."""
    n = F.abs(last_event - first_event)
    ok = first_event.isNotNull() & last_event.isNotNull() & (n > 10)
    return F.coalesce(ok & (n / F.abs(last - first) <= most) if strict else ok, F.lit(False))


def merged(first: DataFrame, second: DataFrame, value: str, by: str = "read_id") -> DataFrame:
    """Two alignments of the same events side by side: what each gives an event, null where it doesn't have it."""
    a, b = (x.select(by, "event_idx", F.col(value).alias(n)) for x, n in ((first, "first"), (second, "second")))
    return a.join(b, [by, "event_idx"], "full").withColumn("same", F.coalesce(F.col("first") == F.col("second"), F.lit(False)))
