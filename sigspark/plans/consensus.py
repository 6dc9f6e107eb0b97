"""Polishing to a fix-point: rounds of candidate changes until the called set stays the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import haplotype
from ..sources.tables import stored


def votes_from_reads(reads: DataFrame, ref: DataFrame) -> DataFrame:
    """Bases that reads show on contigs (read i lies on contig i mod their number, from its first base): contig, pos, base, n."""
    n = ref.select(F.count("*").alias("n"))
    placed = reads.join(F.broadcast(n)).select((F.col("read_id") % F.col("n")).alias("contig"), "seq").join(ref.select("contig", F.length("seq").alias("size")), "contig")
    bases = placed.select("contig", "size", F.posexplode(F.regexp_extract_all("seq", F.lit("(.)"), F.lit(1))).alias("pos", "base")).filter("pos < size")
    return bases.groupBy("contig", F.col("pos").cast("long").alias("pos"), "base").agg(F.count("*").alias("n"))


def polish(ref: DataFrame, votes: DataFrame, most_rounds: int = 50, margin: float = 1.5) -> DataFrame:
    """The contigs after rounds in which a base changes to the one that most reads show, if these are margin times those of
    the base held; neighbours of a change wait for the next round. Ends when no key changes. Each round is one job over all
    contigs; votes and contigs are stored, only the number of calls comes to the driver."""
    votes, draft, done = stored(votes, "votes"), stored(ref, "draft"), 0
    for done in range(1, most_rounds + 1):
        held = draft.select("contig", F.posexplode(F.regexp_extract_all("seq", F.lit("(.)"), F.lit(1))).alias("pos", "ref"))
        own = votes.join(held, ["contig", "pos"])
        calls = own.groupBy("contig", "pos", "ref").agg(F.max_by("base", F.struct("n", "base")).alias("alt"), F.max("n").alias("most"), F.sum(F.when(F.col("base") == F.col("ref"), F.col("n")).otherwise(0)).alias("kept"))
        calls = calls.filter((F.col("alt") != F.col("ref")) & (F.col("most") >= margin * F.col("kept") + 1))
        calls = calls.filter((F.col("pos") % 2 == done % 2))
        calls = stored(calls.select("contig", F.col("pos").cast("long").alias("pos"), "ref", "alt"), "calls")
        n = calls.count()
        if n:
            draft = stored(haplotype.apply_substitutions(draft, calls).select("contig", "seq"), "draft")
        elif done > 1 and not last:
            break
        last = n
    return draft.withColumn("rounds", F.lit(done))
