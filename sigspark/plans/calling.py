"""End-to-end calling: from events, alignments, reference and model to site scores, event rows and variant scores.

Each plan builds one row of work for each read and site with native joins, and runs a kernel over it; sequences and models
travel as arrays of levels, so the kernels need no lookups.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import hmm, methylation, rangejoin


def event_arrays(events: DataFrame) -> DataFrame:
    """One row for each read: its events in order. events: read_id, event_idx, mean, ref_pos (of the event's k-mer)."""
    x = F.array_sort(F.collect_list(F.struct("event_idx", "mean", "ref_pos")))
    return events.groupBy("read_id").agg(x.alias("events"))


def levels(work: DataFrame, model: DataFrame, sequence: str, k: int, name: str, keys: list[str]) -> DataFrame:
    """The model's means and deviations along a sequence, as arrays name_mean, name_stdv."""
    at = work.select(*keys, F.posexplode(seq.kmers(F.col(sequence), k)).alias("i", "kmer")).join(model.select("kmer", "level_mean", "level_stdv"), "kmer")
    x = F.array_sort(F.collect_list(F.struct("i", "level_mean", "level_stdv")))
    return at.groupBy(*keys).agg(x.alias("_x")).select(*keys, F.transform("_x", lambda v: v["level_mean"]).alias(f"{name}_mean"), F.transform("_x", lambda v: v["level_stdv"]).alias(f"{name}_stdv"))


def site_work(groups: DataFrame, ref: DataFrame, alphabet: str, flank: int = 10) -> DataFrame:
    """Groups of motifs with their sequence, plain and modified: contig, start_pos, end_pos, num_motifs, plain, modified."""
    start = F.greatest(F.col("start_pos") - flank, F.lit(0))
    text = F.substring("seq", (start + 1).cast("int"), (F.col("end_pos") + flank - start).cast("int"))
    j = groups.join(ref, "contig").select("contig", "start_pos", "end_pos", "num_motifs", start.alias("sub_start"), (F.col("end_pos") + flank).alias("sub_end"), seq.disambiguate(text).alias("plain"))
    return j.withColumn("modified", seq.methylate(F.col("plain"), alphabet))


def score_sites(events: DataFrame, ref: DataFrame, model: DataFrame, alphabet: str = "cpg", k: int = 3, min_separation: int = 10, events_per_base: float = 1.5) -> DataFrame:
    """Log-likelihoods of every read's events under the plain and the modified sequence of each group of motifs that the
    read spans: read_id, contig, start_pos, end_pos, num_motifs, ll_methylated, ll_unmethylated, llr. events: read_id,
    contig, event_idx, mean, ref_pos."""
    motif = seq.ALPHABETS[alphabet][1][0]
    groups = methylation.scoreable_groups(methylation.scanned_groups(ref, motif, "contig", min_separation), min_separation)
    work = site_work(groups, ref, alphabet)
    key = ["contig", "start_pos"]
    work = work.join(levels(work, model, "plain", k, "plain", key), key).join(levels(work, model, "modified", k, "modified", key), key)
    spans = events.groupBy("read_id", "contig").agg(F.min("ref_pos").alias("first"), F.max("ref_pos").alias("last"))
    # Reads are laid into bins of their own order of length, a group's events into bins of a group's.
    inside = rangejoin.points_in_intervals(work, spans, ["contig"], "sub_start", "first", "last", bin_size=1 << 13).filter("sub_end <= last")
    near = rangejoin.points_in_intervals(events, inside.select("read_id", "contig", "start_pos", "sub_start", "sub_end"), ["read_id", "contig"], "ref_pos", "sub_start", "sub_end", bin_size=256)
    means = near.groupBy("read_id", "contig", "start_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "mean"))), lambda x: x["mean"]).alias("means"))
    rows = means.filter(F.size("means") > 10).join(work, key)

    def scored(b):
        both = [hmm.score_many(hmm.pieces_of_work(b, f"{n}_mean", f"{n}_stdv", [events_per_base] * b.num_rows)[0], True, True) for n in ("modified", "plain")]
        return [*b.columns[:5], *map(pa.array, (*both, both[0] - both[1]))]

    rows = rows.filter((F.size("plain_mean") == F.length("plain") - k + 1) & (F.size("modified_mean") == F.size("plain_mean")))
    cols = ["read_id", "contig", "start_pos", "end_pos", "num_motifs", "means", "plain_mean", "plain_stdv", "modified_mean", "modified_stdv"]
    return hmm.batched(rows.select(*cols), scored, "read_id long, contig long, start_pos long, end_pos long, num_motifs long, ll_methylated double, ll_unmethylated double, llr double")


def score_haplotypes(reads: DataFrame, haplotypes: DataFrame, model: DataFrame, k: int, events_per_base: float = 1.5) -> DataFrame:
    """Log-likelihood of each read's events under each haplotype of its group: group_id, haplotype_id, read_id, score. reads:
    group_id, read_id, means; haplotypes: group_id, haplotype_id, seq. A group holds one region's reads and few haplotypes."""
    key = ["group_id", "haplotype_id"]
    work = reads.join(levels(haplotypes, model, "seq", k, "hap", key), "group_id")

    def scored(b):
        work, some = hmm.pieces_of_work(b, "hap_mean", "hap_stdv", [events_per_base] * b.num_rows)
        return [*(c.take(pa.array(some)) for c in b.columns[:3]), pa.array(hmm.score_many(work, True, True))] if some else []

    return hmm.batched(work.select("group_id", "haplotype_id", "read_id", "means", "hap_mean", "hap_stdv"), scored, f"group_id {haplotypes.schema['group_id'].dataType.simpleString()}, haplotype_id long, read_id long, score double")


def screen(scores: DataFrame, base: int = 0, least: float = 0.0) -> DataFrame:
    """Haplotypes whose reads together score over the base haplotype's: group_id, haplotype_id, gain."""
    total = scores.groupBy("group_id", "haplotype_id").agg(F.sum("score").alias("score"))
    own = total.filter(F.col("haplotype_id") == base).select("group_id", F.col("score").alias("base"))
    return total.join(own, "group_id").filter(F.col("haplotype_id") != base).select("group_id", "haplotype_id", (F.col("score") - F.col("base")).alias("gain")).filter(F.col("gain") > least)


def homopolymer_lengths(runs: DataFrame, rate: Column, shape: float = 2.461964, least: int = 3, most: int = 9, gain: float = 10.0) -> DataFrame:
    """The likeliest length of each run by the time its events took in all reads, if it beats the current one by gain. runs, a
    row for each read of a run: contig, start_pos, length, duration. The reference also adds the events' likelihood by the
    profile HMM, which isn't done here."""
    from ..functions.stats import gamma_sum_log_density

    tried = runs.withColumn("rate", rate).withColumn("n", F.explode(F.sequence(F.lit(least), F.lit(most))))
    tried = tried.withColumn("score", gamma_sum_log_density(F.col("duration"), F.col("n"), shape, F.col("rate")))
    tried = tried.groupBy("contig", "start_pos", "length", "n").agg(F.sum("score").alias("score"))
    best = tried.groupBy("contig", "start_pos", "length").agg(F.max_by("n", F.struct("score", -F.col("n"))).alias("called"), F.max("score").alias("top"), F.max(F.when(F.col("n") == F.col("length"), F.col("score"))).alias("own"))
    return best.select("contig", "start_pos", "length", F.when(F.col("top") - F.col("own") >= gain, F.col("called")).otherwise(F.col("length")).cast("long").alias("called"))


def event_rows(aligned: DataFrame, events: DataFrame, ref: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """The event table's rows: each aligned event with its reference k-mer and that one's state. aligned: read_id, contig,
    kmer_idx (from ref_start), event_idx, ref_start."""
    at = (F.col("ref_start") + F.col("kmer_idx") + 1).cast("int")
    j = aligned.join(events, ["read_id", "event_idx"]).join(ref, "contig").withColumn("reference_kmer", F.substring("seq", at, F.lit(k)))
    j = j.join(model, j.reference_kmer == model.kmer)
    return j.select("contig", (at - 1).cast("long").alias("position"), "reference_kmer", "read_id", "event_idx", "mean", F.col("level_mean").alias("model_mean"), F.col("level_stdv").alias("model_stdv"), ((F.col("mean") - F.col("level_mean")) / F.col("level_stdv")).alias("standardized_level"))
