"""Text forms of results: each function gives lines in a column value, with their headers, to be written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in columns]).alias("value"))


def headed(df: DataFrame, header: list[str], path: str, order: list[Column] | None = None) -> None:
    """Writes lines in parts under path, each part with the header on top; ordered by range if asked for."""
    rows = df if order is None else df.orderBy(*order)

    def task(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([*(header if first else []), *b.column(0).to_pylist()], pa.string())], ["value"])
                first = False

    rows.select("value").mapInArrow(task, "value string").write.mode("overwrite").text(path)


FREQUENCY = "chromosome start end num_motifs_in_group called_sites called_sites_methylated methylated_frequency group_sequence".split()
CALLS = "chromosome strand start end read_name log_lik_ratio log_lik_methylated log_lik_unmethylated num_calling_strands num_motifs sequence".split()
EVENTS = "contig position reference_kmer read_name strand event_index event_level_mean event_stdv event_length model_kmer model_mean model_stdv standardized_level".split()
TAILS = "readname contig position leader_start adapter_start polya_start transcript_start read_rate polya_length qc_tag".split()


def number(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c if isinstance(c, Column) else F.col(c))


def frequency(df: DataFrame, path: str) -> None:
    """Site frequencies in order of site."""
    rows = df.orderBy("chromosome", "start_pos", "end_pos")
    text = lines(rows, F.col("chromosome"), F.col("start_pos"), F.col("end_pos"), F.col("num_motifs_in_group"), F.col("called_sites"), F.col("called_sites_methylated"), number("methylated_frequency", 3), F.col("group_sequence") if "group_sequence" in df.columns else F.lit("."))
    headed(text, ["\t".join(FREQUENCY)], path)


def calls(df: DataFrame, path: str) -> None:
    rows = df.orderBy("read_idx", "start_pos")
    headed(lines(rows, F.col("chromosome"), F.col("strand"), F.col("start_pos"), F.col("end_pos"), F.col("read_id"), number("llr", 2), number("ll_methylated", 2), number("ll_unmethylated", 2), F.lit(1), F.col("num_motifs"), F.col("sequence")), ["\t".join(CALLS)], path)


def comparison(df: DataFrame, path: str) -> None:
    headed(lines(df.orderBy("key"), F.col("key"), F.col("depth_1"), number("frequency_1", 4), F.col("depth_2"), number("frequency_2", 4)), ["key\tdepth_1\tfrequency_1\tdepth_2\tfrequency_2"], path)


def vcf(df: DataFrame, path: str, window: str | None = None) -> None:
    """Variants in order; info keys in the map's order, positions from 1."""
    info = F.when(F.size("info") > 0, F.array_join(F.transform(F.map_entries("info"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")).otherwise(".") if "info" in df.columns else F.lit(".")
    rows = df.orderBy("contig", "pos", "ref", "alt")
    text = lines(rows, F.col("contig"), F.col("pos") + 1, F.lit("."), F.col("ref"), F.col("alt"), number("qual", 1), F.lit("PASS"), info, F.lit("GT"), F.col("gt"))
    head = ["##fileformat=VCFv4.2", *([f"##sigspark_window={window}"] if window else []), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "sample"])]
    headed(text, head, path)


def fasta(df: DataFrame, path: str, name: str = "contig") -> None:
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def read_index(df: DataFrame, path: str) -> None:
    df.select("read_id", "path").write.mode("overwrite").csv(path, sep="\t")


def model(df: DataFrame, path: str, header: dict[str, str]) -> None:
    rows = df.orderBy("kmer")
    headed(lines(rows, F.col("kmer"), number("level_mean", 5), number("level_stdv", 5), number("sd_mean", 5), number("sd_stdv", 5)), [f"#{k}\t{v}" for k, v in header.items()] + ["kmer\tlevel_mean\tlevel_stdv\tsd_mean\tsd_stdv"], path)


def tails(df: DataFrame, path: str) -> None:
    c = F.col
    headed(lines(df, c("read_id"), c("contig"), c("position"), number(c("start").cast("double"), 1), number(c("leader").cast("double"), 1), number(c("adapter").cast("double"), 1), number(c("polya").cast("double"), 1), number(c("read_rate"), 2), number(c("polya_length"), 2), c("qc_tag")), ["\t".join(TAILS)], path)


def modified_sam(df: DataFrame, path: str) -> None:
    """Alignment rows with modification tags (columns mm: deltas, ml: bytes)."""
    c = F.col
    mm = F.concat(F.lit("Mm:Z:C+m,"), c("mm"), F.lit(";"))
    ml = F.concat(F.lit("Ml:B:C,"), F.array_join(F.transform("ml", lambda x: x.cast("string")), ","))
    df.select(F.concat_ws("\t", c("read_id"), c("flag").cast("string"), c("contig"), (c("pos") + 1).cast("string"), c("mapq").cast("string"), c("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), c("seq"), F.lit("*"), mm, ml).alias("value")).write.mode("overwrite").text(path)


SUMMARY = "read_id num_events num_steps num_skips num_stays total_duration".split()
TRAINING = "kmer num_matches num_skips num_stays num_events_for_training was_trained trained_level_mean trained_level_stdv".split()
KINDS = "readname leader_start adapter_start polya_start transcript_start detected".split()


def event_summary(df: DataFrame, path: str) -> None:
    headed(lines(df, *map(F.col, SUMMARY)), ["\t".join(SUMMARY)], path, None)


def events(df: DataFrame, path: str) -> None:
    """Rows of the event table, by read and event."""
    rows = df.orderBy("read_id", "event_idx")
    c = F.col
    text = lines(rows, c("contig"), c("position"), c("reference_kmer"), c("read_id"), c("strand") if "strand" in df.columns else F.lit("t"), c("event_idx"), number("mean", 2), *[number(n, d) if n in df.columns else F.lit(".") for n, d in (("stdv", 3), ("length", 5))], c("reference_kmer"), number("model_mean", 2), number("model_stdv", 2), number("standardized_level", 2))
    headed(text, ["\t".join(EVENTS)], path)


def training(df: DataFrame, path: str) -> None:
    headed(lines(df.orderBy("kmer"), *map(F.col, TRAINING)), ["\t".join(TRAINING)], path)


def tail_kinds(df: DataFrame, path: str) -> None:
    c = F.col
    headed(lines(df.orderBy("read_id"), c("read_id"), c("start"), c("leader"), c("adapter"), c("polya"), c("detected")), ["\t".join(KINDS)], path)
