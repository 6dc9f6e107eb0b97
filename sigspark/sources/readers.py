"""Readers of the text formats. All but FASTQ are native scans that Spark splits and prunes; compressed files work."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """read_id, seq, signal_path (a comment's last field that names a signal file); of equal names the first record wins."""
    rows = spark.read.option("lineSep", "\n>").text([*paths]).select(F.regexp_replace("value", "^>", "").alias("v"), F.monotonically_increasing_id().alias("at")).filter("v <> ''")
    head = F.regexp_extract("v", "^([^\r\n]*)", 1)
    comment = F.element_at(F.split(head, " "), -1)
    out = rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("read_id"), F.regexp_replace(F.regexp_replace("v", "^[^\r\n]*", ""), r"\s", "").alias("seq"), F.when(F.contains(head, F.lit(" ")) & comment.endswith(".fast5"), comment).alias("signal_path"), "at")
    return first_of(out)


def first_of(rows: DataFrame, key: str = "read_id", order: str = "at") -> DataFrame:
    """The first row of each key, found by partial aggregation."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


class _FastqPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FastqReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_FastqPart(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with store.open_input_stream(path, compression=None) as raw:
            data = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            lines = io.TextIOWrapper(io.BufferedReader(data) if not isinstance(data, gzip.GzipFile) else data, encoding="utf-8")
            n = 0
            for head in lines:
                if not head.startswith("@"):
                    continue
                seq, _, quality = (next(lines, "").rstrip("\r\n") for _ in range(3))
                yield head[1:].split()[0] if head[1:].split() else "", seq, quality, n
                n += 1


class Fastq(DataSource):
    """Format fastq: one partition for each file; option paths, separated by line breaks."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "read_id string, seq string, quality string, record long"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader([p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p])


def fastq(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(Fastq)
    rows = spark.read.format("fastq").option("paths", "\n".join(paths)).load()
    return first_of(rows.withColumn("at", F.monotonically_increasing_id()).drop("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """read_id, path, and whether the index is of text signal files."""
    rows = spark.read.csv(path, sep="\t", schema="read_id string, path string")
    return rows.withColumn("is_slow5", F.col("path").rlike(r"\.[sb]low5"))


def sequencing_summary(spark: SparkSession, *paths: str) -> DataFrame:
    """filename, read_id, whichever of its two names the file column has."""
    rows = spark.read.csv([*paths], sep="\t", header=True)
    names = [c for c in ("filename", "filename_fast5") if c in rows.columns]
    if "read_id" not in rows.columns or not names:
        raise ValueError("a sequencing summary needs the columns read_id and filename or filename_fast5")
    return rows.select(F.coalesce(*names).alias("filename"), "read_id")


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths that a file of file names lists."""
    return [r.value for r in spark.read.text(path).filter("trim(value) <> ''").toLocalIterator()]


def signal_files(spark: SparkSession, folder: str, suffix: str = ".fast5") -> DataFrame:
    """Paths of all files under a folder that carry the suffix in their name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}*").load(folder).select("path", "length")


def variants(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of VCF files: contig, pos (from 0), ref, alt, qual, filter, info, gt."""
    f = F.split("value", "\t")
    rows = spark.read.text([*paths]).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    field = lambda i: F.get(f, i)
    info = F.map_from_entries(F.transform(F.filter(F.split(field(7), ";"), lambda x: x.contains("=")), lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v"))))
    return rows.select(field(0).alias("contig"), (field(1).cast("long") - 1).alias("pos"), field(3).alias("ref"), field(4).alias("alt"), field(5).try_cast("double").alias("qual"), field(6).alias("filter"), info.alias("info"), F.regexp_extract(F.coalesce(field(9), F.lit(".")), "^([^:]*)", 1).alias("gt"))


def variant_window(spark: SparkSession, *paths: str) -> DataFrame:
    """The window that each VCF file's header names: path, contig, start_pos, end_pos."""
    rows = spark.read.text([*paths]).select("value", F.col("_metadata.file_path").alias("path")).filter(F.col("value").startswith("##") & F.contains("value", F.lit("_window=")))
    at = r"_window=([^:]+):(\d+)-(\d+)"
    return rows.select("path", F.regexp_extract("value", at, 1).alias("contig"), F.regexp_extract("value", at, 2).cast("long").alias("start_pos"), F.regexp_extract("value", at, 3).cast("long").alias("end_pos"))


def alignments(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of SAM text: read_id, flag, contig, pos (from 0), mapq, cigar, seq, tags."""
    f = F.split("value", "\t")
    rows = spark.read.text([*paths]).filter(~F.col("value").startswith("@") & (F.trim("value") != ""))
    tags = F.map_from_entries(F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.regexp_extract(x, "^..:.:(.*)$", 1).alias("v"))))
    g = lambda i: F.get(f, i)
    return rows.select(g(0).alias("read_id"), g(1).cast("int").alias("flag"), g(2).alias("contig"), (g(3).cast("long") - 1).alias("pos"), g(4).cast("int").alias("mapq"), g(5).alias("cigar"), g(9).alias("seq"), tags.alias("tags"))


def kmer_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A k-mer model's rows and header. Every k-mer of the alphabet must be there: the count is checked."""
    lines = spark.read.text(path)
    head = {r.k: r.v for r in lines.filter(F.col("value").startswith("#")).select(F.regexp_extract("value", r"^#(\S+)\s*(.*)$", 1).alias("k"), F.regexp_extract("value", r"^#(\S+)\s*(.*)$", 2).alias("v")).toLocalIterator()}
    f = F.split("value", "\t")
    body = lines.filter(~F.col("value").startswith("#") & ~F.col("value").startswith("kmer") & (F.trim("value") != ""))
    rows = body.select(F.get(f, 0).alias("kmer"), *[F.get(f, i).cast("double").alias(n) for i, n in enumerate(("level_mean", "level_stdv", "sd_mean", "sd_stdv"), 1)])
    n = rows.agg(F.count_distinct("kmer").alias("n"), F.max(F.length("kmer")).alias("k"), F.count_if(F.col("kmer").contains("M")).alias("m")).first()
    if n.n != (5 if n.m else 4) ** (n.k or 0):
        raise ValueError(f"{path}: {n.n} k-mers of {n.k} bases")
    return rows, head


def calls(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables of modification calls, with or without a strand column."""
    rows = spark.read.csv([*paths], sep="\t", header=True)
    n = "num_motifs" if "num_motifs" in rows.columns else "num_cpgs"
    return rows.select(F.col("read_name").alias("read_id"), "chromosome", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), F.col(n).cast("int").alias("num_motifs"), F.col("log_lik_ratio").cast("double").alias("llr"), "sequence")


def frequencies(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables of site frequencies; either name of the group's size works."""
    rows = spark.read.csv([*paths], sep="\t", header=True)
    n = "num_motifs_in_group" if "num_motifs_in_group" in rows.columns else "num_cpgs_in_group"
    return rows.select("chromosome", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), F.col(n).cast("int").alias("num_motifs_in_group"), F.col("called_sites").cast("long"), F.col("called_sites_methylated").cast("long"))


def bisulfite(spark: SparkSession, *paths: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    g = lambda i, t: F.get(f, i).cast(t)
    return spark.read.text([*paths]).filter(F.size(f) > 10).select(g(0, "string").alias("chromosome"), g(1, "long").alias("start_pos"), g(2, "long").alias("end_pos"), g(5, "string").alias("strand"), g(9, "double").alias("reads"), g(10, "double").alias("percent"))


def slow5(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of text signal files: read_id, channel figures, raw samples, and the samples in picoamperes."""
    f = F.split("value", "\t")
    rows = spark.read.text([*paths]).filter(~F.col("value").startswith("#") & ~F.col("value").startswith("@") & (F.trim("value") != ""))
    g = lambda i, t: F.get(f, i).cast(t)
    raw = F.transform(F.split(F.get(f, 7), ","), lambda x: x.cast("int"))
    out = rows.select(g(0, "string").alias("read_id"), g(2, "double").alias("digitisation"), g(3, "double").alias("offset"), g(4, "double").alias("range"), g(5, "double").alias("sample_rate"), raw.alias("raw"))
    return out.withColumn("samples", F.transform("raw", lambda x: (x + F.col("offset")) * (F.col("range") / F.col("digitisation"))))
