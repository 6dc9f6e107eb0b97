"""Alignments: CIGAR expansion, depth, allele counts, haplotype reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.sequence import buffers, pieces
from .islands import BIN, carried


def cigar_ops(alignments: DataFrame) -> DataFrame:
    """A row for each operation of a CIGAR string, with where it begins on reference and read, and its segment (N cuts)."""
    text = F.regexp_extract_all("cigar", F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    step = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit(0).alias("segment"), F.array().cast("array<struct<op: string, n: bigint, ref: bigint, read: bigint, segment: int>>").alias("out"))

    def add(a, x):
        op, n = F.right(x, F.lit(1)), F.substring(x, F.lit(1), F.char_length(x) - 1).cast("long")
        both, ref = op.isin("M", "=", "X"), op.isin("D", "N")
        return F.struct((a["ref"] + F.when(both | ref, n).otherwise(0)).alias("ref"), (a["read"] + F.when(both | op.isin("I", "S"), n).otherwise(0)).alias("read"), (a["segment"] + F.when(op == "N", 1).otherwise(0)).alias("segment"), F.array_append(a["out"], F.struct(op.alias("op"), n.alias("n"), a["ref"].alias("ref"), a["read"].alias("read"), a["segment"].alias("segment"))).alias("out"))

    ops = F.aggregate(text, step, add)["out"]
    keep = [c for c in alignments.columns if c != "cigar"]
    return alignments.select(*keep, F.explode(ops).alias("o")).select(*keep, "o.*")


def read_cigars(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The operations of a batch of CIGAR strings, in order: row, letter, length, where it begins on reference and read, segment."""
    data, at = buffers(text)
    digit = (data >= 48) & (data <= 57)
    end = np.flatnonzero(np.isin(data, np.frombuffer(b"MIDNSHP=X", np.uint8)))
    row = np.searchsorted(at, end, "right") - 1
    other = np.maximum.accumulate(np.where(digit, -1, np.arange(len(data))))
    size = end - np.maximum(np.where(end > 0, other[end - 1] + 1, 0), at[row]) if len(end) else end
    end, row, size = (x[size > 0] for x in (end, row, size))
    n = np.zeros(len(end), np.int64)
    for i in range(int(size.max(initial=0))):
        own = size > i
        n[own] += (data[end[own] - 1 - i].astype(np.int64) - 48) * 10**i
    op = data[end]

    def before(x):
        """The sum over the row's earlier operations."""
        run = np.cumsum(x) - x
        return run - run[np.searchsorted(row, row)] if len(run) else run

    on = lambda letters: np.isin(op, np.frombuffer(letters, np.uint8))
    return row, op, n, before(n * on(b"M=XDN")), before(n * on(b"M=XIS")), before(on(b"N").astype(np.int64))


def pair_blocks(alignments: DataFrame) -> DataFrame:
    """Stretches of aligned positions, one row each: the alignments' columns, segment, where it begins on both (ref0, read0), and its
    length n. Nothing is shuffled: CIGARs are read in their own batch."""
    keep = [c for c in alignments.columns if c not in ("cigar", "pos")]
    fields = [StructField("segment", IntegerType()), *[StructField(n, LongType()) for n in ("ref0", "read0", "n")]]
    schema = StructType([*[alignments.schema[c] for c in keep], *fields])

    def task(batches):
        for b in pieces(batches, "cigar", 1 << 20):
            row, op, n, ref, read, segment = read_cigars(b.column("cigar"))
            m = np.isin(op, np.frombuffer(b"M=X", np.uint8)) & (n > 0)
            of = pa.array(row[m])
            start = pc.add(b.column("pos").cast(pa.int64()).take(of), pa.array(ref[m]))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in keep], pa.array(segment[m].astype(np.int32)), start, pa.array(read[m]), pa.array(n[m])], names=schema.names)

    return alignments.select(*keep, "pos", "cigar").mapInArrow(task, schema)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """The blocks' aligned reference and read positions, one row each."""
    keep = [c for c in blocks.columns if c not in ("ref0", "read0", "n")]
    return blocks.select(*keep, "ref0", "read0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(*keep, (F.col("ref0") + F.col("i")).alias("ref_pos"), (F.col("read0") + F.col("i")).alias("read_pos"))


def aligned_pairs(alignments: DataFrame) -> DataFrame:
    """Aligned reference and read positions, one row each. Nothing is shuffled."""
    return block_pairs(pair_blocks(alignments))


def pairs_at(blocks: DataFrame, positions: DataFrame, by: list[str], bin_size: int = 64) -> DataFrame:
    """Pairs at exactly the positions asked for (by, ref_pos, ...): blocks meet them by bin, so that pairs nobody asked for are never
    made. A block's row is laid into the bins that it touches."""
    last = F.col("ref0") + F.col("n") - 1
    b = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("ref0") / bin_size), F.floor(last / bin_size))))
    # A sorted join: a plan's size doesn't show how many rows the CIGARs become, so neither side may be sent to all.
    j = positions.withColumn("_bin", F.floor(F.col("ref_pos") / bin_size)).hint("merge").join(b, [*by, "_bin"])
    j = j.filter((F.col("ref_pos") >= F.col("ref0")) & (F.col("ref_pos") <= last)).withColumn("read_pos", F.col("read0") + F.col("ref_pos") - F.col("ref0"))
    return j.drop("_bin", "ref0", "read0", "n")


def depth(alignments: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """How many spans, half open, cover each position where that changes: a running sum over starts and ends, which are summed
    before the shuffle; along a contig it is taken bin by bin."""
    ends = alignments.filter("end_pos > start_pos").select(*by, F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end_pos").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    change = ends.groupBy(*by, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).withColumn("_bin", F.floor(F.col("pos") / bin_size))
    w = Window.partitionBy(*by, "_bin").orderBy("pos")
    return carried(change, by, "d", "_n").select(*by, "pos", (F.col("_n") + F.sum("d").over(w)).cast("long").alias("depth"))


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """Stretches of aligned bases, one row each: read_id, contig, where it begins on both (ref_pos, read_pos), and its length n."""
    ops = cigar_ops(alignments).filter(F.col("op").isin("M", "=", "X"))
    return ops.select("read_id", "contig", (F.col("pos") + F.col("ref")).alias("ref_pos"), F.col("read").alias("read_pos"), "n")


def bases_at(rows: DataFrame, keep: list[str], text: Column, start: Column, base: str) -> DataFrame:
    """A row for each base of a text whose first one lies at start: keep, ref_pos, base."""
    return rows.select(*keep, start.alias("_s"), F.posexplode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("_p", base)).select(*keep, (F.col("_s") + F.col("_p")).cast("long").alias("ref_pos"), base)


def alleles(blocks: DataFrame, reads: DataFrame, ref: DataFrame, least_depth: int = 20, least_share: float = 0.2) -> DataFrame:
    """Substitutions that a share of the reads at a position show. blocks: as aligned_blocks gives them. A read's sequence is joined
    to its few blocks; their bases are counted by position before anything else moves, and only then the reference's base at each
    is looked up."""
    part = F.expr("substring(seq, cast(read_pos as int) + 1, cast(n as int))")
    seen = bases_at(blocks.join(reads.select("read_id", "seq"), "read_id"), ["contig"], part, F.col("ref_pos"), "alt")
    counts = seen.groupBy("contig", "ref_pos", "alt").agg(F.count("*").alias("n")).join(bases_at(ref, ["contig"], F.col("seq"), F.lit(0), "ref"), ["contig", "ref_pos"])
    total = F.sum("n").over(Window.partitionBy("contig", "ref_pos"))
    out = counts.select("contig", "ref_pos", "ref", "alt", "n", total.alias("depth")).withColumn("share", F.col("n") / F.col("depth"))
    return out.filter((F.col("ref") != F.col("alt")) & (F.col("depth") >= least_depth) & (F.col("share") >= least_share))


def usable(alignments: DataFrame, least_mapq: int = 20, read_group: str | None = None) -> DataFrame:
    """Alignments of enough mapping quality, of one read group if asked for; those without a group then go."""
    out = alignments.filter(F.col("mapq") >= least_mapq)
    return out if read_group is None else out.filter(F.col("rg") == read_group)


def called_bases(sites: DataFrame, pairs: DataFrame, reads: DataFrame, base: str = "C") -> DataFrame:
    """Read positions of calls on the reference, where the read has the base: sites (read_id, ref_pos, ...) joined to pairs, or to
    blocks as pair_blocks gives them."""
    if "n" in pairs.columns:
        met = pairs_at(pairs.select("read_id", "ref0", "read0", "n"), sites, ["read_id"])
    else:
        met = sites.join(pairs.select("read_id", "ref_pos", "read_pos"), ["read_id", "ref_pos"])
    j = met.join(reads.select("read_id", F.col("seq").alias("_seq")), "read_id")
    return j.filter(F.expr("substring(_seq, cast(read_pos as int) + 1, 1)") == base).drop("_seq")


def within_kmers(pairs: DataFrame, read_length: str, k: int) -> DataFrame:
    """Pairs, or blocks of them cut to size, whose read position still begins a k-mer."""
    if "read0" in pairs.columns:
        return pairs.withColumn("n", F.least(F.col("n"), F.col(read_length) - k + 1 - F.col("read0"))).filter("n > 0")
    return pairs.filter(F.col("read_pos") <= F.col(read_length) - k)


def last_pair(pairs: DataFrame, by: list[str], limit: str) -> DataFrame:
    """The last pair at or before a reference position, by group; of several there the last on the read."""
    return pairs.filter(F.col("ref_pos") <= F.col(limit)).groupBy(*by).agg(F.max("ref_pos").alias("ref_pos"), F.max_by("read_pos", F.struct("ref_pos", "read_pos")).alias("read_pos"))


def events_at(pairs: DataFrame, positions: DataFrame, by: list[str]) -> DataFrame:
    """Pairs at exactly the positions asked for."""
    return pairs.join(positions, [*by, "ref_pos"])
