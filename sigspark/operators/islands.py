"""Gaps and islands: groups, runs, tiles and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions in a bin. Running sums along a contig are taken within bins, and over the bins' totals; so no task holds a contig.
BIN = 1 << 16


def carried(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df (by, _bin) with the sum of value over all earlier bins; the window sees a row for each bin."""
    total = df.groupBy(*by, "_bin").agg(F.sum(value).alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(total.select(*by, "_bin", F.coalesce(before, F.lit(0)).alias(out)), [*by, "_bin"])


def grouped(variants: DataFrame, distance: int = 10, bin_size: int = BIN) -> DataFrame:
    """Variants with group_id: those of a contig no further than distance from the one before are one group. Ties don't matter: the
    frames go by position alone, so all variants of a place are of its group."""
    v = variants.withColumn("_bin", F.floor(F.col("pos") / bin_size))
    last = v.groupBy("contig", "_bin").agg(F.max("pos").alias("_last"))
    last = last.select("contig", "_bin", F.lag("_last").over(Window.partitionBy("contig").orderBy("_bin")).alias("_before"))
    w = Window.partitionBy("contig", "_bin").orderBy("pos")
    v = v.join(last, ["contig", "_bin"])
    v = v.withColumn("far", F.coalesce((F.col("pos") - F.coalesce(F.lag("pos").over(w), "_before") > distance).cast("int"), F.lit(1)))
    v = carried(v, ["contig"], "far", "_n").withColumn("group_id", F.col("_n") + F.sum("far").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return v.drop("_bin", "_before", "far", "_n")


def variant_groups(variants: DataFrame, distance: int = 10, most: int = 200, bin_size: int = BIN) -> DataFrame:
    """Variants of a contig closer than distance to the one before are one group; groups of a span over most are dropped."""
    out = grouped(variants, distance, bin_size).groupBy("contig", "group_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n"))
    return out.filter(F.col("end_pos") - F.col("start_pos") <= most)


def homopolymers(seqs: DataFrame, key: str = "contig", least: int = 3, most: int = 9) -> DataFrame:
    """Runs of one base of least to most bases."""
    runs = F.regexp_extract_all(F.col("seq"), F.lit("((.)\\2*)"), F.lit(1))
    df = seqs.select(key, F.posexplode(runs).alias("i", "run"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("length", F.char_length("run").cast("long")).withColumn("start_pos", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return df.filter(F.col("length").between(least, most)).select(key, "start_pos", F.substring("run", 1, 1).alias("base"), "length")


def run_lengths(rows: DataFrame, by: list[str], order: list[str], label: Column) -> DataFrame:
    """Run-length code of the labels in order, as in a CIGAR: 3M1I2M."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = rows.withColumn("_label", label).withColumn("_new", F.coalesce((F.col("_label") != F.lag("_label").over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*by, "_run").agg(F.count("*").alias("_n"), F.first("_label").alias("_label"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("_run", "_n", "_label"))), lambda x: F.concat(x["_n"].cast("string"), x["_label"]))
    return runs.groupBy(*by).agg(F.array_join(text, "").alias("cigar"))


def tiles(lengths: DataFrame, key: str = "contig", size: int = 50_000, overlap: int = 200) -> DataFrame:
    """Overlapping windows of each contig; what would leave less than five overlaps at the end belongs to the last."""
    n = F.col("length")
    last = F.greatest(F.ceil((n - size - 5 * overlap + 1) / size), F.lit(0))
    start = lengths.filter(n > 0).select(key, "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("i"), last.alias("last"))
    end = F.when(F.col("i") == F.col("last"), n - 1).otherwise((F.col("i") + 1) * size + overlap)
    return start.select(key, (F.col("i") * size).alias("start_pos"), end.alias("end_pos"))


def coverage(windows: DataFrame, lengths: DataFrame, key: str = "contig", slack: int = 500) -> DataFrame:
    """Whether the windows of a contig begin at 0, each overlaps the next, and the last ends less than slack from the end."""
    w = Window.partitionBy(key).orderBy("start_pos", "end_pos")
    gap = windows.withColumn("gap", F.col("start_pos") > F.lag("end_pos").over(w))
    out = gap.groupBy(key).agg(F.min("start_pos").alias("first"), F.max("end_pos").alias("last"), F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).cast("long").alias("gaps"))
    return out.join(lengths, key).select(key, "gaps", ((F.col("first") == 0) & (F.col("gaps") == 0) & (F.col("length") - F.col("last") <= slack)).alias("covered"))
