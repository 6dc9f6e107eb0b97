"""Modified sites: motifs and their groups, calls, frequencies, comparison, tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.sequence import motif_positions, pieces, places
from ..functions.stats import as_byte, modification_probability
from ..sources.tables import bounded


def frequency(calls: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Modified share of each site (chromosome, start_pos, end_pos) over clear calls: those with |llr| at least threshold
    times the motifs in the group. A call counts once for each motif. Group size is the least of the site's calls, which
    are equal where calls come from one reference; where calls have a sequence, the group's is that of the first read by name."""
    n = F.col("num_motifs")
    clear = calls.filter(F.abs("llr") >= threshold * n)
    text = [F.min_by("sequence", F.struct("read_id", "sequence")).alias("group_sequence")] if "sequence" in calls.columns else []
    out = clear.groupBy("chromosome", "start_pos", "end_pos").agg(F.count("*").alias("num_reads"), F.min(n).cast("int").alias("num_motifs_in_group"), F.sum(n).cast("long").alias("called_sites"), F.sum(F.when(F.col("llr") > 0, n).otherwise(0)).cast("long").alias("called_sites_methylated"), *text)
    share = (F.col("called_sites_methylated") / F.col("called_sites")).alias("methylated_frequency")
    return out.select(*[c for c in out.columns if c != "group_sequence"], share, *["group_sequence"] * len(text))


def split_groups(calls: DataFrame, motif: str = "CG") -> DataFrame:
    """One call of one motif for each motif in a group's sequence, at its place relative to the first; single motifs stay."""
    many = calls.filter("num_motifs > 1").withColumn("at", motif_positions(F.col("sequence"), motif)).withColumn("p", F.explode("at"))
    return _placed(calls, many.withColumn("p", F.col("p") - F.element_at("at", 1)))


def split_by_places(calls: DataFrame, places: DataFrame, on: str = "read_id") -> DataFrame:
    """The same where many calls share a sequence: places (on, at) are its motifs', found once, a row a sequence. Calls without one
    are left out."""
    j = calls.join(places, on)
    return _placed(j, j.filter("num_motifs > 1").withColumn("p", F.explode("at")).withColumn("p", F.col("p") - F.get("at", F.lit(0))))


def _placed(calls: DataFrame, many: DataFrame) -> DataFrame:
    start = F.col("start_pos") + F.col("p")
    many = many.select("read_id", "chromosome", start.alias("start_pos"), start.alias("end_pos"), F.lit(1).alias("num_motifs"), "llr")
    return calls.filter("num_motifs <= 1").select("read_id", "chromosome", "start_pos", "end_pos", "num_motifs", "llr").unionAll(many)


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sites (key, depth, methylated) of two sets that both have, with depth and share in each."""
    a = first.filter("depth > 0").select("key", F.col("depth").alias("depth_1"), (F.col("methylated") / F.col("depth")).alias("frequency_1"))
    b = second.filter("depth > 0").select("key", F.col("depth").alias("depth_2"), (F.col("methylated") / F.col("depth")).alias("frequency_2"))
    return a.join(b, "key")


def bisulfite(rows: DataFrame) -> DataFrame:
    """Depth and methylated reads by site of percentages; reads of the reverse strand belong to the base before."""
    start = F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("start_pos") - 1).cast("string")
    key = F.concat("chromosome", F.lit(":"), start, F.lit("-"), start)
    return rows.groupBy(key.alias("key")).agg(F.sum("reads").cast("long").alias("depth"), F.sum(F.floor(F.col("percent") / 100 * F.col("reads"))).cast("long").alias("methylated"))


def motif_scan(seqs: DataFrame, motif: str, key: str = "read_id") -> DataFrame:
    """Where the motif stands: a row a place, key and pos. Found in the row's own batch; nothing is shuffled or sorted."""
    schema = StructType([seqs.schema[key], StructField("pos", LongType())])

    def task(batches):
        for b in pieces(batches, "seq"):
            row, pos = places(b.column("seq"), motif)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(pos)], names=[key, "pos"])

    return bounded(seqs.select(key, "seq")).mapInArrow(task, schema)


def motif_places(seqs: DataFrame, motif: str, key: str = "read_id") -> DataFrame:
    """The same as an array for each row: key, at."""
    schema = StructType([seqs.schema[key], StructField("at", ArrayType(LongType(), False))])

    def task(batches):
        for b in pieces(batches, "seq"):
            row, pos = places(b.column("seq"), motif)
            bounds = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(bounds), pa.array(pos))], names=[key, "at"])

    return bounded(seqs.select(key, "seq")).mapInArrow(task, schema)


def motif_groups(sites: DataFrame, key: str = "read_id", min_separation: int = 10) -> DataFrame:
    """Groups of sites at most min_separation apart."""
    w = Window.partitionBy(key).orderBy("pos")
    far = F.coalesce((F.col("pos") - F.lag("pos").over(w) > min_separation).cast("int"), F.lit(1))
    numbered = sites.withColumn("far", far).withColumn("group_id", F.sum("far").over(w))
    return numbered.groupBy(key, "group_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("num_motifs"))


def repeated(seqs: DataFrame, key: str = "read_id") -> bool:
    """Whether two rows have one key; only the keys are read."""
    return not seqs.groupBy(key).count().filter("count > 1").isEmpty()


def scanned_groups(seqs: DataFrame, motif: str, key: str = "read_id", min_separation: int = 10, flank: int | None = None) -> DataFrame:
    """motif_groups of motif_scan, and with flank group_context of them. Where each key has one row, groups are made in the row's own
    batch and nothing is shuffled; else places of several rows may share a group, and rows meet by their key."""
    if repeated(seqs, key):
        groups = motif_groups(motif_scan(seqs, motif, key), key, min_separation)
        return groups if flank is None else group_context(groups, seqs, len(motif), flank, key)
    names = [*(["group_id"] if flank is None else []), "start_pos", "end_pos", "num_motifs"]
    schema = StructType([seqs.schema[key], *[StructField(n, LongType()) for n in names], *([] if flank is None else [StructField("sequence", StringType())])])

    def task(batches):
        for b in pieces(batches, "seq"):
            row, pos = places(b.column("seq"), motif)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > min_separation)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            of, start, end = row[first], pos[first], pos[last]
            cols = [b.column(key).take(pa.array(of))]
            if flank is None:
                # A row's groups are numbered from 1: a group's place less that of the row's first.
                cols.append(pa.array(np.arange(len(of)) - np.searchsorted(of, of) + 1))
            cols += [pa.array(start), pa.array(end), pa.array(last - first + 1)]
            if flank is not None:
                text = b.column("seq").to_pylist()
                cols.append(pa.array([text[r][max(x - flank, 0) : y + len(motif) + flank] for r, x, y in zip(of.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    seqs = bounded(seqs.select(key, "seq"))
    return (seqs if flank is None else seqs.filter(F.col(key).isNotNull())).mapInArrow(task, schema)  # a context is looked up by key


def group_context(groups: DataFrame, seqs: DataFrame, motif_size: int = 2, flank: int = 5, key: str = "read_id") -> DataFrame:
    """The sequence that a group's row shows: flank bases on each side of its motifs, cut at the ends."""
    start = F.greatest(F.col("start_pos") - flank, F.lit(0))
    return groups.join(seqs, key).select(key, "start_pos", "end_pos", "num_motifs", F.substring("seq", (start + 1).cast("int"), (F.col("end_pos") + motif_size + flank - start).cast("int")).alias("sequence"))


def scoreable_groups(groups: DataFrame, min_separation: int = 10, most: int = 200, min_flank: int = 10) -> DataFrame:
    """Groups with room before them and of bounded span, as scoring needs."""
    return groups.filter((F.col("start_pos") - min_flank > min_separation) & (F.col("end_pos") - F.col("start_pos") <= most))


def mm_tags(sites: DataFrame, seqs: DataFrame, base: str = "C", key: str = "read_id") -> DataFrame:
    """Modified positions as deltas: how many such bases are skipped before each call."""
    w = Window.partitionBy(key).orderBy("pos")
    bases = seqs.select(key, F.posexplode(motif_positions(F.col("seq"), base)).alias("n", "pos"))  # one pass over each sequence
    runs = sites.join(bases.withColumn("pos", F.col("pos").cast("long")), [key, "pos"]).select(key, "pos", "n")
    deltas = runs.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(w) + 1, F.lit(0)))
    return deltas.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "delta"))), lambda x: x["delta"].cast("string")), ",").alias("mm"))


def mm_tag(seq: Column, motif: str = "CG") -> Column:
    """The deltas where every motif is called, at its first base: such bases in what lies between the motifs. One pass over a
    sequence, nothing is joined; null where there is no motif."""
    parts = F.split(seq, f"[{motif[0]}]{motif[1:]}")
    skipped = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: (F.length(x) - F.length(F.replace(x, F.lit(motif[0])))).cast("string"))
    return F.when(F.size(parts) > 1, F.array_join(skipped, ","))


def ml_value(llr: Column) -> Column:
    """Probability byte of a call with this log-likelihood ratio."""
    return as_byte(modification_probability(llr, F.lit(0.0)))


def expand_sites(groups: DataFrame, key: str = "read_id", motif: str = "CG") -> DataFrame:
    """A row for each motif of a group's sequence (which starts flank bases before start_pos, or at 0)."""
    schema = StructType([groups.schema[key], StructField("start_pos", LongType()), StructField("pos", LongType())])

    def task(batches):
        for b in pieces(batches, "sequence"):
            row, p = places(b.column("sequence"), motif)
            start = b.column("start_pos").take(pa.array(row))
            pos = start.to_numpy(zero_copy_only=False) + p - p[np.searchsorted(row, row)]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), start, pa.array(pos)], names=[key, "start_pos", "pos"])

    return groups.select(key, "start_pos", "sequence").mapInArrow(task, schema)
