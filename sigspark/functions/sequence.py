"""Sequence functions as Column expressions, and alphabets with modified bases.

Everything but the functions over Arrow's buffers and those on partial recognition sites is a native expression. The latter (unmethylate, methylation-aware
reverse complement, disambiguate with sites) look at sites that a string's end may cut, and are Python functions wrapped
as Arrow functions where a Column is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of an alphabet in order; recognition sites, their methylated form, and the complement of that form.
ALPHABETS = {
    "nucleotide": ("ACGT", [], [], []),
    "cpg": ("ACGMT", ["CG"], ["MG"], ["GM"]),
    "gpc": ("ACGMT", ["GC"], ["GM"], ["MG"]),
    "dam": ("ACGMT", ["GATC"], ["GMTC"], ["CTMG"]),
    "dcm": ("ACGMT", ["CCAGG", "CCTGG"], ["CMAGG", "CMTGG"], ["GGTMC", "GGAMC"]),
    "u_to_t_rna": ("ACGT", [], [], []),
}
#: What an ambiguity code stands for, least base first.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def base_rank(base: Column, alphabet: str = "nucleotide") -> Column:
    return F.position(base, F.lit(ALPHABETS[alphabet][0])) - 1


def kmer_rank(kmer: Column, alphabet: str = "nucleotide") -> Column:
    """Place of a k-mer among all of its length, in alphabetical order."""
    bases = ALPHABETS[alphabet][0]
    return F.conv(F.translate(kmer, bases, "0123456789"[: len(bases)]), len(bases), 10).cast("long")


def kmer_at(rank: Column, k: int, alphabet: str = "nucleotide") -> Column:
    bases = ALPHABETS[alphabet][0]
    n = len(bases)
    return F.concat(*[F.substring(F.lit(bases), F.pmod(F.floor(rank / n**i), F.lit(n)).cast("int") + 1, F.lit(1)) for i in range(k - 1, -1, -1)])


def successor(kmer: Column, k: int, alphabet: str = "nucleotide") -> Column:
    """The next k-mer in alphabetical order; the last is followed by the first."""
    return kmer_at(F.pmod(kmer_rank(kmer, alphabet) + 1, F.lit(len(ALPHABETS[alphabet][0]) ** k)), k, alphabet)


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order; none of a shorter one. One pass of a pattern that looks ahead: substring() would
    count from the string's start for each."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def methylate(seq: Column, alphabet: str) -> Column:
    """Modifies every whole recognition site, from the left, without overlaps."""
    sites, modified = ALPHABETS[alphabet][1:3]
    if alphabet == "dcm":
        return F.regexp_replace(seq, "CC([AT])GG", "CM$1GG")
    for a, b in zip(sites, modified, strict=True):
        seq = F.replace(seq, F.lit(a), F.lit(b))
    return seq


def disambiguate(seq: Column) -> Column:
    """The least base that an ambiguity code stands for."""
    return F.translate(F.upper(seq), "MRWSYKVHDBN", "AAACCGAAACA")


def without_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def to_dna(seq: Column) -> Column:
    return F.replace(seq, F.lit("U"), F.lit("T"))


def motif_positions(seq: Column, motif: str) -> Column:
    """Starts of all places of the motif, from 0."""
    return F.filter(F.transform(kmers(seq, len(motif)), lambda x, i: F.when(x == motif, i)), lambda i: i.isNotNull())


# ---- over Arrow's buffers: a batch of texts at once, nothing leaves its row ----


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, one behind the other, and where each begins; a null is empty."""
    text = text.fill_null("").cast(pa.large_string())
    _, at, data = text.buffers()
    at = np.frombuffer(at, np.int64, len(text) + 1, text.offset * 8)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)), at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about most bytes, or one row."""
    for b in batches:
        size = buffers(b.column(text))[1]
        i = 0
        while i < b.num_rows:
            n = max(int(np.searchsorted(size, size[i] + most, "right")) - 1 - i, 1)
            yield b.slice(i, n)
            i += n


def places(text: pa.Array, motif: str) -> tuple[np.ndarray, np.ndarray]:
    """All places of the motif in a batch of texts, in order: the row, and the start in characters."""
    data, at = buffers(text)
    m = motif.encode()
    n = max(len(data) - len(m) + 1, 0)
    hit = data[:n] == m[0]
    for i in range(1, len(m)):
        hit &= data[i : i + n] == m[i]
    hit = np.flatnonzero(hit)
    row = np.searchsorted(at, hit, "right") - 1
    own = hit + len(m) <= at[row + 1]
    hit, row = hit[own], row[own]
    if len(data) and data.max() > 127:
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return row, before[hit] - before[at[row]]
    return row, hit - at[row]


def ranked_kmers(seqs: DataFrame, k: int, key: str = "read_id", most: int = 1 << 19) -> DataFrame:
    """Every k-mer of the sequences with its rank, in rows of their reads: key, kmer, rank. The rank of a k-mer with other letters
    than ACGT is null. A text's k-mers go out in batches of most."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([seqs.schema[key], StructField("kmer", StringType()), StructField("rank", LongType())])
    digit = np.full(256, -1, np.int64)
    digit[list(b"ACGT")] = np.arange(4)
    power = 4 ** np.arange(k - 1, -1, -1)

    def task(batches):
        for b in pieces(batches, "seq", most):
            data, at = buffers(b.column("seq"))
            if len(data) and data.max() > 127:
                raise ValueError("k-mers are ranked in ASCII texts alone")
            for low in range(0, len(data) - k + 1, most):
                x = np.lib.stride_tricks.sliding_window_view(data[low : low + most + k - 1], k)
                start = low + np.arange(len(x))
                row = np.searchsorted(at, start, "right") - 1
                own = start + k <= at[row + 1]
                x, row = np.ascontiguousarray(x[own]), row[own]
                d = digit[x]
                text = pa.StringArray.from_buffers(len(x), pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(x))
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), text, pa.array(d @ power, mask=(d < 0).any(axis=1))], names=[key, "kmer", "rank"])

    return seqs.select(key, "seq").mapInArrow(task, schema)


# ---- strings whose ends may cut a site ----


def _site_at(s: str, i: int, forms: list[str]) -> tuple[int, int, int] | None:
    """(form, first and number of its letters) that stands at i: a whole form, or the end of one at the string's start, or
    the start of one at its end."""
    for n, form in enumerate(forms):
        size = min(len(form), len(s) - i)
        if size and s[i : i + size] == form[:size] and "M" in form[:size]:
            return n, 0, size
        if i == 0:
            for cut in range(1, len(form)):
                size = min(len(form) - cut, len(s))
                if s[:size] == form[cut : cut + size] and "M" in form[cut : cut + size]:
                    return n, cut, size
    return None


def unmethylate_text(s: str, alphabet: str) -> str:
    _, sites, modified, _ = ALPHABETS[alphabet]
    out, i = "", 0
    while i < len(s):
        m = _site_at(s, i, modified)
        if m:
            n, cut, size = m
            out += sites[n][cut : cut + size]
            i += size
        else:
            out += s[i]
            i += 1
    return out


def disambiguate_text(s: str, alphabet: str) -> str:
    """Least bases for ambiguity codes; an M that belongs to a recognition site stays."""
    modified = ALPHABETS[alphabet][2]
    out, i = "", 0
    while i < len(s):
        m = _site_at(s, i, modified)
        if m:
            out += s[i : i + m[2]]
            i += m[2]
        else:
            out += IUPAC[s[i]][0]
            i += 1
    return out


def revcomp_text(s: str, alphabet: str) -> str:
    """Reverse complement in which modified sites stay modified on the other strand."""
    _, _, modified, complement = ALPHABETS[alphabet]
    plain = dict(zip("ACGTM", "TGCAG", strict=True)) if alphabet != "dam" else dict(zip("ACGTM", "TGCAT", strict=True))
    out, i = "", 0
    while i < len(s):
        m = _site_at(s, i, modified)
        if m:
            n, cut, size = m
            out = complement[n][cut : cut + size][::-1] + out
            i += size
        else:
            out = plain[s[i]] + out
            i += 1
    return out


def arrow(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function on strings as a vectorised function on Columns; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run
