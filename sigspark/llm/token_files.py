"""Token ids in length-delimited binary files.

A shard holds one record for each document, in ascending order of doc_id: the length of its data as an unsigned 64-bit
integer, the masked CRC-32 of those eight bytes, the data (the ids, 16 or 32 bits each, as the vocabulary needs), the
masked CRC-32 of the data; all little-endian. Beside it lies an index: width of an id and number of records, then for
each record doc_id, whether that is null, its place in the shard and its number of ids; so records can be read in any
order. Each attempt of a task writes files of its own name, and only those of the attempt that succeeded are in the
manifest, itself a table in the shared folder: a lost executor loses nothing that was written.

A null text is the empty text and gives the end id alone. Rows of one doc_id stand side by side, by a hash of their text;
rows without doc_id come first. Repeated rows are each written, and dealt to several shards where they are very many. An empty table gives a manifest without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, narrow, scratch, written
from .encode import encoder

#: How a checksum is masked, so that data which holds checksums still gets good ones.
MASK_TURN, MASK_ADD = 15, 0xA282EAD8
MANIFEST = "shard int, file string, n_docs long, n_tokens long"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("n", "<u4")])


class Corrupt(ValueError):
    """A checksum or a length doesn't fit."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data) & 0xFFFFFFFF
    return (((c >> MASK_TURN) | (c << (32 - MASK_TURN))) + MASK_ADD) & 0xFFFFFFFF


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Local paths and file:, hdfs:, s3:, gs: addresses."""
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return b"".join((head, struct.pack("<I", masked(head)), data, struct.pack("<I", masked(data))))


def unframe(read, most: int) -> bytes:
    """The data of the record at which read(n) stands. most: no record is longer."""
    head = bytes(read(12))
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]) or (n := struct.unpack("<Q", head[:8])[0]) > most:
        raise Corrupt("a record's length")
    data = bytes(read(n + 4))
    if len(data) < n + 4 or struct.unpack("<I", data[n:])[0] != masked(data[:n]):
        raise Corrupt("a record's data")
    return data[:n]


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents under folder; returns the manifest, a row for each shard in order."""
    width = 2 if encoder(path).size <= 1 << 16 and end_id < 1 << 16 else 4
    fs, top = place(folder)
    fs.create_dir(top, recursive=True)

    def shard(batches):
        e, fs, out, rows, at, tokens = encoder(path), None, None, [], 0, 0
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        try:
            for b in batches:
                ids, texts = b.column(0), b.column(1)
                for i in range(0, len(ids), 512):
                    for k, x in zip(ids.slice(i, 512).to_pylist(), e.encoded(texts.slice(i, 512).to_pylist()), strict=True):
                        if out is None:
                            fs, top = place(folder)
                            out = fs.open_output_stream(f"{top}/{name}.rec", buffer_size=1 << 20)
                        n = len(x) // 4 + 1
                        record = frame((x if width == 4 else np.frombuffer(x, "<u4").astype("<u2").tobytes()) + end)
                        out.write(record)
                        rows.append((k or 0, k is None, at, n))
                        at, tokens = at + len(record), tokens + n
        finally:
            if out is not None:
                out.close()
        if rows:
            with fs.open_output_stream(f"{top}/{name}.idx") as f:
                f.write(struct.pack("<IQ", width, len(rows)) + np.array(rows, dtype=INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [len(rows)], "n_tokens": [tokens]})

    # The row's own number parts rows that are equal in id and text: a row that is repeated very often is in several ranges.
    df = narrow(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text")).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    df = df.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(docs.sparkSession, bounded(df).mapInArrow(shard, MANIFEST), "token-manifest")


class Shard:
    """Random access to one shard: len(), read(i) -> (doc_id, ids)."""

    def __init__(self, file: str):
        fs, path = place(file)
        with fs.open_input_stream(f"{path}.idx") as f:
            head = f.read(12)
            self.width, n = struct.unpack("<IQ", head)
            self.index = np.frombuffer(f.read(n * INDEX.itemsize), INDEX)
        if len(self.index) != n:
            raise Corrupt("the index")
        self.file = fs.open_input_file(f"{path}.rec")

    def __len__(self) -> int:
        return len(self.index)

    def read(self, i: int) -> tuple[int | None, np.ndarray]:
        row = self.index[i]
        self.file.seek(int(row["at"]))
        ids = np.frombuffer(unframe(self.file.read, int(row["n"]) * self.width), f"<u{self.width}")
        if len(ids) != row["n"]:
            raise Corrupt("the index and a record differ")
        return (None if row["null"] else int(row["doc_id"])), ids.astype("<u4")


def scan(file: str) -> Iterator[tuple[int | None, bytes]]:
    """All records of a shard in order: doc_id, ids as little-endian unsigned 32-bit integers."""
    shard = Shard(file)
    shard.file.close()
    fs, path = place(file)
    with fs.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as f:
        for k, null, _, n in shard.index.tolist():
            data = unframe(f.read, n * shard.width)
            if len(data) != n * shard.width:
                raise Corrupt("the index and a record differ")
            yield (None if null else k), data if shard.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id, start (ids of all documents before it), ids (binary, 32 bits each)."""
    # The window sees a row for each shard, of some 10 MB of text or more.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def records(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for k, ids in scan(file):
                    rows.append((k, start, ids))
                    start, held = start + len(ids) // 4, held + len(ids)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        k, s, i = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "ids"])

    n = max(1, manifest.count())
    return shards.repartition(n, "file").mapInArrow(records, "doc_id long, start long, ids binary")


def shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Every record's place, in an order drawn by seed, for readers that fetch records one by one: shard file and number."""
    rows = manifest.select("file", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1)).alias("record"))
    return rows.orderBy(F.xxhash64("file", "record", F.lit(seed)), "file", "record")


def files(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the documents to a new folder of the shared one and reads them back."""
    return read(spark, write(docs, scratch(spark, "tokens"), path, end_id))
