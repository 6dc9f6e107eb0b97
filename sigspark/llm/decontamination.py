"""Benchmark decontamination with a distributed positional inverted index.

The index lies in the shared folder, cut into segments of some 500,000 words. A segment holds its documents and, for each
of its terms, the ascending positions where the term stands; positions count through the segment, with a gap after each
document. A search takes a block of windows to all segments: a window whose words aren't all among a segment's terms is
out; else the lists are intersected from the rarest term on, each shifted by the term's place in the window. What remains
are the places where the whole phrase stands. Nothing is shuffled but, with more than one block of windows, what was found;
and no list leaves its segment.

An index may be limited to the words of one benchmark, which loses nothing for it. Null texts have no words. Repeated rows
are each reported. Items without words have no window; items without id mark words but aren't listed. Items of one id count
once. An empty table gives an empty report, an empty benchmark one without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, words_of, written

SEGMENT_WORDS = 500_000
#: Windows sent to all tasks at once; more are searched block by block over the stored index.
WINDOWS = 200_000
SEGMENT = "segment long, doc_ids array<long>, n_words array<int>, terms array<string>, ends array<int>, positions binary"
HITS = "array<struct<item_id: string, start: int, length: int>>"
_GAP = 1


def segment(number: int, ids: list, counts: list[int], terms: np.ndarray, positions: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    order = np.argsort(terms, kind="stable")
    found, first = np.unique(terms[order], return_index=True)
    ends = np.append(first[1:], len(terms))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([[names[i].decode("utf-8", "surrogatepass") for i in found]], pa.list_(pa.string())), pa.array([ends.astype(np.int32) if len(found) else []], pa.list_(pa.int32())), pa.array([positions[order].astype("<u4").tobytes()], pa.binary())],
        ["segment", "doc_ids", "n_words", "terms", "ends", "positions"],
    )


def index(docs: DataFrame, only: set[bytes] | None = None) -> DataFrame:
    """Stores the index of the documents in the shared folder. only: index no other words than these."""
    spark = docs.sparkSession
    held = None if only is None else spark.sparkContext.broadcast({w: i for i, w in enumerate(sorted(only))})

    def task(batches):
        def fresh():
            known = {} if held is None else held.value
            return [], [], [], [], known, 0

        number = TaskContext.get().partitionId() << 33
        ids, counts, terms, positions, known, at = fresh()
        for b in batches:
            for k, t in ((k, t) for i in range(0, b.num_rows, 512) for k, t in zip(b.column(0).slice(i, 512).to_pylist(), b.column(1).slice(i, 512).to_pylist(), strict=True)):
                words = words_of(t)
                if held is None:
                    for w in words:
                        known.setdefault(w, len(known))
                x = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                ok = np.flatnonzero(x >= 0)
                ids.append(k)
                counts.append(len(words))
                terms.append(x[ok])
                positions.append(ok + at)
                at += len(words) + _GAP
                if at >= SEGMENT_WORDS:
                    yield segment(number, ids, counts, np.concatenate(terms), np.concatenate(positions), list(known))
                    number += 1
                    ids, counts, terms, positions, known, at = fresh()
        if ids:
            yield segment(number, ids, counts, np.concatenate(terms), np.concatenate(positions), list(known))

    return written(spark, narrow(docs, "doc_id", "text").mapInArrow(task, SEGMENT), "positional-index")


class Postings:
    """One segment, with its terms' positions."""

    def __init__(self, terms: list[str], ends: list[int], positions: bytes):
        self.at = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(terms)}
        self.ends = ends
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)

    def of(self, term: bytes) -> np.ndarray:
        i = self.at.get(term)
        return self.positions[:0] if i is None else self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def phrase(self, words: list[bytes] | tuple[bytes, ...]) -> np.ndarray:
        """Where the words stand one after another: intersected from the rarest term on."""
        lists = sorted(((self.of(w), j) for j, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for own, j in lists[1:]:
            if not len(found):
                break
            i = np.searchsorted(own, found + j)
            i[i == len(own)] = 0
            found = found[own[i] == found + j]
        return found

    def near(self, words: list[bytes] | tuple[bytes, ...], span: int) -> list[tuple[int, int]]:
        """Smallest stretches (first and last position) of at most span words that hold all the words, in any order, each
        found around an occurrence of the rarest."""
        need: dict[bytes, int] = {}
        for w in words:
            need[w] = need.get(w, 0) + 1
        lists = {w: self.of(w) for w in need}
        if any(len(lists[w]) < n for w, n in need.items()):
            return []
        found = set()
        for p in lists[min(need, key=lambda w: len(lists[w]))].tolist():
            around = sorted((x, w) for w, own in lists.items() for x in own[np.searchsorted(own, p - span + 1) : np.searchsorted(own, p + span)].tolist())
            have, first = dict.fromkeys(need, 0), 0
            for x, w in around:
                have[w] += 1
                while have[around[first][1]] > need[around[first][1]]:
                    have[around[first][1]] -= 1
                    first += 1
                if all(have[w] >= n for w, n in need.items()) and x - around[first][0] < span:
                    found.add((around[first][0], x))
        return sorted(found)


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words)] if 0 < len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str | None, list[tuple[bytes, ...]]]]]:
    """The benchmark's items with their windows, in blocks of at most WINDOWS windows; the driver holds one block and one text."""
    block, n = [], 0
    for r in narrow(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text").dropDuplicates().toLocalIterator():
        words = words_of(r.text)
        for i in range(0, max(1, len(words) - size + 1) if words else 0, WINDOWS):
            own = windows(words[i : i + WINDOWS + size - 1], size)
            if n and n + len(own) > WINDOWS:
                yield block
                block, n = [], 0
            block.append((r.item_id, own))
            n += len(own)
    yield block


def search(spark: SparkSession, stored: DataFrame, items: list[tuple[str | None, list[tuple[bytes, ...]]]], slop: int | None = None) -> DataFrame:
    return searched(spark, stored, items, slop)[0]


def searched(spark: SparkSession, stored: DataFrame, items: list[tuple[str | None, list[tuple[bytes, ...]]]], slop: int | None) -> tuple[DataFrame, Broadcast]:
    """Every indexed document: segment and row there, doc_id, n_words, hits (an item's overlapping occurrences joined). items: of one block, id and
    windows. slop: not phrases, but all words of a window within so many more words than it has."""
    vocabulary: dict[bytes, int] = {}
    by_size: dict[int, list[tuple[int, tuple[bytes, ...]]]] = {}
    for n, (_, own) in enumerate(items):
        for w in dict.fromkeys(own):
            by_size.setdefault(len(w), []).append((n, w))
            for x in w:
                vocabulary.setdefault(x, len(vocabulary))
    codes = {k: np.array([[vocabulary[x] for x in w] for _, w in own], dtype=np.int32) for k, own in by_size.items()}
    held = spark.sparkContext.broadcast(([k for k, _ in items], vocabulary, by_size, codes))

    def places(segment: Postings):
        names, vocabulary, by_size, codes = held.value
        there = np.zeros(len(vocabulary), dtype=bool)
        there[[i for x, i in vocabulary.items() if x in segment.at]] = True
        for k, code in codes.items():
            for r in np.flatnonzero(there[code].all(axis=1)).tolist():
                item, words = by_size[k][r]
                if slop is None:
                    for p in segment.phrase(words).tolist():
                        yield item, p, p + k
                else:
                    for a, b in segment.near(words, k + slop):
                        yield item, a, b + 1

    def task(batches):
        names = held.value[0]
        struct = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
        for b in batches:
            for number, ids, counts, terms, ends, positions in zip(*[c.to_pylist() for c in b.columns], strict=True):
                base = np.cumsum([0, *[n + _GAP for n in counts]])
                hits: list[list[dict]] = [[] for _ in ids]
                last: dict[int, dict] = {}
                for item, a, z in sorted(places(Postings(terms, ends, positions))):
                    d = int(np.searchsorted(base, a, side="right")) - 1
                    if z > base[d] + counts[d]:
                        continue  # over the end of a document; only near() can find that
                    old = last.get(item)
                    if old and old["doc"] == d and a <= old["end"]:
                        old["end"] = max(old["end"], z)
                    else:
                        last[item] = old = {"doc": d, "start": a, "end": z}
                        hits[d].append({"item": item, "span": old})
                rows = [[{"item_id": names[h["item"]], "start": int(h["span"]["start"] - base[d]), "length": int(h["span"]["end"] - h["span"]["start"])} for h in own] for d, own in enumerate(hits)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(struct))], ["segment", "row", "doc_id", "n_words", "hits"])

    return stored.mapInArrow(task, f"segment long, row long, doc_id long, n_words long, hits {HITS}"), held


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """The report on every document: doc_id, n_words, hits. The benchmark may have any size: if one block holds its windows, the
    index is limited to their words; else it holds all words, and block after block is searched, stored and let go."""
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, size)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return search(spark, index(docs, {x for _, own in block for w in own for x in w}), block, slop).drop("segment", "row")
    stored, rows = index(docs), F.struct("segment", "row", "doc_id", "n_words")
    every = None
    while block:
        found, held = searched(spark, stored, block, slop)
        found = written(spark, found if every is None else found.filter(F.size("hits") > 0), "hits")
        held.destroy()
        every = found if every is None else every.unionAll(found)
        block, more = more, next(blocks, None)
    every = every.select(rows.alias("r"), F.explode_outer("hits").alias("h")).groupBy("r.segment", "r.row").agg(F.first("r.doc_id").alias("doc_id"), F.first("r.n_words").alias("n_words"), F.collect_list("h").alias("hits"))
    return every.drop("segment", "row")


def digest(report: DataFrame) -> DataFrame:
    """Of each document the words in any hit, the items and a digest of their ids. Hits are joined in order, not word by word."""
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["length"]).alias("b"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate(spans, start, lambda x, h: F.struct(F.greatest(x["end"], h["b"]).alias("end"), (x["n"] + F.greatest(h["b"] - F.greatest(x["end"], h["a"]), F.lit(0))).alias("n")))["n"].cast("long")
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"]), lambda x: x.isNotNull())))
    return report.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark. Windows are matched in the index; what is joined to
    the documents are the contaminated ones alone, by doc_id and a hash of the text."""
    names = docs.columns
    spark = docs.sparkSession
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    # A row is known by this hash of its text: 64 bits among the contaminated ones of one id.
    marked = rows.select(F.xxhash64(key, text).alias("doc_id"), text.alias("text"))
    hit = written(spark, decontaminate(marked, benchmark, size).filter(F.size("hits") > 0).select(F.col("doc_id").alias("h")).distinct(), "contaminated")
    return rows.withColumn("h", F.xxhash64(key, text)).join(hit, "h", "left_anti").drop("h").toDF(*names)
