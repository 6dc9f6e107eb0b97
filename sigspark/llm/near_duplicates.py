"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact verification, connected classes.

Elements are runs of five words. Each element owns a strip as high as its weight and unbounded in rank; hashed darts fall
on it, one for each unit of area on average, at places that depend on the element alone. Every dart names one of the
signature's coordinates, and a document keeps the earliest dart of each. Only ranks up to about (k log k) / total weight
need be looked at, further ones where a coordinate is still empty. Two documents agree in a coordinate with the probability
of their weighted Jaccard similarity.

Exact copies are one node. Two texts are similar if the weighted Jaccard similarity of their runs, by how often each stands in
the text, is SIMILARITY or more. Nodes that share a band are in a bucket. In each bucket all nodes are first compared with its
least node alone; what is similar by signature is verified on the words of the whole texts, the best partner of a node
first. Then, in buckets that hold more than one class so far, the nodes outside the largest class are compared by signature
with all nodes of the bucket, and what is similar becomes one coarse group; within each of these the nodes outside its
largest class are compared with all its nodes on their word runs. Both go block by block, with blocks of bounded size, and
give only links that join classes; so no pair of a bucket is left out unless both its ends are known to be of one class, or
their signatures differ too much. A bucket of more than BLOCK nodes is first divided: similar texts share one of their rarest
runs (n - ceil(SIMILARITY n) + 1 of n), so its nodes meet again by each of these, and what merely holds the same common
passage doesn't. Classes come from alternating large-star and small-star steps over tables in the shared folder.

Texts of fewer than five words are one element; texts without words are similar to their exact copies only; a null text is
similar to nothing. Repeated rows are in one class. The class is named by its least doc_id; rows without one are in classes
too, and a class of only such rows is null. Very long texts are whole: what a task holds grows with its longest text alone.
Other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, narrow, words_of, written
from .encode import forget

WORDS, SIMILARITY = 5, 0.8
#: Coordinates and those in a band: at similarity 0.8, one pair in 300,000 shares no band.
K, ROWS = 96, 4
#: By their signatures, pairs under this share aren't verified: four and a half standard deviations under 0.8.
ESTIMATE = 0.62
#: Nodes of a bucket that are compared at once; edges in a part of a table.
BLOCK, EDGES = 1024, 200_000
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, i + 1)) for i in range(16)])
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (fixed multipliers of a published finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of words, with repeats."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = mix(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) + _U(0x9E3779B97F4A7C15))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(words))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """DartMinHash of sparse weighted sets: row d holds, of the darts on document d's elements, the earliest of each coordinate.
    doc: ascending; every document has an element; weights above 0, of the order of 1."""
    out = np.full(n_docs * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    first = np.zeros(n_docs, dtype=np.int64)
    last = np.ceil(k * (np.log(k) + 3) / total).astype(np.int64)
    open_ = np.arange(n_docs)
    while len(open_):
        wanted = np.zeros(n_docs, dtype=bool)
        wanted[open_] = True
        rows = np.flatnonzero(wanted[doc])
        d, e, w = doc[rows], element[rows], weight[rows]
        high = np.ceil(w).astype(np.int64)
        slots = last[d] - first[d]
        # one square for each unit of weight and of rank
        squares = high * slots
        of = np.repeat(np.arange(len(rows)), squares)
        own = np.arange(len(of)) - np.repeat(np.cumsum(squares) - squares, squares)
        unit, slot = own // slots[of], own % slots[of] + first[d[of]]
        h = mix(e[of] ^ mix(unit.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + slot.astype(np.uint64)))
        darts = np.searchsorted(_POISSON, (h >> _U(11)).astype(np.float64) * 2.0**-53)
        at = np.repeat(np.arange(len(of)), darts)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        x = mix(h[at] + (nth.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
        y = mix(x ^ _U(0xE7037ED1A0B428DB))
        hit = unit[at] + (y >> _U(11)).astype(np.float64) * 2.0**-53 < w[of[at]]
        key = d[of[at]] * k + ((x >> _U(33)) * _U(k) >> _U(31)).astype(np.int64)
        # The rank, with enough bits of the dart that no two are equal: slot first, then its place in the slot.
        rank = (slot[at].astype(np.uint64) << _U(44)) | (mix(x + y) >> _U(20))
        np.minimum.at(out, key[hit], rank[hit])
        empty = (out.reshape(n_docs, k) == np.iinfo(np.uint64).max).any(axis=1)
        open_ = open_[empty[open_]]
        first[open_], last[open_] = last[open_], last[open_] * 2
    return out.reshape(n_docs, k)


def digests(signature: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate."""
    return (mix(signature) >> _U(48)).astype("<u2")


def similarity(a: list[bytes], b: list[bytes], size: int = WORDS) -> float:
    """Weighted Jaccard similarity of the word runs by their counts, on the words themselves."""
    x, y = runs(a, size), runs(b, size)
    return len(x & y) / len(x | y) if x and y else 0.0


def runs(words: list[bytes], size: int = WORDS) -> frozenset:
    """The word runs, and for each further time that one stands there an element of its own: so the plain similarity of these
    sets is the weighted one of the counts."""
    every = [*zip(*[words[i:] for i in range(size)], strict=False)] if len(words) >= size else [tuple(words)] if words else []
    out = set(every)
    if len(out) < len(every):
        out.update((n, run) for run, count in Counter(every).items() for n in range(1, count))
    return frozenset(out)


def hashed_runs(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The same as sorted 64-bit hashes."""
    h = np.sort(shingles(words, size))
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(np.where(nth > 0, mix(h + nth.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), h)) if len(first) < len(h) else h


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the text), signature (16 bits a coordinate; null for no words). A run weighs how often it stands there."""

    def task(batches):
        forget()
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                own = [shingles(words_of(t)) for t in part.column(2).to_pylist()]
                full = [j for j, s in enumerate(own) if len(s)]
                out: list = [None] * len(own)
                if full:
                    sets = [np.unique(own[j], return_counts=True) for j in full]
                    doc = np.repeat(np.arange(len(full)), [len(s) for s, _ in sets])
                    count = np.concatenate([c for _, c in sets]).astype(np.float64)
                    found = digests(signatures(doc, np.concatenate([s for s, _ in sets]), count, len(full)))
                    for j, row in zip(full, found, strict=True):
                        out[j] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["doc_id", "node", "signature"])

    return keyed(docs).mapInArrow(task, "doc_id long, node binary, signature binary")


def keyed(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").select("doc_id", F.unhex(F.md5("text")).alias("node"), "text")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures agree well enough, with that share."""
    x = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def task(batches):
        for t in batches:
            if t.num_rows:
                p, q = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(t.num_rows, -1) for c in t.columns[2:])
                share = (p == q).mean(axis=1)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(share)], ["a", "b", "share"]).filter(pa.array(share >= ESTIMATE))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(task, "a binary, b binary, share double")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose word runs are similar enough."""
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def task(batches):
        seen: OrderedDict[bytes, frozenset] = OrderedDict()

        def of(node, text):
            if node not in seen:
                if len(seen) > 256:
                    seen.popitem(last=False)
                seen[node] = runs(words_of(text))
            return seen[node]

        for t in batches:
            good = []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in t.columns], strict=True):
                p, q = of(a, ta), of(b, tb)
                both = len(p & q)
                good.append(both >= SIMILARITY * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(y, "b").join(x, "a").select("a", "b", "ta", "tb").mapInArrow(task, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its class) for all nodes of the edges a, b. Tables are written in as many parts as their rows
    need. It ends when every class is a star: then no node has two edges upwards, and none has edges of both kinds."""
    spark = edges.sparkSession
    e = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    parts = 1 + e.count() // EDGES
    keep = lambda df, what: written(spark, df.coalesce(parts), what)

    def least(e):
        # A table of its own: the join with it then shuffles both sides, and a node with very many links can be split.
        return keep(e.groupBy("u").agg(F.min("v").alias("m")), "least")

    def ends(e):
        up = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        return up.unionAll(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))

    while ends(e).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").limit(1).count():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both)
        large = both.filter("v > u").join(m.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = keep(large, "edges")
        dropped(e, m)
        m = least(large)
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        e = keep(small, "edges")
        dropped(large, m)
    out = keep(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    dropped(e)
    return out


def rooted(df: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    """df with the root of each named column as r_<name>; a node without edges is its own."""
    for n in names:
        df = df.join(roots.select(F.col("node").alias(n), F.col("root").alias(f"r_{n}")), n, "left").withColumn(f"r_{n}", F.coalesce(f"r_{n}", n))
    return df


def blocks(members: DataFrame, by: str, roots: DataFrame) -> DataFrame:
    """Members (by, node) of groups with more than one class, dealt into blocks so that in some block i, j each member that
    is outside its group's largest class meets every member of the group. No block has over some 2 BLOCK nodes."""
    m = rooted(members, roots, "node").withColumnRenamed("r_node", "root")
    sizes = m.groupBy(by, "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(by).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("classes")).filter("classes > 1")
    mixed = mixed.select(by, "main", F.ceil(F.col("all") / BLOCK).alias("n_all"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("n_out"))
    # Tables of their own, so that a large group is split by the join, which shuffles both sides.
    m = written(members.sparkSession, m, "members").join(written(members.sparkSession, mixed, "mixed"), by)
    own, zero = F.xxhash64("node"), F.lit(0).cast("long")
    left = m.select(by, F.pmod(own, "n_all").alias("i"), F.explode(F.sequence(zero, F.col("n_out") - 1)).alias("j"), F.lit(True).alias("all"), "node", "root")
    right = m.filter("root <> main").select(by, F.explode(F.sequence(zero, F.col("n_all") - 1)).alias("i"), F.pmod(own, "n_out").alias("j"), F.lit(False).alias("all"), "node", "root")
    return left.unionAll(right)


class Union:
    """Classes within one block; add() says whether a link joins two."""

    def __init__(self):
        self.of: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (y := self.of.get(x, x)) != x:
            self.of[x] = x = self.of.get(y, y)
        return x

    def add(self, a: bytes, b: bytes) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.of[a] = b
        return a != b


def linked(table: pa.Table, alike) -> pa.Table:
    """Links a, b that join the classes of a block: alike(j, x) says which of the nodes x are like node j."""
    node, root = (table.column(c).to_pylist() for c in ("node", "root"))
    every = np.asarray(table.column("all").to_pylist())
    x, classes_, out = np.flatnonzero(every), Union(), []
    for j in np.flatnonzero(~every):
        for i in x[alike(j, x)]:
            if classes_.add(root[i], root[j]):
                out.append((min(node[i], node[j]), max(node[i], node[j])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def divided(members: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (bucket, node), where those of buckets with more than one class and more than BLOCK nodes are in other buckets
    instead, one for each of their rarest runs that several of them share. Rare is counted among these nodes, with the hash
    for equals. Two similar texts share such a run: of n runs at most n - ceil(SIMILARITY n) can be missing from the other."""
    spark = members.sparkSession
    sizes = rooted(members, roots, "node").groupBy("bucket", "r_node").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("classes"))
    large = written(spark, sizes.filter((F.col("classes") > 1) & (F.col("n") > BLOCK)).select("bucket"), "large")

    def exploded(batches):
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = hashed_runs(words_of(text)).view(np.int64)
                for i in range(0, len(own), 1 << 16):
                    part = own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([node] * len(part), pa.binary()), pa.array(part), pa.array(np.full(len(part), len(own)))], ["node", "run", "size"])

    nodes = members.join(large, "bucket", "left_semi").select("node").distinct()
    every = written(spark, texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(exploded, "node binary, run long, size long"), "runs")
    # Tables of their own, so that a very common run is split by the join, which shuffles both sides.
    shared = written(spark, every.groupBy("run").agg(F.count("*").alias("n")), "counts")
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "run"))
    rare = every.join(shared, "run").withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(SIMILARITY) - 1e-9) + 1)
    finer = rare.filter("n > 1").select(F.xxhash64("run", F.lit("run")).alias("bucket"), "node")
    return written(spark, members.join(large, "bucket", "left_anti").select("bucket", "node").unionAll(finer), "divided")


def coarse(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Links that join what is similar by signature within the buckets: no pair of one bucket whose signatures agree well
    enough is left in two of the classes that roots and these links make."""

    def group(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(table.num_rows, -1)
        return linked(table, lambda j, x: (sig[x] == sig[j]).mean(axis=1) >= ESTIMATE)

    dealt = blocks(members, "bucket", roots).join(nodes.select("node", "signature"), "node")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(group, "a binary, b binary").distinct()


def settled(candidates: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between classes, found by comparing all word runs of all nodes of a candidate group that aren't in one class
    yet: shared runs are counted over a block's inverted lists. candidates: node, root of the coarse classes."""

    def hashed(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                sets = [hashed_runs(words_of(t)).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "runs"])

    def group(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(r, "<u8") for r in table.column("runs").to_pylist()]
        size = np.array([len(r) for r in sets])
        every = np.flatnonzero(np.asarray(table.column("all").to_pylist()))
        flat = np.concatenate([sets[i] for i in every]) if len(every) else np.empty(0, "<u8")
        owner = np.repeat(np.arange(len(every)), size[every])
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        end, owner = np.append(first[1:], len(flat)), owner[order]

        def alike(j, x):
            at = np.searchsorted(found, sets[j])
            at = at[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] == sets[j])]
            n = end[at] - first[at]
            rows = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[rows], minlength=len(x))
            return both >= SIMILARITY * (size[x] + size[j] - both)

        return linked(table, alike)

    groups = candidates.select(F.col("root").alias("bucket"), "node")
    runs_ = texts.select("node", "text").mapInArrow(hashed, "node binary, runs binary")
    dealt = blocks(groups, "bucket", roots).join(runs_, "node")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(group, "a binary, b binary").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, node, class_id and root. Only root, a node, tells classes apart: class_id is null for all classes without
    ids, and a repeated doc_id can be the least of several."""
    spark = docs.sparkSession
    made = []

    def keep(df, what):
        made.append(written(spark, df, what))
        return made[-1]

    rows = keep(signed(docs), "signatures")
    nodes = keep(rows.filter("signature is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "nodes")
    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(K // ROWS - 1))).alias("band")
    bands = nodes.select("node", "signature", band).select("node", F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})")).alias("bucket"))
    # A table of its own, here and below, so that a hot bucket or class is split by the join, which shuffles both sides.
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    members = keep(bands.join(keep(hubs, "hubs"), "bucket"), "buckets")
    star = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = keep(estimated(star, nodes), "pairs")
    used = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select("node", F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"))
    texts = keyed(docs).select("node", F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"), "text").join(used, ["node", "doc_id"], "left_semi")
    texts = keep(texts.dropDuplicates(["node"]).select("node", "text"), "texts")
    edges = keep(verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")), texts), "links")
    roots = components(edges)
    more = rooted(pairs, roots, "a", "b").filter("r_a <> r_b").select("a", "b")
    edges = edges.unionAll(keep(verified(more, texts), "links"))
    roots = components(edges)
    links = keep(coarse(divided(members.select("bucket", "node"), texts, roots), nodes, roots), "coarse")
    groups = components(edges.unionAll(links))
    edges = edges.unionAll(keep(settled(groups, texts, roots), "links"))
    roots = components(edges)
    ids = keep(rooted(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), roots, "node"), "ids")
    names = keep(ids.groupBy("r_node").agg(F.min("doc_id").alias("class_id")), "names")
    named = ids.select("node", "r_node").join(names, "r_node").select("node", "class_id", F.col("r_node").alias("root"))
    dropped(*[t for t in made if t is not rows and t is not ids and t is not names])
    whole = rows.filter("node is not null").join(named, "node").select("doc_id", "node", "class_id", "root")
    return whole.unionAll(rows.filter("node is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.col("node").alias("root")))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id; documents without text all stay."""
    spark = docs.sparkSession
    names = docs.columns
    found = written(spark, classes(docs), "classes").filter("node is not null and (doc_id = class_id or class_id is null)")
    found = found.groupBy("root").agg(F.min("node").alias("_node"), F.coalesce(F.min("doc_id"), F.lit(-1 << 63)).alias("_id")).drop("root")
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = (F.col(f"c{names.index(n)}") for n in ("text", "doc_id"))
    one = rows.withColumn("_node", F.unhex(F.md5(text))).withColumn("_id", F.coalesce(key, F.lit(-1 << 63)))
    null = one.filter("_node is null").drop("_node", "_id")
    first = one.filter("_node is not null").join(found, ["_node", "_id"]).dropDuplicates(["_node"])
    return first.select(*null.columns).unionAll(null).toDF(*names)
