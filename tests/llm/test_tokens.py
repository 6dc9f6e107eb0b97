import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from sigspark.llm import packing, token_counts, token_files
from sigspark.llm.encode import Encoder, vocabulary

from .helpers import clashing, docs

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "The cat. The cat.\nThe  cat\t sat", "same", "same", "x" * 5000, "é à  　 z\r\n", "<|endoftext|> a", "one two three " * 900]
ROWS = [*enumerate(TEXTS), (None, "no id"), (5, "again"), (5, "again")]


@cache
def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def plain(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_whole_text(path):
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "ab", "B", "é", "'s", "1", "!?", "<|endoftext|>", "\t", " ", "\x1c", "é", "\0", "中", "🙂", "\r\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(4000)] + TEXTS
    e = Encoder(path)
    assert e.how in ("led", "dropped")
    for t, got in zip(texts, e.encoded(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(path, t), repr(t)


def test_encoder_starts_its_table_anew(monkeypatch):
    monkeypatch.setattr("sigspark.llm.encode.KEPT", 50)
    texts = [f"w{i} w{i + 1} common" for i in range(600)]
    e = Encoder(WORD)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encoded(texts)] == [plain(WORD, t) for t in texts]



@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_are_looked_up_once_a_block(path, monkeypatch):
    """What repeats within a block is looked up once for all; the blocks' and gatherings' sizes change nothing."""
    from sigspark.llm import encode

    texts = [None, "", " ", "\n", "one two two,\nthree", "two " * 700, "two\n" * 9 + "x", "é 日本 two", "a\0b two", "<unk> two  two", "  two", "two two"] * 3
    want = [plain(path, t or "") for t in texts]
    found = []
    learn = encode.Encoder.learn
    monkeypatch.setattr(encode.Encoder, "learn", lambda self, need: (found.append(len(need)), learn(self, need))[1])
    for limits in ({}, {"GATHER": 2}, {"CHARACTERS": 10}, {"AT_ONCE": 3}):
        with monkeypatch.context() as m:
            for k, v in limits.items():
                m.setattr(encode, k, v)
            assert [np.frombuffer(x, "<u4").tolist() for x in encode.Encoder(path).encoded(texts)] == want
        if not limits:
            assert len(found) == 1 and found[0] < 40


def test_histogram(spark):
    df = clashing(docs(spark, ROWS))
    n = sorted(len(plain(BYTE, t)) for _, t in ROWS)
    h = token_counts.histogram(df, BYTE).toPandas().set_index("n_tokens")
    assert {k: v for k, v in h.n_docs.items()} == dict(Counter(n))
    for k, r in h.iterrows():
        assert r.docs_from == sum(x >= k for x in n) and r.tokens_from == sum(x for x in n if x >= k)
        assert r.docs_to == sum(x <= k for x in n) and r.kept_at_limit == sum(min(x, k) for x in n)
        assert r.total_docs == len(n) and r.total_tokens == sum(n)
    hist = token_counts.histogram(df, BYTE)
    assert token_counts.truncated_total(hist, 7).first().kept == sum(min(x, 7) for x in n)
    assert token_counts.quantile(hist, 0.5).first().n_tokens == n[-(-len(n) // 2) - 1]
    none = token_counts.histogram(docs(spark, []), BYTE)
    assert none.count() == 0 and token_counts.truncated_total(none, 7).first().kept == 0


def test_files_round_trip(spark, tmp_path):
    df = clashing(docs(spark, ROWS))
    manifest = token_files.write(df, f"file://{tmp_path}/t", WORD)
    got = sorted(token_files.read(spark, manifest).collect(), key=lambda r: r.start)
    want = Counter((k, tuple([*plain(WORD, t), 1])) for k, t in ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.doc_id for r in got] == sorted((k for k, _ in ROWS), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    order = token_files.shuffled(manifest, 7).collect()
    assert len(order) == len(ROWS)
    seen = Counter()
    for r in order:
        k, ids = token_files.Shard(r.file).read(r.record)
        seen[k, tuple(ids.tolist())] += 1
    assert seen == want
    path = manifest.first().file.removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(token_files.Corrupt):
        list(token_files.scan(manifest.first().file))


def test_files_of_nothing(spark, tmp_path):
    assert token_files.read(spark, token_files.write(docs(spark, []), f"file://{tmp_path}/t", WORD)).count() == 0


def test_masked_differs_from_plain():
    assert token_files.masked(b"abc") != zlib.crc32(b"abc") and token_files.unframe(__import__("io").BytesIO(token_files.frame(b"abc")).read, 10) == b"abc"


def test_a_row_repeated_very_often_is_in_several_shards(spark, tmp_path):
    many = spark.range(50_000).selectExpr("cast(7 as long) as doc_id").join(docs(spark, [(7, "same text")]).drop("doc_id"))
    df = many.select("doc_id", "text").unionAll(docs(spark, [(k, f"text {k}") for k in (1, 9)]).select("doc_id", "text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small shards are put together
    manifest = token_files.write(df, f"file://{tmp_path}/tokens", WORD, 1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 50_002 and manifest.agg({"n_docs": "max"}).first()[0] < 40_000
    out = token_files.read(spark, manifest).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [1] + [7] * 50_000 + [9] and len({r.start for r in out}) == 50_002


def check_pieces(pieces, size, want):
    docs_, windows = {}, {}
    for p in pieces:
        docs_.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        windows.setdefault(p.sequence_id, []).append((p.offset, len(p.ids) // 4))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size
    assert Counter(t for p in pieces for t in [p.doc_id] * (len(p.ids) // 4)) == Counter(t for k, ids in want for t in [k] * len(ids))
    lengths = [sum(n for _, n in parts) for parts in windows.values()]
    return packing.padding(lengths, size)


def test_packing(spark):
    got = packing.pack(clashing(docs(spark, ROWS)), BYTE, 64, 0).collect()
    want = [(k, [*plain(BYTE, t), 0]) for k, t in ROWS]
    assert check_pieces(got, 64, want) == 0
    for k, ids in want:
        if [x for x, _ in ROWS].count(k) == 1:
            mine = sorted((p for p in got if p.doc_id == k), key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == ids and all(p.doc_tokens == len(ids) for p in mine)
    assert packing.pack(docs(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("windows", [3, 8, 1000])
def test_level_is_the_least_sum_of_squares(windows):
    draw, cut = random.Random(1), 0
    p = packing.Packer(20, windows)
    for _ in range(3000):
        s = draw.randint(1, 19)
        n = p.levels.copy()

        def after(g):
            m = n.copy()
            if g:
                m[g] -= 1
            if g + s != 20:
                m[(g + s) % 20] += 1
            return int((m[1:20] ** 2).sum())

        can = [g for g in range(20 - s + 1) if n[g] > 0 or g == 0 and n.sum() < windows]
        can = can or [g for g in range(20) if n[g] > 0]
        assert p.level(s) == max(g for g in can if after(g) == min(map(after, can)))
        cut += p.level(s) + s > 20
        p.add(1, b"\0\0\0\0" * s)
        assert p.n_open == p.levels.sum() <= windows and {g for g in range(21) if p.levels[g]} == set(p.open)
    assert (cut > 0) == (windows < 1000)


def test_open_windows_are_bounded():
    p, out = packing.Packer(16, 5), []
    for i in range(200):
        out += p.add(i, b"\0\0\0\0" * 9)
        assert p.n_open <= 5
    out += p.close()
    lengths = [sum(len(x[2]) // 4 for x in w) for w in out]
    assert sum(lengths) == 1800 and packing.padding(lengths, 16) == 0


def test_few_pieces_are_of_the_last_step():
    """Of 1,000 documents in one task, under one piece in twenty comes of the windows that are open at its end."""
    draw = random.Random(2)
    p, before = packing.Packer(1024), 0
    for i in range(1000):
        before += sum(map(len, p.add(i, b"\0\0\0\0" * int(draw.lognormvariate(6, 1.2) + 1))))
    last = p.close()
    assert sum(map(len, last)) < 0.05 * before and packing.padding([sum(len(x[2]) // 4 for x in w) for w in last], 1024) == 0


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """A batch that goes to the packer or to the motif scan holds some MB, however long its texts are."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from sigspark.operators import methylation
    from sigspark.sources import tables

    name, mapped, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", [], []
    spark.conf.unset(name)
    df = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ACGT "), 10_000).alias("text"))

    def most(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    def map_in_arrow(self, task, schema):
        mapped.append(self)
        return real(self, task, schema)

    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", map_in_arrow)
    for step in (lambda: packing.pack(df, vocabulary("byte_bpe_50k.json")), lambda: methylation.motif_scan(df.toDF("read_id", "seq"), "CG")):
        spark.conf.unset(name)
        step()
        sizes.append([r.bytes for r in real(mapped[-1], most, "bytes long").collect()])
    assert all(sum(s) >= 600 * 50_000 and max(s) < 2 * tables.BATCH for s in sizes), sizes
    spark.conf.set(name, "1000000")
    packing.pack(df, vocabulary("byte_bpe_50k.json"))
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)
