import random

import pytest

import corpus_pipeline
from sigspark.llm import packing, quality, secrets
from sigspark.llm.encode import vocabulary

from .helpers import docs
from .test_models import corpus
from .test_near_duplicates import brute
from .test_scans import windows
from .test_tokens import check_pieces, plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with junk, copies, benchmark passages and secrets planted among clean documents."""
    out, draw = tmp_path_factory.mktemp("tables"), random.Random(16)
    rows, labels = corpus(draw, 500)
    bench = [(i, " ".join(draw.choice(rows)[1].split()[:3] + [f"q{draw.randrange(99)}" for _ in range(12)])) for i in range(5)]
    rows += [(1000 + i, draw.choice(rows)[1]) for i in range(40)]
    rows += [(2000 + i, rows[i][1] + f" tail{i}") for i in range(40)]
    rows += [(3000 + i, rows[i + 60][1] + " " + bench[i][1]) for i in range(5)]
    rows += [(4000 + i, rows[i + 80][1] + f" password = Zx8{i}kq02mmVV81aLq") for i in range(5)]
    rows += [(5000, None), (5001, ""), (5002, "")]
    docs(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, bench


def test_stages(spark, folder):
    path, rows, bench = folder
    df, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df
        stage(spark, df, path).write.parquet(f"{path}/stage{i}")
        df = spark.read.parquet(f"{path}/stage{i}")
        seen[i] = before, df
        if i < 4:
            assert df.columns == before.columns
    ids = lambda d: sorted(r.doc_id for r in d.collect())

    before, after = seen[0]
    model = quality.train(before, spark.read.parquet(f"{path}/labels.parquet"))
    assert ids(after) == sorted(k for k, t in rows if model.score(quality.features(t)[None])[0] >= quality.THRESHOLD)
    assert len(ids(after)) > 300

    before, after = seen[1]
    own = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(min(g) for g in brute(own))

    before, after = seen[2]
    bad = set().union(*[windows(t) for _, t in bench])
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not windows(r.text) & bad)
    assert not {3000, 3001, 3002, 3003, 3004} & set(ids(after))

    before, after = seen[3]
    text = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        assert text[r.doc_id] == secrets.redacted(r.text, secrets.find(r.text))
    assert not any("kq02mm" in (t or "") for t in text.values())

    before, after = seen[4]
    got = packing.pack(before, vocabulary("byte_bpe_50k.json")).collect()
    want = [(r.doc_id, [*plain(vocabulary("byte_bpe_50k.json"), r.text), 0]) for r in before.collect()]
    assert check_pieces(got, 1024, want) == 0 and after.count() == len(got)


def test_run_equals_its_stages(spark, folder):
    path, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in spark.read.parquet(f"{path}/stage4").collect()}
