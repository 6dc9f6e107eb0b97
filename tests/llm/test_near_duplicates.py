import random
from collections import Counter, defaultdict

import numpy as np

from sigspark.llm import near_duplicates as nd
from sigspark.llm.common import words_of

from .helpers import clashing, docs


def counted(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    """Weighted Jaccard similarity of two texts' counted runs."""
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if a and b else 0.0


def brute(rows):
    """Classes over all pairs, by doc_id of the rows' place."""
    own = [counted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, t) in enumerate(rows):
        for j in range(i):
            if t is not None and (t == rows[j][1] or alike(own[i], own[j]) >= 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for i, (k, _) in enumerate(rows):
        groups[find(i)].add(k)
    return {frozenset(g) for g in groups.values()}


def found(df):
    groups = defaultdict(set)
    for r in df.collect():
        groups[r.class_id].add(r.doc_id)
    return groups


def mutated(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"x{draw.random()}"
    return words


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    a, b = draw.uniform(0.2, 3, 60), draw.uniform(0.2, 3, 60)
    shares = []
    for r in range(40):
        e = nd.mix(draw.integers(0, 2**62, 60).astype(np.uint64))
        s = nd.signatures(np.repeat([0, 1], 60), np.concatenate([e, e]), np.concatenate([a, b]), 2)
        shares.append((s[0] == s[1]).mean())
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(shares) - want) < 4 * np.std(shares) / 40**0.5


def test_signature_is_the_documents_alone():
    draw = np.random.default_rng(2)
    e = nd.mix(draw.integers(0, 2**62, 5).astype(np.uint64))
    more = nd.mix(draw.integers(0, 2**62, 4000).astype(np.uint64))
    alone = nd.signatures(np.zeros(5, int), e, np.ones(5), 1)
    beside = nd.signatures(np.r_[np.zeros(5, int), np.ones(4000, int)], np.concatenate([e, more]), np.ones(4005), 2)
    assert (alone[0] == beside[0]).all()


def test_classes_equal_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{draw.randrange(9999)}" for _ in range(draw.choice([4, 6, 40, 200]))]
        for _ in range(draw.randint(1, 9)):
            rows.append(" ".join(mutated(draw, words, draw.choice([0, 0, 1, 2, 4, 8]) if len(words) > 20 else 0)))
    rows += ["Same text here, twice.", "same TEXT here twice", "", "", "!!!", "!!!", None, None, "one", "One!", "a b c d", "a b c e"]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    got = {frozenset(g) for g in found(nd.classes(clashing(docs(spark, rows)))).values()}
    assert got == brute(rows)


def test_large_group_loses_no_link(spark, monkeypatch):
    """Copies that differ more from each other than from their source, in blocks smaller than the group."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    draw = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    rows = list(enumerate(" ".join(mutated(draw, words, draw.choice([1, 2, 3, 4, 5, 6]))) for _ in range(150)))
    got = found(nd.classes(docs(spark, rows)))
    assert {frozenset(g) for g in got.values()} == brute(rows)
    assert all(k == min(g) for k, g in got.items())


def test_repeated_runs_count(spark):
    """A line that stands there ten times is not one that stands there once; the forms of the runs agree with each other."""
    draw = random.Random(20)
    line = " ".join(f"v{i}" for i in range(12)) + ". "
    rows = [(0, line), (1, line * 10), (2, line * 11), (3, line * 2), (4, (line * 10).upper()), (5, "la " * 40), (6, "la " * 44), (7, "la " * 90), (8, "one two three " * 30), (9, "one two three " * 31 + "four")]
    rows += [(20 + i, " ".join(draw.choice("abc") for _ in range(draw.randint(3, 60)))) for i in range(60)]
    got = found(nd.classes(docs(spark, rows)))
    assert {frozenset(g) for g in got.values()} == brute(rows)
    for _, t in rows:
        w = words_of(t)
        assert len(nd.hashed_runs(w)) == len(nd.runs(w)) == counted(t).total() == len(set(nd.hashed_runs(w).tolist()))
    for _, a in rows[:12]:
        for _, b in rows[:12]:
            x, y = nd.hashed_runs(words_of(a)), nd.hashed_runs(words_of(b))
            both = len(np.intersect1d(x, y))
            assert np.isclose(both / (len(x) + len(y) - both), alike(counted(a), counted(b))) and np.isclose(nd.similarity(words_of(a), words_of(b)), alike(counted(a), counted(b)))


def test_recall_at_the_threshold(spark):
    """Pairs at a similarity of 0.80 to 0.86 share a class; pairs under 0.8 never do."""
    draw, rows, want = random.Random(21), [], []
    while len(want) < 300:
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([60, 150, 400]))]
        other = mutated(draw, words, draw.choice([1, 2, 3, 5, 8]) * len(words) // 150 + 1)
        a, b = " ".join(words), " ".join(other)
        s = alike(counted(a), counted(b))
        if 0.7 < s < 0.86:
            want.append(s >= 0.8)
            rows += [(len(rows), a), (len(rows) + 1, b)]
    of = {r.doc_id: r.class_id for r in nd.classes(docs(spark, rows)).collect()}
    got = [of[2 * i] == of[2 * i + 1] for i in range(len(want))]
    assert 80 < sum(want) < 280 and not any(g and not w for g, w in zip(got, want))
    assert sum(g for g, w in zip(got, want) if w) >= 0.99 * sum(want)


def test_large_buckets_are_divided(spark, monkeypatch):
    """Texts of different classes that share a long passage, in a bucket over BLOCK, and a very long text: no link is lost."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    draw = random.Random(22)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for g in range(40):
        own = [f"g{g}x{i}" for i in range(60)]
        rows += [" ".join(mutated(draw, own + passage, draw.choice([0, 1, 2, 3]))) for _ in range(draw.choice([1, 1, 2, 5]))]
    rows += ["long " + " ".join(f"z{i % 977}" for i in range(200_000)), "Long, " + " ".join(f"z{i % 977}" for i in range(200_000))]
    rows = list(enumerate(rows))
    seen = []
    dividing = nd.divided
    monkeypatch.setattr(nd, "divided", lambda m, t, r: (seen.append((m.count(), (out := dividing(m, t, r)).count())), out)[1])
    got = found(nd.classes(clashing(docs(spark, rows))))
    assert {frozenset(g) for g in got.values()} == brute(rows)
    assert len(seen) == 1 and seen[0][0] != seen[0][1]


def test_kept(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g!"), (1, "A b c d e f g!"), (7, None), (8, None), (None, "lone words only here now then"), (2, "")]
    got = nd.kept(clashing(docs(spark, rows)))
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in got.collect()) == [(False, 1, "A b c d e f g!"), (False, 2, ""), (False, 7, ""), (False, 8, ""), (True, 0, "lone words only here now then")]
    assert got.columns == clashing(docs(spark, rows)).columns
    assert nd.kept(docs(spark, [])).count() == 0 and nd.classes(docs(spark, [])).count() == 0


def test_kept_tells_classes_apart_without_ids(spark):
    rows = [(None, "lone words only here now then"), (None, "quite another text about some river"), (None, "Quite another text, about some river!"), (None, "third thing of its own kind altogether"), (5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (5, "seven eight nine ten eleven twelve"), (9, "One two three four five six.")]
    got = sorted((r.doc_id or 0, " ".join(w.decode() for w in nd.words_of(r.text))) for r in nd.kept(docs(spark, rows)).collect())
    assert got == [(0, "lone words only here now then"), (0, "quite another text about some river"), (0, "third thing of its own kind altogether"), (5, "one two three four five six"), (5, "seven eight nine ten eleven twelve")]


def test_components(spark):
    draw = random.Random(7)
    ends = [(draw.randrange(400), draw.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in ends], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in nd.components(df).collect()}
    near = defaultdict(set)
    for a, b in ends:
        near[a].add(b)
        near[b].add(a)
    for x in got:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)
    assert set(got) == {x for a, b in ends if a != b for x in (a, b)}
