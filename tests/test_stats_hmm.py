import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import stats
from sigspark.operators import hmm, signal


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_normal(spark):
    x, m, s = F.lit(2.25), F.lit(4.0), F.lit(2.0)
    assert value(spark, stats.normal_pdf(x, m, s)) == pytest.approx(0.1360275, abs=1e-7)
    assert value(spark, stats.log_normal_pdf(x, m, s)) == pytest.approx(math.log(0.1360275), abs=1e-6)


def test_logsum(spark):
    assert value(spark, stats.logsum(F.lit(-1000.0), F.lit(-1000.0))) == pytest.approx(-1000 + math.log(2))
    assert value(spark, stats.logsum(F.lit(0.0), F.lit(None).cast("double"))) == 0


def test_lgamma_and_choose(spark):
    for x in (0.3, 1.0, 2.461964, 40.5):
        assert value(spark, stats.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
    assert value(spark, stats.choose(F.lit(10), F.lit(4))) == 210


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (10, 2, 3, 15), (0, 0, 0, 0), (5, 0, 0, 5)])
def test_fisher(t):
    a, b, c, d = t
    n, row, col = sum(t), a + b, a + c
    p = lambda x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row)
    ways = [p(x) for x in range(max(0, row + col - n), min(row, col) + 1)]
    assert stats.fisher_exact(*t) == pytest.approx(sum(w for w in ways if w <= p(a) * (1 + 1e-9)))


def test_scalings(spark):
    """Scaled model against direct evaluation."""
    draw = np.random.default_rng(1)
    shift, scale, drift, var, mu, sd = 10.0, 1.2, 0.5, 1.3, 83.0, 2.0
    rows = [(float(draw.normal(shift + scale * mu + t * drift, var * sd)), float(t)) for t in np.arange(100) * 10 / 4000]
    m, s = signal.model_for_read(F.lit(mu), F.lit(sd), F.lit(shift), F.lit(scale), F.lit(var))
    for r in spark.createDataFrame(rows, ["x", "t"]).select("x", "t", signal.match_log_prob(F.col("x") - F.col("t") * drift, m, s).alias("lp")).collect():
        z = (r.x - r.t * drift - (mu * scale + shift)) / (sd * var)
        assert r.lp == pytest.approx(-0.5 * z * z - math.log(sd * var) - 0.5 * math.log(2 * math.pi))


def test_calibration_recovers_parameters(spark):
    draw = np.random.default_rng(2)
    rows = [(1, float(10 + 1.2 * m + 0.5 * t), float(t), float(m), float(s)) for m, t, s in zip(draw.uniform(60, 120, 300), np.arange(300) / 10, draw.uniform(1, 3, 300), strict=True)]
    df = spark.createDataFrame(rows, ["read_id", "mean", "t", "level_mean", "level_stdv"])
    r = signal.calibrate(df, True).first()
    assert (r.shift, r.scale, r.drift) == (pytest.approx(10, abs=1e-6), pytest.approx(1.2), pytest.approx(0.5, abs=1e-7)) and r["var"] < 1e-3


def paths(n, k):
    """All state paths of n events and k k-mers: lists of (event or None, k-mer, state)."""

    def go(event, kmer, state, path):
        if event == n and kmer == k - 1:
            yield path
        if event < n:
            yield from go(event + 1, kmer, "M", [*path, (event, kmer, "M", "self")]) if state != "K" else ()
            if state in "MB":
                yield from go(event + 1, kmer, "B", [*path, (event, kmer, "B", "self")])
            if kmer + 1 < k:
                yield from go(event + 1, kmer + 1, "M", [*path, (event, kmer + 1, "M", "next")])
        if kmer + 1 < k:
            yield from go(event, kmer + 1, "K", [*path, (None, kmer + 1, "K", "next")])

    yield from go(1, 0, "M", [(0, 0, "M", "start")])


@pytest.mark.parametrize(("n", "k"), [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (2, 4)])
def test_hmm_against_all_paths(n, k):
    draw = np.random.default_rng(n * 10 + k)
    e = draw.normal(-2, 1, (n, k))
    lp = hmm.transitions(1.5)
    before, after = hmm.flanks(n)
    totals = {}
    for path in paths(n, k):
        x, last = before[0] + after[n - 1], None
        for event, kmer, state, move in path:
            if move != "start":
                key = {("M", "M"): f"mm_{move}", ("B", "M"): f"bm_{move}", ("K", "M"): "km", ("M", "B"): "mb", ("B", "B"): "bb", ("M", "K"): "mk", ("B", "K"): "bk", ("K", "K"): "kk"}[last, state]
                x += lp[key]
            if state == "M":
                x += e[event, kmer]
            last = state
        totals[tuple(path)] = x
    every = np.array([*totals.values()])
    assert hmm.forward(e, 1.5) == pytest.approx(np.logaddexp.reduce(every))
    score, traced = hmm.viterbi(e, 1.5)
    assert score == pytest.approx(every.max())
    assert hmm.forward(e, 1.5) >= score - 1e-9
    ends_in_match = {p: x for p, x in totals.items() if p[-1][2] == "M" and p[-1][0] is not None}
    if ends_in_match and traced:
        best = max(ends_in_match, key=ends_in_match.get)
        assert [(j, s) for _, j, s in traced] == [(j, s) for _, j, s, _ in best]


def test_banded_alignment_follows_the_diagonal():
    draw = np.random.default_rng(3)
    levels = draw.uniform(60, 120, 300)
    reps = draw.integers(1, 4, 300)
    truth = np.repeat(np.arange(300), reps)
    pairs, quality = hmm.banded_align(levels[truth] + draw.normal(0, 0.5, len(truth)), levels, np.full(300, 1.5))
    assert quality["ok"] and pairs[0][0] == 0 and pairs[-1][0] == 299
    assert np.mean([truth[e] == k for k, e in pairs]) > 0.97
    assert hmm.banded_align(draw.uniform(0, 500, 50), levels, np.full(300, 1.0))[0] == []


def plain_banded(means, mean, stdv, bandwidth=100):
    """The same cell by cell: pairs (k-mer, event)."""
    n, k, half = len(means), len(mean), bandwidth // 2
    stay, skip, trim = math.log(1 - 1 / (n / k + 1)), math.log(1e-10), math.log(0.01)
    step = math.log(1 - math.exp(skip) - math.exp(stay))
    score, origin, corner, low, high = {(-1, -1): 0.0, (0, -1): trim}, {}, (half, -1 - half), -math.inf, -math.inf
    get = lambda e, j: score.get((e, j), -math.inf)
    for b in range(2, n + k + 2):
        low, high = get(*corner), get(corner[0] - bandwidth + 1, corner[1] + bandwidth - 1)
        right = b % 2 == 1 if low == high == -math.inf else low < high
        corner = (corner[0] + (not right), corner[1] + right)
        for e, j in ((corner[0] - o, corner[1] + o) for o in range(bandwidth)):
            if j == -1 and 0 <= e < n:
                score[e, j] = trim * (e + 1)
            elif 0 <= e < n and 0 <= j < k:
                emit = float(hmm.log_normal(means[e], mean[j], stdv[j]))
                ways = [get(e - 1, j - 1) + step + emit, get(e - 1, j) + stay + emit, get(e, j - 1) + skip]
                score[e, j] = max(ways)
                origin[e, j] = max(range(3), key=lambda w: (ways[w], w))
    e, j = max(range(n), key=lambda e: (get(e, k - 1) + (n - e) * trim, -e)), k - 1
    pairs = []
    while e >= 0 and j >= 0:
        pairs.append((j, e))
        if (e, j) not in origin:
            break
        e, j = e - (origin[e, j] != 2), j - (origin[e, j] != 1)
    return pairs[::-1]


def test_reads_are_aligned_together():
    """Reads of all lengths in one call: each as cell by cell, and far faster than one by one."""
    import time

    draw = np.random.default_rng(8)
    work = []
    for i in range(400):
        levels = np.round(draw.uniform(60, 120, draw.integers(1, 90)))
        truth = np.repeat(levels, draw.integers(0, 4, len(levels))) if i % 2 else levels
        work.append((np.append(truth, levels[-1]) + np.round(draw.normal(0, 2, len(truth) + 1)), levels, np.full(len(levels), 2.0)))
    for bandwidth in (100, 20):
        together = hmm.banded_align_many(work[:40], bandwidth, -1e9, 10**9)
        for w, (k, e, figures) in zip(work, together):
            pairs = plain_banded(*w, bandwidth)
            assert figures["ok"] == (pairs[0][0] == 0) and (not figures["ok"] or [*zip(k, e)] == pairs)
    began = time.time()
    hmm.banded_align_many(work)
    between = time.time()
    for w in work:
        hmm.banded_align(*w)
    assert time.time() - between > 3 * (between - began)


def test_lists_of_nothing(spark):
    """Reads without events, or with a null among them, are no obstacle to the others."""
    x = [70.0, 80.0, 90.0, 100.0]
    rows = [(1, x, x, [1.0] * 4), (2, [], [], []), (3, None, None, None), (4, [70.0, None, 90.0, 100.0], x, [1.0] * 4), (5, x, x, [1.0] * 4)]
    got = hmm.align_banded(spark.createDataFrame(rows, "read_id long, means array<double>, level_mean array<double>, level_stdv array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(i, j, j) for i in (1, 5) for j in range(4)]


def test_paths_of_many_reads_together(spark):
    """Reads of all sizes in one call: each as alone, and far faster than one by one; whole and stretch by stretch."""
    import time

    draw = np.random.default_rng(9)
    work = []
    for i in range(300):
        levels = np.round(draw.uniform(60, 120, draw.integers(1, 60)))
        truth = np.repeat(np.arange(len(levels)), draw.integers(0 if i % 2 else 1, 4, len(levels)))
        truth = np.append(truth, len(levels) - 1)
        means = levels[truth] + np.round(draw.normal(0, 2, len(truth)))
        anchors = [(int(truth[e]), e) for e in range(0, len(truth), 7)] + [(len(levels) - 1, len(truth) - 1)] * (i % 3)
        work.append((means, levels, np.full(len(levels), 2.0), anchors, 1.2 + 0.3 * (i % 4)))
    took = [0.0] * 4
    took[0] -= time.time()
    whole = hmm.viterbi_many([(m, a, s, e) for m, a, s, _, e in work])
    took[0] += time.time()
    took[1] -= time.time()
    for (m, a, s, _, e), path in zip(work, whole, strict=True):
        assert [(i, j, hmm.STATE_NAMES[x]) for i, j, x in zip(*path)] == hmm.viterbi(hmm.log_normal(m[:, None], a, s), e)[1]
    took[1] += time.time()
    took[2] -= time.time()
    chained = hmm.align_chained_many(work, 10, 5)
    took[2] += time.time()
    took[3] -= time.time()
    for w, path in zip(work, chained, strict=True):
        assert [(i, j, hmm.STATE_NAMES[x]) for i, j, x in zip(*path)] == hmm.align_chained(*w, 10, 5)
    took[3] += time.time()
    assert took[1] > 2 * took[0] and took[3] > 3 * took[2]
    # A stretch that takes in all of a read gives the whole read's path.
    ends = [(m, a, s, [(0, 0), (len(a) - 1, len(m) - 1)], e) for m, a, s, _, e in work if len(m) > 1]
    for w, path in zip(ends, hmm.align_chained_many(ends, 1, 10**6), strict=True):
        assert [(i, j, hmm.STATE_NAMES[x]) for i, j, x in zip(*path)] == [x for x in hmm.viterbi(hmm.log_normal(w[0][:, None], w[1], w[2]), w[4])[1] if x[2] != "K"]
    x = [70.0, 80.0, 90.0]
    rows = [(1, x, x, [1.0] * 3, 1.5, [(0, 0), (2, 2)]), (2, [], [], [], 1.5, []), (3, x, x, [1.0] * 3, 1.5, None), (4, None, None, None, 1.5, [(0, 0), (2, 2)])]
    df = spark.createDataFrame(rows, "read_id long, means array<double>, level_mean array<double>, level_stdv array<double>, events_per_base double, anchors array<struct<kmer:int,event:int>>")
    assert sorted(tuple(r) for r in hmm.align_to_reference(df).collect()) == [(1, i, i, "M") for i in range(3)]
    assert sorted(tuple(r) for r in hmm.align_reads(df).collect()) == [(r, i, i, "M") for r in (1, 3) for i in range(3)]


def test_scores_of_many_reads_together():
    """Reads of all sizes in one call, also where a row's cells lie thousands apart: each as by pairwise sums, and far faster than one
    by one."""
    import time

    def plain(e, events_per_base, ends, join):
        n, k = e.shape
        lp, (before, after) = hmm.transitions(events_per_base), hmm.flanks(n)
        m, b, s, end = ([-math.inf] * (k + 1) for _ in range(4))
        for r in range(n):
            x = [-math.inf] * (k + 1), [-math.inf] * (k + 1), [-math.inf] * (k + 1)
            for j in range(1, k + 1):
                ways = [m[j] + lp["mm_self"], m[j - 1] + lp["mm_next"], b[j] + lp["bm_self"], b[j - 1] + lp["bm_next"], s[j - 1] + lp["km"]]
                x[0][j] = join.reduce([*ways, before[r] if j == 1 and (r == 0 or ends) else -math.inf]) + e[r, j - 1]
                x[1][j] = join(m[j] + lp["mb"], b[j] + lp["bb"])
                x[2][j] = join.reduce([x[0][j - 1] + lp["mk"], x[1][j - 1] + lp["bk"], x[2][j - 1] + lp["kk"]])
            m, b, s = x
            if r == n - 1 or ends:
                end = [join.reduce([end[0], *(y[k] + after[r] for y in x)])]
        return end[0]

    draw = np.random.default_rng(10)
    work = [(draw.uniform(60, 120, draw.integers(1, 25)), draw.uniform(60, 120, k), draw.uniform(0.3 if k % 2 else 8, 9, k), 1.2 + 0.3 * (k % 4)) for k in draw.integers(1, 40, 30).tolist()]
    for ends in (False, True):
        for best, join in ((False, np.logaddexp), (True, np.maximum)):
            want = [plain(hmm.log_normal(m[:, None], a, s), e, ends, join) for m, a, s, e in work]
            assert hmm.score_many(work, ends, ends, best) == pytest.approx(want, rel=1e-12)
    work = work * 10
    began = time.time()
    hmm.score_many(work, True, True)
    between = time.time()
    for m, a, s, e in work:
        hmm.forward(hmm.log_normal(m[:, None], a, s), e, True, True)
    assert time.time() - between > 3 * (between - began)


def test_segmentation():
    draw = np.random.default_rng(4)
    parts = [(70, 3, 300), (111, 4, 400), (79, 6, 800), (108.9, 2.5, 900), (79, 6, 200)]
    x = np.concatenate([draw.normal(m, s, n) for m, s, n in parts])
    r = hmm.regions(hmm.segment(x))
    ends = np.cumsum([n for *_, n in parts])
    assert abs(r["start"] - ends[0]) < 15 and abs(r["leader"] - ends[1]) < 15 and abs(r["adapter"] - ends[2]) < 15 and abs(r["polya"] - ends[3]) < 15


def test_segmentation_score_is_the_best_path(spark):
    draw = np.random.default_rng(5)
    x = [float(v) for v in draw.uniform(60, 120, 6)]
    got = value(spark, signal.segmentation_score(F.array(*map(F.lit, x))))
    e = spark.createDataFrame([(v,) for v in x], ["x"]).select(*signal.emissions(F.col("x"))).collect()
    best = max(sum(e[t][s] for t, s in enumerate(p)) + sum(math.log(signal.TRANSITIONS[signal.STATES[a], signal.STATES[b]]) if (signal.STATES[a], signal.STATES[b]) in signal.TRANSITIONS else -1e30 for a, b in itertools.pairwise(p)) for p in itertools.product(range(6), repeat=6) if p[0] == 0 and p[-1] == 5)
    assert got == pytest.approx(best)


def test_switch_equals_two_state_path():
    draw = np.random.default_rng(6)
    for _ in range(200):
        bits = draw.integers(0, 2, draw.integers(1, 30))
        lp = lambda p, b: math.log(p if b else 1 - p)
        best = {}
        for j in range(1, len(bits) + 1):  # first index of the second state
            x = sum(lp(signal.ONES_I, b) for b in bits[:j]) + sum(lp(signal.ONES_A, b) for b in bits[j:]) + (j - 1) * math.log(signal.STAY_I) + (math.log(1 - signal.STAY_I) if j < len(bits) else 0)
            best[j] = x
        j = max(best, key=best.get)
        i, a = hmm.switch(bits)
        assert best[i + 1] == pytest.approx(best[j]) and (a == -1) == (i == len(bits) - 1)


def test_mixture_recovers_components():
    draw = np.random.default_rng(7)
    n, minor = 1000, 0.15
    var = draw.uniform(0.5, 1.5, n)
    which = draw.random(n) < minor
    x = np.where(which, 65.0, 75.0) + draw.normal(0, 1, n) * var
    w, m, _ = hmm.train_mixture(x, var, np.array([0.9, 0.1]), np.array([75.0, 65.0]), np.ones(2))
    assert w[1] == pytest.approx(which.mean(), rel=0.05) and m == pytest.approx([75, 65], rel=0.05)


def test_common_kmers():
    got = hmm.longest_common_kmers("ACGTACGTTT", "ACGTAGGTTT", 3)
    assert got == sorted(got) and all("ACGTACGTTT"[i : i + 3] == "ACGTAGGTTT"[j : j + 3] for i, j in got)


def test_fisher_of_many_reads(spark):
    """The expression against the NumPy form; a table costs one logarithm, so tables of many reads take little."""
    import time

    draw = np.random.default_rng(5)
    rows = [tuple(map(int, draw.integers(0, m, 4))) for m in (3, 12, 60, 500) for _ in range(30)] + [(0, 0, 0, 0), (5, 0, 0, 5), (0, 7, 7, 0), (900, 2, 3, 800)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select("*", stats.fisher_phred(*map(F.col, "abcd")).alias("q")).collect()
    for r in got:
        p = stats.fisher_exact(r.a, r.b, r.c, r.d)
        assert r.q == pytest.approx(min(1000.0, -10 * math.log10(p)) if p > 0 else 1000.0, abs=1e-6)
    large = spark.range(40).select(*[(F.lit(40_000) + F.col("id") * k).alias(n) for k, n in enumerate("abcd")])
    began = time.time()
    large.select(F.sum(stats.fisher_phred(*map(F.col, "abcd")))).first()
    assert time.time() - began < 12
