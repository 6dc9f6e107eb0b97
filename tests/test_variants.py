"""Variant calling: combinations and calls against brute force, planted variants, consensus."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import haplotype
from sigspark.plans import variants

SCHEMA = "contig long, pos long, ref string, alt string"
KMERS = ["".join(x) for x in itertools.product("ACGT", repeat=3)]


def apply(base, start, chosen):
    at, out = 0, ""
    for pos, ref, alt in chosen:
        i = pos - start
        if i < at or base[i : i + len(ref)] != ref:
            return None
        out, at = out + base[at:i] + alt, i + len(ref)
    return out + base[at:]


def test_haplotypes_of_groups(spark):
    ref = "ACGTTGCAACGTAGCTAGCTAACGTTAGC" * 4
    rows = [(0, 50, ref[50], "T" if ref[50] != "T" else "A"), (0, 52, ref[52:55], ref[52]), (0, 54, ref[54], "G" if ref[54] != "G" else "C"), (0, 55, "N", "A"), (0, 80, ref[80], ref[80] + "AA"), (0, 50, ref[50], "T" if ref[50] != "T" else "A")]
    frame = spark.createDataFrame(rows, SCHEMA)
    g = variants.groups(frame, spark.createDataFrame([(0, ref)], "contig long, seq string")).orderBy("sub_start")
    got = variants.with_haplotypes(g).orderBy("sub_start").collect()
    assert [(r.sub_start, r.sub_end, len(r.variants)) for r in got] == [(20, 86, 4), (50, 111, 1)]
    for r in got:
        v = [tuple(x) for x in r.variants]
        want = [(list(c), s) for n in range(len(v) + 1) for c in itertools.combinations(range(len(v)), n) if (s := apply(r.base, r.sub_start, [v[i] for i in c])) is not None]
        assert [(c["items"], c.seq) for c in r.combos] == want
    # The limit counts combinations of at least one variant, and must not be reached.
    most = spark.range(1, 30).select("id", variants.most_variants(F.col("id").cast("int"), 1000).alias("r")).collect()
    for x in most:
        r = total = 0
        while r < x.id and total + math.comb(x.id, r + 1) < 1000:
            r, total = r + 1, total + math.comb(x.id, r + 1)
        assert x.r == r
    assert variants.groups(frame, spark.createDataFrame([(0, ref)], "contig long, seq string"), None).count() == 5
    assert variants.groups(frame.limit(0), spark.createDataFrame([(0, ref)], "contig long, seq string")).count() == 0


@pytest.mark.parametrize("ploidy", [1, 2, 3])
def test_calls_equal_brute_force(spark, ploidy):
    draw = np.random.default_rng(ploidy)
    items = [[], [0], [1], [2], [0, 1], [0, 2]]
    group = {"group_id": 1, "contig": "c", "variants": [(10, "A", "C"), (12, "G", "GT"), (15, "T", "A")], "combos": [(x, "") for x in items]}
    g = spark.createDataFrame([group, group | {"group_id": 2}, group | {"group_id": 3, "combos": [([], "")]}], "group_id long, contig string, variants array<struct<pos: long, ref: string, alt: string>>, combos array<struct<items: array<int>, seq: string>>")
    truth = [draw.choice([1, 4][:ploidy]) for _ in range(30)]
    s = draw.normal(-200, 2, (30, len(items)))
    s[np.arange(30), truth] += 12
    rows = [(1, h, r, r % 3 == 0, float(s[r, h])) for r in range(30) for h in range(len(items))]
    scored = spark.createDataFrame(rows, "group_id long, haplotype_id long, read_id long, rc boolean, score double")
    got = {(r.group_id, r.pos): r for r in variants.call(scored, g, ploidy, genotype_all=True).collect()}
    assert len(got) == 6 and all(got[2, p].genotype == "." and got[2, p].quality == 0 for p in (10, 12, 15))

    total = {c: sum(np.logaddexp.reduce(s[r, list(c)]) - math.log(2) for r in range(30)) for c in itertools.combinations_with_replacement(range(len(items)), ploidy)}
    best = max(total, key=total.get)
    gain = total[best] - total[(0,) * ploidy]
    assert gain >= 20
    p = np.exp(s - np.logaddexp.reduce(s, axis=1)[:, None])
    for v, pos in enumerate((10, 12, 15)):
        x, n = got[1, pos], sum(v in items[h] for h in best)
        share = p[:, [v in i for i in items]].sum(axis=1)
        back = np.arange(30) % 3 == 0
        assert x.allele_count == n and x.total_reads == 30 and x.quality == pytest.approx(gain if n else 0)
        assert x.support_fraction == pytest.approx(share.mean()) and x.alt_fwd == pytest.approx(share[~back].sum()) and x.ref_rev == pytest.approx((1 - share[back]).sum())
        assert x.genotype == "/".join(["0"] * (ploidy - n) + ["1"] * n)
    called = variants.call(scored, g, ploidy).collect()
    assert {r.pos for r in called} == {p for (i, p), r in got.items() if i == 1 and r.allele_count}
    assert variants.call(scored.limit(0), g, ploidy).count() == 0


def model(spark, draw):
    level = dict(zip(KMERS, draw.permutation(np.linspace(60, 120, 64)), strict=True))
    return level, spark.createDataFrame([(k, float(x), 1.0) for k, x in level.items()], "kmer string, level_mean double, level_stdv double")


def simulated(draw, level, seq, read_id, place):
    """Events of one read of a sequence; place maps its k-mers to the reference."""
    rows = []
    for i in range(len(seq) - 2):
        rows += [(read_id, 0, float(level[seq[i : i + 3]] + draw.normal(0, 0.7)), place(i)) for _ in range(draw.integers(1, 3))]
    return [(r, c, n, m, p) for n, (r, c, m, p) in enumerate(rows)]


EVENTS = "read_id long, contig long, event_idx long, mean double, ref_pos long"


def test_planted_variants(spark):
    draw = np.random.default_rng(8)
    level, states = model(spark, draw)
    ref = "".join(draw.choice(list("ACGT"), 320))
    other = dict(zip("ACGT", "CGTA", strict=True))
    both, half, none, modified = 80, 160, 240, 166
    first = ref[:both] + other[ref[both]] + ref[both + 1 :]
    second = first[:half] + other[ref[half]] + first[half + 1 :]
    rows = [e for r in range(16) for e in simulated(draw, level, second if r % 2 else first, r, lambda i: i)]
    events = spark.createDataFrame(rows, EVENTS)
    candidates = spark.createDataFrame([(0, p, ref[p], other[ref[p]]) for p in (both, half, none, modified, 5)], SCHEMA)
    contigs = spark.createDataFrame([(0, ref)], "contig long, seq string")
    got = {r.pos: r for r in variants.call_variants(candidates, contigs, events, states, 3, genotype_all=True).collect()}
    assert {p: got[p].genotype for p in (both, half, none, modified)} == {both: "1/1", half: "0/1", none: "0/0", modified: "0/0"}
    assert got[both].quality > 20 and got[both].total_reads == 16 and got[half].support_fraction == pytest.approx(0.5, abs=0.05)
    assert {r.pos for r in variants.call_variants(candidates, contigs, events, states, 3).collect()} == {both, half}
    assert {r.pos for r in variants.screened(candidates, contigs, events, states, 3).collect()} >= {both}


def test_consensus_by_events(spark):
    draw = np.random.default_rng(9)
    level, states = model(spark, draw)
    truth = "".join(draw.choice(list("ACGT"), 200))
    other = dict(zip("ACGT", "CGTA", strict=True))
    # The draft lacks two bases at 100 and has another one at 60.
    draft = truth[:60] + other[truth[60]] + truth[61:100] + truth[102:]
    events = spark.createDataFrame([e for r in range(8) for e in simulated(draw, level, truth, r, lambda i: i if i < 100 else max(99, i - 2))], EVENTS)
    wrong = [(0, 140, draft[140], other[draft[140]]), (0, 70, draft[70], draft[70] + "A")]
    # One of the two bases is a candidate: the second comes of expansion.
    right = [(0, 60, draft[60], truth[60]), (0, 99, draft[99], draft[99] + truth[100])]
    contigs = spark.createDataFrame([(0, draft)], "contig long, seq string")
    seq, calls = variants.consensus(spark.createDataFrame(wrong + right, SCHEMA), contigs, events, states, 3, edits=False)
    assert seq.first().seq == truth and calls.count() == 2


def test_sub_haplotypes(spark):
    ref = "ACGTACGTACGTACGTACGT"
    changes = [(3, "TA", "G"), (8, "A", "ATT"), (9, "CG", "C"), (15, "T", "A")]
    coords, out, at = [], "", 0
    for p, r, a in changes:
        out, coords, at = out + ref[at:p] + a, coords + [*range(at, p)] + [None] * len(a), p + len(r)
    out, coords = out + ref[at:], coords + [*range(at, len(ref))]

    def brute(start, end):
        known = [(c, i) for i, c in enumerate(coords) if c is not None]
        low, high = [x for x in known if x[0] <= start], [x for x in known if x[0] >= end]
        return (low[-1][0], high[0][0], out[low[-1][1] : high[0][1] + 1]) if low and high else None

    pairs = [(a, b) for a in range(len(ref)) for b in range(a, len(ref))]
    df = spark.createDataFrame([(a, b, ref, changes) for a, b in pairs], "a long, b long, seq string, changes array<struct<pos: long, ref: string, alt: string>>")
    got = {(r.a, r.b): r.h and tuple(r.h) for r in df.select("a", "b", haplotype.sub_haplotype(F.col("seq"), F.col("changes"), F.col("a"), F.col("b")).alias("h")).collect()}
    assert got == {x: brute(*x) for x in pairs}


def test_tied_variants_share_a_group(spark):
    """Equal variants come in any order after a shuffle; whichever is first, all are of their place's group."""
    from sigspark.operators import islands

    rows = [("c", 7 * i + 30 * (i // 5), "A", "G") for i in range(3000)] * 20
    v = spark.createDataFrame(rows, "contig string, pos long, ref string, alt string").repartition(16)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that rows are sorted anew behind each join
    try:
        got = sorted((r.start_pos, r.end_pos, r.n) for r in islands.variant_groups(v, bin_size=256).collect())
        numbers = islands.grouped(v, bin_size=256).select("pos", "group_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == [(65 * g, 65 * g + 28, 100) for g in range(600)]
    assert numbers == 3000


def test_scores_as_rows_or_arrays(spark):
    """A row a read with its scores gives the calls that a row a score gives."""
    draw = np.random.default_rng(4)
    rows = [(g, r, bool(r % 2), [float(x) for x in draw.normal(0, 6, 2)]) for g in range(4) for r in range(25)]
    arrays = spark.createDataFrame(rows, "group_id long, read_id long, rc boolean, s array<double>")
    each = arrays.select("group_id", "read_id", "rc", F.posexplode("s").alias("haplotype_id", "score"))
    g = spark.range(4).select(F.col("id").alias("group_id"), F.lit("c").alias("contig"), F.expr("array(named_struct('pos', id, 'ref', 'A', 'alt', 'G')) as variants"), F.expr("array(named_struct('items', cast(array() as array<int>)), named_struct('items', array(0))) as combos"))
    both = [sorted(map(repr, variants.call(x, g, genotype_all=True).drop("support_fraction", "ref_fwd", "ref_rev", "alt_fwd", "alt_rev", "sor", "quality", "fisher").collect())) for x in (arrays, each)]
    assert both[0] == both[1] and len(both[0]) == 4
