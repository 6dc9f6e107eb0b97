import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import haplotype, hmm
from sigspark.plans import calling, consensus, polya, training


def test_modified_reads_score_higher(spark):
    """Events drawn from the modified sequence prefer it, and the other way round."""
    draw = np.random.default_rng(1)
    kmers = ["".join(x) for x in np.array(np.meshgrid(*[list("ACGMT")] * 3)).T.reshape(-1, 3)]
    level = {k: float(draw.uniform(60, 120)) for k in kmers}
    model = spark.createDataFrame([(k, v, 1.5) for k, v in level.items()], "kmer string, level_mean double, level_stdv double")
    s = "".join(draw.choice(list("AT"), 40)) + "ACGT" + "".join(draw.choice(list("AT"), 40))
    events = []
    for read, text in ((1, s.replace("CG", "MG")), (2, s)):
        n = 0
        for i in range(len(text) - 2):
            for _ in range(draw.integers(1, 3)):
                events.append((read, 0, n, float(draw.normal(level[text[i : i + 3]], 1.5)), i))
                n += 1
    ev = spark.createDataFrame(events, "read_id long, contig long, event_idx long, mean double, ref_pos long")
    ref = spark.createDataFrame([(0, s)], "contig long, seq string")
    got = {r.read_id: r for r in calling.score_sites(ev, ref, model).collect()}
    assert got[1].llr > 5 and got[2].llr < -5 and got[1].num_motifs == 1 and got[1].start_pos == 41
    hap = spark.createDataFrame([(0, 0, s), (0, 1, s.replace("CG", "MG"))], "group_id long, haplotype_id long, seq string")
    reads = ev.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "mean"))), lambda x: x["mean"]).alias("means")).withColumn("group_id", F.lit(0).cast("long"))
    scores = calling.score_haplotypes(reads.filter("read_id = 1"), hap, model, 3)
    assert [r.haplotype_id for r in calling.screen(scores).collect()] == [1]


def test_consensus_reaches_the_truth(spark):
    truth, draft = "ACGTTGCAACGGTACCATGA", "ACGTAGCTACGGTACCTTGA"
    ref = spark.createDataFrame([(0, draft)], "contig long, seq string")
    votes = spark.createDataFrame([(0, i, b, 9) for i, b in enumerate(truth)] + [(0, i, "C", 2) for i in range(len(truth)) if truth[i] != "C"], "contig long, pos long, base string, n long")
    r = consensus.polish(ref, votes).first()
    assert r.seq == truth and r.rounds < 6


def test_support_and_genotype(spark):
    rows = [(1, i, -1.0 if i % 2 else -9.0, -9.0 if i % 2 else -1.0) for i in range(20)] + [(2, i, -9.0, -1.0) for i in range(20)] + [(3, i, -1.0, -9.0) for i in range(20)]
    got = {r.site: r for r in haplotype.genotype(spark.createDataFrame(rows, "site long, read_id long, s0 double, s1 double")).collect()}
    assert [got[s].gt for s in (1, 2, 3)] == ["0/1", "1/1", "0/0"]
    f = hmm.haplotype_frequencies(np.log(np.array([[0.9, 0.1]] * 7 + [[0.1, 0.9]] * 3)), 60)
    assert f[0] == pytest.approx(0.75, abs=0.03)


def test_combinations(spark):
    df = spark.createDataFrame([(4, 2)], "n int, r int")
    assert [r["items"] for r in haplotype.subsets(df, "n", "r").orderBy("items").collect()] == [[0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]
    assert haplotype.subsets(spark.createDataFrame([(10, 4)], "n int, r int"), "n", "r").count() == 210
    assert [r["items"] for r in haplotype.multisets(spark.createDataFrame([(3,)], "n int"), "n", 2).orderBy("items").collect()] == [[0, 0], [0, 1], [0, 2], [1, 1], [1, 2], [2, 2]]


def test_training_moves_towards_the_data(spark):
    draw = np.random.default_rng(2)
    ev = spark.createDataFrame([("AAA", float(x), 1.0) for x in draw.normal(80, 2, 400)], "kmer string, x double, read_var double")
    model = spark.createDataFrame([("AAA", 70.0, 5.0), ("AAC", 60.0, 1.0)], "kmer string, level_mean double, level_stdv double")
    got = {r.kmer: r for r in training.rounds(ev, model, 3).collect()}
    assert got["AAA"].level_mean == pytest.approx(80, abs=0.5) and got["AAA"].level_stdv == pytest.approx(2, abs=0.3) and got["AAC"].level_mean == 60
    assert training.sample_events(ev, most=50).count() == 50


def test_tail_report(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(m, s, n) for m, s, n in ((70, 3, 300), (111, 4, 400), (79, 6, 800), (108.9, 2.5, 3000), (79, 6, 400))])
    samples = spark.createDataFrame([(1, x.tolist())], "read_id long, samples array<double>")
    rates = spark.createDataFrame([(1, 10_000)], "read_id long, median long")
    r = polya.report(samples, rates, 3000.0).first()
    assert r.qc_tag == "PASS" and r.polya_length == pytest.approx(3000 / 3000 * 100 - 5, abs=1.5)
    tags = spark.createDataFrame([(300, 300), (0, 300), (300, 0), (0, 0)], "i int, a int").select(polya.class_tag(F.col("i"), F.col("a")).alias("t")).collect()
    assert [t.t for t in tags] == ["A+I", "POLYA-ONLY", "POLYI-ONLY", "NONE"]


def test_variants_of_any_length(spark):
    ref = spark.createDataFrame([(0, "ACGTACGT"), (1, "AAAA")], "contig long, seq string")
    v = spark.createDataFrame([(0, 1, "CG", "C"), (0, 2, "G", "T"), (0, 4, "A", "ATT"), (0, 7, "A", "C"), (0, 4, "A", "ATT")], "contig long, pos long, ref string, alt string")
    got = {r.contig: (r.seq, r.n_applied, r.n_skipped) for r in haplotype.apply_variants(ref, v).collect()}
    assert got == {0: ("ACTATTCGT", 2, 2), 1: ("AAAA", 0, 0)}


def test_tail_kinds(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(m, s, n) for m, s, n in ((70, 3, 300), (111, 4, 400), (79, 6, 800), (108.9, 2.5, 3000), (79, 6, 400))])
    r = polya.tail_classes(spark.createDataFrame([(1, x.tolist()), (2, [])], "read_id long, samples array<double>")).collect()
    assert len(r) == 1 and r[0].detected in ("POLYA-ONLY", "A+I")


def test_called_bases(spark):
    from sigspark.operators import alignment

    pairs = alignment.aligned_pairs(spark.createDataFrame([(1, 10, "1S2M1D1M")], "read_id long, pos long, cigar string"))
    sites = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13)], "read_id long, ref_pos long")
    reads = spark.createDataFrame([(1, "GCAC")], "read_id long, seq string")
    assert sorted((r.ref_pos, r.read_pos) for r in alignment.called_bases(sites, pairs, reads).collect()) == [(10, 1), (13, 3)]


def test_chained_alignment():
    """A read of 2000 bases in stretches follows the truth as one matrix would."""
    draw = np.random.default_rng(5)
    levels = draw.uniform(60, 120, 2000)
    truth = np.repeat(np.arange(2000), draw.integers(1, 3, 2000))
    means = levels[truth] + draw.normal(0, 1, len(truth))
    anchors = [(int(truth[e]), int(e)) for e in range(0, len(truth), 40)] + [(1999, len(truth) - 1)]
    got = hmm.align_chained(means, levels, np.full(2000, 1.5), anchors, 1.5)
    assert [e for e, _, _ in got] == list(range(len(truth))) and np.mean([truth[e] == k for e, k, _ in got]) > 0.98
    assert hmm.align_chained(means, levels, np.full(2000, 1.5), anchors[:1], 1.5) == []


def test_event_rows_and_text(spark, tmp_path):
    from sigspark.sources import writers

    aligned = spark.createDataFrame([(1, "c", 0, 0, 2), (1, "c", 1, 1, 2)], "read_id long, contig string, event_idx long, kmer_idx long, ref_start long")
    events = spark.createDataFrame([(1, 0, 81.0), (1, 1, 92.0)], "read_id long, event_idx long, mean double")
    ref = spark.createDataFrame([("c", "AACGTA")], "contig string, seq string")
    model = spark.createDataFrame([("CGT", 80.0, 2.0), ("GTA", 90.0, 1.0)], "kmer string, level_mean double, level_stdv double")
    rows = calling.event_rows(aligned, events, ref, model, 3)
    got = {r.event_idx: (r.position, r.reference_kmer, r.standardized_level) for r in rows.collect()}
    assert got == {0: (2, "CGT", 0.5), 1: (3, "GTA", 2.0)}
    writers.events(rows, str(tmp_path / "e"))
    text = [x for p in sorted((tmp_path / "e").glob("part-*")) for x in p.read_text().splitlines()]
    assert text[0] == "\t".join(writers.EVENTS) and text[1].split("\t")[:6] == ["c", "2", "CGT", "1", "t", "0"]


def test_pair_lookups(spark):
    from sigspark.operators import alignment

    pairs = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 13, 2)], "read_id long, ref_pos long, read_pos long").withColumn("limit", F.lit(12)).withColumn("n", F.lit(4))
    assert alignment.last_pair(pairs, ["read_id"], "limit").first().read_pos == 1
    assert alignment.within_kmers(pairs, "n", 3).count() == 2
    assert alignment.events_at(pairs, spark.createDataFrame([(1, 13)], "read_id long, ref_pos long"), ["read_id"]).count() == 1


def test_homopolymer_lengths_sum_over_reads(spark):
    """No read alone gains enough; all of them do."""
    few, many = ([("c", 5, 4, 16.0)] * n for n in (1, 30))
    frame = lambda rows: spark.createDataFrame(rows, "contig string, start_pos long, length long, duration double")
    called = lambda rows: [r.called for r in calling.homopolymer_lengths(frame(rows), F.lit(2.0)).collect()]
    assert called(few) == [4] and called(many) == [9]


def test_pairs_from_blocks(spark):
    """CIGARs read from bytes against the fold over their operations; positions meet blocks as they meet single pairs."""
    from sigspark.operators import alignment

    texts = ["3S10M2I4D100M5N3M", "", None, "*", "0M5M", "12M", "M7=1X2H", "70M1P1D64M", "1000000M"[1:] + "1M", "9Q4M"]
    a = spark.createDataFrame([(i % 4, i, 60 * i, t) for i, t in enumerate(texts)], "read_id long, line int, pos long, cigar string")
    ops = alignment.cigar_ops(a).filter(F.col("op").isin("M", "=", "X") & (F.col("n") > 0))
    want = sorted((r.read_id, r.line, r.segment, r.pos + r.ref, r["read"], r.n) for r in ops.collect())
    assert sorted((r.read_id, r.line, r.segment, r.ref0, r.read0, r.n) for r in alignment.pair_blocks(a).collect()) == want
    pairs = [(i, line, s, r + j, q + j) for i, line, s, r, q, n in want for j in range(n)]
    assert sorted((r.read_id, r.line, r.segment, r.ref_pos, r.read_pos) for r in alignment.aligned_pairs(a).collect()) == sorted(pairs)
    at = [(i, p) for i in range(4) for p in range(0, 900, 7)]
    found = alignment.pairs_at(alignment.pair_blocks(a), spark.createDataFrame(at, "read_id long, ref_pos long"), ["read_id"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.read_id, r.line, r.segment, r.ref_pos, r.read_pos) for r in found.collect()) == sorted(p for p in pairs if (p[0], p[3]) in set(at))
    cut = alignment.block_pairs(alignment.within_kmers(alignment.pair_blocks(a).withColumn("size", F.lit(40)), "size", 6))
    assert sorted((r.read_id, r.line, r.ref_pos, r.read_pos) for r in cut.collect()) == sorted((p[0], p[1], p[3], p[4]) for p in pairs if p[4] <= 34)
