import itertools

import pytest
from pyspark.sql import functions as F

from sigspark.functions import sequence as seq

# Golden values of modified alphabets: input, output.
METHYLATE = {
    "cpg": "C C, G G, CG MG, GC GC, CGCG MGMG, AAGCGT AAGMGT, CGGCGT MGGMGT, CGCGC MGMGC",
    "dam": "G G, GA GA, GAT GAT, GATC GMTC, GATCG GMTCG, GATCGA GMTCGA, GATCGAT GMTCGAT, GATCGATC GMTCGMTC",
    "dcm": "C C, CC CC, CCA CCA, CCAG CCAG, CCAGG CMAGG, CAGG CAGG, CCT CCT, CCTG CCTG, CCTGG CMTGG, CCAGGCCTGG CMAGGCMTGG, CCAGGCCTG CMAGGCCTG",
}
UNMETHYLATE = {
    "cpg": "C C, CG CG, M C, MG CG, MT MT",
    "dam": "M A, MT AT, MTC ATC, GM GA, GMT GAT, GMTC GATC, GMTCG GATCG, GMTCGM GATCGA, GMTCGMTC GATCGATC, GMTCGMT GATCGAT, MA MA, CM CM",
    "dcm": "M C, MA CA, MT CT, MAG CAG, MTG CTG, MAGG CAGG, MTGG CTGG, CM CC, GM GM, MC MC",
}
DISAMBIGUATE = {
    "cpg": "M M, MT AT, MG MG, AMG AMG, CAM CAM",
    "dam": "GMTC GMTC, M M, MT MT, MTC MTC, GM GM, GMT GMT, GMA GAA",
    "dcm": "M M, CM CM, GM GA, MA MA, MT MT, MC AC",
}
REVCOMP = {
    "cpg": "M G, C G, G C, MG MG, CG CG, AM GT, AMG MGT, AAAMG MGTTT, MGMG MGMG, MGAMG MGTMG, GTACATG CATGTAC",
    "dam": "M T, G C, GM TC, GMT MTC, GMTC GMTC, MTC GMT, TC GA, C G, GATC GATC, ATC GAT, GAT ATC",
    "dcm": "M G, MT AG, MTG MAG, MTGG CMAG, MA TG, MAG MTG, MAGG CMTG, CM GG, CCAGG CCTGG, CCTGG CCAGG, CMAGG CMTGG, CMTGG CMAGG",
}


def cases(table):
    return [(a, *pair.split()) for a, text in table.items() for pair in text.split(", ")]


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first()
    return row.x


@pytest.mark.parametrize("alphabet", METHYLATE)
def test_methylate(spark, alphabet):
    rows = [x[1:] for x in cases(METHYLATE) if x[0] == alphabet]
    df = spark.createDataFrame(rows, ["a", "b"]).select("a", "b", seq.methylate(F.col("a"), alphabet).alias("c"))
    assert all(r.b == r.c for r in df.collect())


@pytest.mark.parametrize(("alphabet", "s", "want"), cases(UNMETHYLATE))
def test_unmethylate(alphabet, s, want):
    assert seq.unmethylate_text(s, alphabet) == want


@pytest.mark.parametrize(("alphabet", "s", "want"), cases(DISAMBIGUATE))
def test_disambiguate(alphabet, s, want):
    assert seq.disambiguate_text(s, alphabet) == want


@pytest.mark.parametrize(("alphabet", "s", "want"), cases(REVCOMP))
def test_revcomp(alphabet, s, want):
    assert seq.revcomp_text(s, alphabet) == want


@pytest.mark.parametrize("alphabet", ["cpg", "gpc", "dam", "dcm"])
def test_methylation_round_trips(spark, alphabet):
    plain = ["".join(x) for x in itertools.product("ACGT", repeat=6)]
    df = spark.createDataFrame([(p,) for p in plain], ["s"]).select("s", seq.methylate(F.col("s"), alphabet).alias("m"))
    for r in df.collect():
        assert seq.unmethylate_text(r.m, alphabet) == r.s
        assert seq.revcomp_text(seq.revcomp_text(r.m, alphabet), alphabet) == r.m


def test_ranks_and_successors(spark):
    df = spark.createDataFrame([("AAAAA", 0, "AAAAC"), ("GATGA", 568, "GATGC"), ("AAAAT", 3, "AAACA"), ("TTTTT", 1023, "AAAAA")], ["k", "rank", "next"])
    for r in df.select("*", seq.kmer_rank(F.col("k")).alias("got"), seq.successor(F.col("k"), 5).alias("n")).collect():
        assert (r.got, r.n) == (r.rank, r.next)
    every = ["".join(x) for x in itertools.product("ACGMT", repeat=3)]
    got = spark.createDataFrame([(k,) for k in every], ["k"]).select("k", seq.kmer_rank(F.col("k"), "cpg").alias("r"), seq.successor(F.col("k"), 3, "cpg").alias("n")).collect()
    assert [r.r for r in got] == list(range(125)) and [r.n for r in got] == every[1:] + every[:1]


def test_kmers_and_motifs(spark):
    assert one(spark, seq.kmers(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, seq.kmers(F.col("s"), 3), s="AC") == []
    assert one(spark, seq.motif_positions(F.col("s"), "CG"), s="CGACGCG") == [0, 3, 5]
    assert one(spark, seq.motif_positions(F.col("s"), "AA"), s="AAAC") == [0, 1]
    assert one(spark, seq.revcomp(F.col("s")), s="GATGA") == "TCATC"
    assert one(spark, seq.arrow(lambda s: seq.revcomp_text(s, "cpg"))(F.col("s")), s="AMG") == "MGT"


def test_places_in_buffers(spark):
    """Places, groups, contexts and ranked k-mers against plain Python: nulls, empty texts, ends that touch, letters of several bytes;
    nothing is shuffled."""
    from sigspark.operators import methylation

    texts = ["", None, "C", "GCG", "CGCG", "ACGTTTTTTTTTTTTCGA", "éCG中CG", "G", "AAAA" * 50 + "CG"]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    want = [(i, p) for i, t in enumerate(texts) for p in range(len(t or "")) if t[p : p + 2] == "CG"]
    scan = methylation.motif_scan(df, "CG")
    assert sorted(map(tuple, scan.collect())) == want
    assert "Exchange" not in scan._jdf.queryExecution().toString() and "Window" not in scan._jdf.queryExecution().toString()
    assert sorted((r.read_id, p) for r in methylation.motif_places(df, "CG").collect() for p in r["at"]) == want
    for rows in (df, df.unionAll(df.filter("read_id = 5").withColumn("seq", F.lit("ACGTTTTTCG")))):  # also where a key repeats
        groups = methylation.motif_groups(methylation.motif_scan(rows, "CG"))
        got = methylation.scanned_groups(rows, "CG")
        assert sorted(map(tuple, got.select(groups.columns).collect())) == sorted(map(tuple, groups.collect()))
        shown = methylation.group_context(groups, rows)
        assert sorted(map(tuple, methylation.scanned_groups(rows, "CG", flank=5).collect())) == sorted(map(tuple, shown.collect()))
    assert "Window" not in methylation.scanned_groups(df, "CG")._jdf.queryExecution().toString()
    bases = spark.createDataFrame([(1, "ACGTACGTT"), (2, ""), (3, None), (4, "TTTNA"), (5, "GG"), (6, "GGG")], "read_id long, seq string")
    want = [(r.read_id, r.seq[i : i + 3], None if "N" in r.seq[i : i + 3] else int("".join(str("ACGT".index(c)) for c in r.seq[i : i + 3]), 4)) for r in bases.collect() for i in range(len(r.seq or "") - 2)]
    for most in (1, 4, 1 << 19):
        assert sorted(map(repr, map(tuple, seq.ranked_kmers(bases, 3, most=most).collect()))) == sorted(map(repr, want))
