import gzip

import pytest
from pyspark.sql import functions as F

from sigspark.sources import readers, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def texts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*"))).splitlines()


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">r1 x y.fast5\nACGT\nAC\n>r2\nGG\n>r1 again\nTT\n")
    got = {r.read_id: (r.seq, r.signal_path) for r in readers.fasta(spark, p).collect()}
    assert got == {"r1": ("ACGTAC", "y.fast5"), "r2": ("GG", None)}
    out = tmp_path / "out"
    writers.fasta(spark.createDataFrame([("c", "ACG")], ["contig", "seq"]), str(out))
    assert texts(out) == [">c", "ACG"]


def test_fastq(spark, tmp_path):
    p = put(tmp_path / "a.fq", "@r1 c\nACGT\n+\n@@@@\n@r2\nGG\n+\nII\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r3\nTT\n+\nII\n@r1\nAA\n+\nII\n")
    got = {r.read_id: r.seq for r in readers.fastq(spark, p, str(tmp_path / "b.fq.gz")).collect()}
    assert got == {"r1": "ACGT", "r2": "GG", "r3": "TT"}


def test_index_and_summary(spark, tmp_path):
    p = put(tmp_path / "i", "r1\t/a/x.fast5\nr2\t/a/y.blow5\n")
    assert [r.is_slow5 for r in readers.read_index(spark, p).orderBy("read_id").collect()] == [False, True]
    s = put(tmp_path / "s", "filename_fast5\tread_id\tz\nx.fast5\tr1\t1\n")
    assert readers.sequencing_summary(spark, s).collect()[0].asDict() == {"filename": "x.fast5", "read_id": "r1"}
    with pytest.raises(ValueError):
        readers.sequencing_summary(spark, p)
    assert readers.listed(spark, put(tmp_path / "l", "a\n\nb\n")) == ["a", "b"]


def test_vcf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", 9, "A", "C", 12.34, {"TotalReads": "7"}, "0/1"), ("c1", 3, "AT", "A", 5.0, {}, "1/1")], "contig string, pos long, ref string, alt string, qual double, info map<string,string>, gt string")
    writers.vcf(df, str(tmp_path / "v"), "c1:0-100")
    got = readers.variants(spark, str(tmp_path / "v")).orderBy("pos").collect()
    assert [(r.contig, r.pos, r.ref, r.alt, r.qual, r.gt) for r in got] == [("c1", 3, "AT", "A", 5.0, "1/1"), ("c1", 9, "A", "C", 12.3, "0/1")] and got[1].info == {"TotalReads": "7"}
    w = readers.variant_window(spark, str(tmp_path / "v")).first()
    assert (w.contig, w.start_pos, w.end_pos) == ("c1", 0, 100)


def test_sam(spark, tmp_path):
    p = put(tmp_path / "a.sam", "@HD\tVN:1\nr1\t16\tc\t5\t60\t3M\t*\t0\t0\tACG\t*\tNM:i:1\tRG:Z:g1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = readers.alignments(spark, p).collect()
    assert (got[0].pos, got[0].flag, got[0].tags) == (4, 16, {"NM": "1", "RG": "g1"}) and got[1].tags == {}


def test_model(spark, tmp_path):
    rows = "".join(f"{k}\t{i}.5\t1.0\t0.5\t0.1\n" for i, k in enumerate("ACGT"))
    df, head = readers.kmer_model(spark, put(tmp_path / "m", "#kit\tx1\n#strand\ttemplate\nkmer\tlevel_mean\tlevel_stdv\tsd_mean\tsd_stdv\n" + rows))
    assert head == {"kit": "x1", "strand": "template"} and df.count() == 4
    writers.model(df, str(tmp_path / "o"), head)
    again, _ = readers.kmer_model(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        readers.kmer_model(spark, put(tmp_path / "bad", "A\t1\t1\t1\t1\n"))


def test_calls_frequency_bisulfite_slow5(spark, tmp_path):
    from sigspark.operators import methylation

    p = put(tmp_path / "c.tsv", "chromosome\tstart\tend\tread_name\tlog_lik_ratio\tlog_lik_methylated\tlog_lik_unmethylated\tnum_calling_strands\tnum_cpgs\tsequence\nc\t5\t5\tr1\t3.0\t-1\t-4\t1\t1\tAACGA\nc\t5\t5\tr2\t-1.0\t-1\t0\t1\t1\tAACGA\nc\t9\t12\tr1\t-6\t-1\t5\t1\t2\tAACGACGA\n")
    calls = readers.calls(spark, p)
    f = methylation.frequency(calls)
    writers.frequency(f, str(tmp_path / "f"))
    assert texts(tmp_path / "f") == ["\t".join(writers.FREQUENCY), "c\t5\t5\t1\t1\t1\t1.000\t.", "c\t9\t12\t2\t2\t0\t0.000\t."]
    again = readers.frequencies(spark, str(tmp_path / "f"))
    assert again.count() == 2
    split = methylation.frequency(methylation.split_groups(calls)).orderBy("start_pos").collect()
    assert [(r.start_pos, r.called_sites) for r in split] == [(5, 1), (9, 1), (12, 1)]
    b = readers.bisulfite(spark, put(tmp_path / "b", "c 5 6 x 0 + 5 6 0 10 50\nc 6 7 x 0 - 6 7 0 5 99\n"))
    assert methylation.bisulfite(b).collect()[0].asDict() == {"key": "c:5-5", "depth": 15, "methylated": 9}
    s = readers.slow5(spark, put(tmp_path / "s.slow5", "#slow5_version\t0.2\n@x\ty\nr1\t0\t8192\t10\t1400\t4000\t2\t100,200\n")).first()
    assert s.samples == [110 * (1400 / 8192), 210 * (1400 / 8192)]


def test_parts_are_headed(spark, tmp_path):
    df = spark.createDataFrame([(str(i),) for i in range(9)], ["value"]).repartition(3)
    writers.headed(df, ["h"], str(tmp_path / "o"))
    assert sorted(x for x in texts(tmp_path / "o") if x != "h") == [str(i) for i in range(9)]


def test_index_files(spark):
    from sigspark.operators import reads

    files = spark.createDataFrame([("/d/x.fast5",), ("/d/y.fast5",)], ["path"])
    summary = spark.createDataFrame([("x.fast5", "r1"), ("x.fast5", "r9")], ["filename", "read_id"])
    groups = spark.createDataFrame([("/d/y.fast5", "r2"), ("/d/x.fast5", "r3")], ["path", "read_id"])
    known = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], ["read_id"])
    index = reads.index_files(files, summary, known, groups)
    assert {(r.read_id, r.path) for r in index.collect()} == {("r1", "/d/x.fast5"), ("r2", "/d/y.fast5")}
    assert reads.located(known, index).first().asDict() == {"reads": 4, "found": 2, "files": 2, "share": 0.5}
