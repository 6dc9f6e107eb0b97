"""Queries of the grouped functions and iterative drivers. SQL can't express them; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _COUNTS, _FREQ, _strand_counts, query
from .functions import stats
from .operators import hmm, islands, signal
from .plans import calling, consensus, polya, training


def _work(v) -> DataFrame:
    """Each read's events, in order, against the states of the k-mers that they name."""
    e = signal.with_model(v("v_events"), v("v_model"))
    struct = F.struct("event_idx", (F.col("mean") / 5).alias("mean"), "level_mean", "level_stdv")
    rows = e.groupBy("read_id").agg(F.array_sort(F.collect_list(struct)).alias("x"))
    return rows.select("read_id", F.transform("x", lambda x: x["mean"]).alias("means"), F.transform("x", lambda x: x["level_mean"]).alias("level_mean"), F.transform("x", lambda x: x["level_stdv"] * 20).alias("level_stdv"), F.lit(1.5).alias("events_per_base"))


@query()
def hmm_forward(v, spark, sf_dir):
    return hmm.score_reads(_work(v))


@query()
def hmm_viterbi(v, spark, sf_dir):
    return hmm.align_reads(_work(v))


@query()
def banded_align(v, spark, sf_dir):
    return hmm.align_banded(_work(v), min_emission=-20.0)


@query()
def segment_signal(v, spark, sf_dir):
    return hmm.segment_reads(v("v_signal").select("read_id", F.transform("samples", lambda x: x / F.lit(100.0)).alias("samples")))


@query()
def polya_report(v, spark, sf_dir):
    scaled = v("v_signal").select("read_id", F.transform("samples", lambda x: x / F.lit(100.0)).alias("samples"))
    return polya.report(scaled, signal.read_rate(v("v_events")), sample_rate=4000.0)


@query()
def em_mixture(v, spark, sf_dir):
    e = signal.with_model(v("v_events"), v("v_model"))
    return training.mixtures(e.select("kmer", F.col("mean").alias("x"), (1 + (F.col("event_idx") % 5) / 10).alias("read_var"), "level_mean", "level_stdv"), least=10)


_HYPER = "lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0) - lgamma(a + b + c + d + 1.0)"
_TABLE = "lgamma(x + 1.0) + lgamma(a + b - x + 1.0) + lgamma(a + c - x + 1.0) + lgamma(d - a + x + 1.0)"


@query(f"""--with n as ({_COUNTS}), t as (select site, a, {_HYPER} as m, {_HYPER} - ({_TABLE.replace("x", "a")}) as own, b, c, d from n),
x as (select site, own, m, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from t), p as (select site, own, m - ({_TABLE}) as lp from x)
select site, round(least(1000.0, -10 * log10(least(1.0, sum(case when lp <= own + 1e-7 then exp(lp) else 0 end)))) + 0.0, 5) as fisher from p group by site""", "v_calls")
def fisher_strand(v, spark, sf_dir):
    return _strand_counts(v).select("site", F.round(stats.fisher_phred(*map(F.col, "abcd")), 5).alias("fisher"))


@query()
def consensus_fixpoint(v, spark, sf_dir):
    return consensus.polish(v("v_ref"), consensus.votes_from_reads(v("v_seq"), v("v_ref")))


@query(_FREQ.format("v_calls"), "v_calls")
def watch_stream(v, spark, sf_dir):
    from .streaming.watch import batch_equivalent

    return batch_equivalent(spark, sf_dir)


def _modified_model(v) -> DataFrame:
    """The model over ACGMT: a modified base lifts its k-mer's level by 6."""
    k = 3
    bases = F.explode(F.array(*map(F.lit, "ACGMT")))
    out = v("v_model").sparkSession.range(1).select(F.lit("").alias("m"))
    for _ in range(k):
        out = out.select("m", bases.alias("b")).select(F.concat("m", "b").alias("m"))
    plain = out.withColumn("kmer", F.translate("m", "M", "C")).join(v("v_model").drop("rank"), "kmer")
    return plain.select(F.col("m").alias("kmer"), (F.col("level_mean") + 6.0 * (F.length("m") - F.length(F.replace("m", F.lit("M"))))).alias("level_mean"), (F.col("level_stdv") * 10).alias("level_stdv"))


def _placed(v) -> DataFrame:
    """Events with a contig: read i lies on contig i mod their number."""
    n = v("v_ref").select(F.count("*").alias("n"))
    return v("v_events").join(F.broadcast(n)).select("read_id", (F.col("read_id") % F.col("n")).alias("contig"), "event_idx", (F.col("mean") / 5 + 60).alias("mean"), "ref_pos")


@query()
def site_scores(v, spark, sf_dir):
    return calling.score_sites(_placed(v), v("v_ref"), _modified_model(v))


@query()
def haplotype_scores(v, spark, sf_dir):
    """Every contig as it is, and with its base 20 changed, against its reads."""
    e = _placed(v).groupBy(F.col("contig").alias("group_id"), "read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "mean"))), lambda x: x["mean"]).alias("means"))
    hap = v("v_ref").select(F.col("contig").alias("group_id"), F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("h"), F.concat(F.substring("seq", 1, 20), F.translate(F.substring("seq", 21, 1), "ACGT", "CGTA"), F.expr("substring(seq, 22)")).alias("s")))).alias("x"))
    hap = hap.select("group_id", F.col("x.h").cast("long").alias("haplotype_id"), F.col("x.s").alias("seq"))
    return calling.score_haplotypes(e, hap, _modified_model(v), 3)


def _density(n: str) -> str:
    a = f"(2.461964 * {n})"
    return f"{a} * ln(2.0) - lgamma({a}) + ({a} - 1) * ln(duration) - 2.0 * duration"


@query(f"""--with r as (select contig, regexp_extract_all(seq, 'A+|C+|G+|T+') as runs from v_ref), e as (select contig, unnest(range(1, len(runs) + 1)) as i, unnest(runs) as run from r),
s as (select contig, i, cast(len(run) as bigint) as length, cast(coalesce(sum(len(run)) over (partition by contig order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos from e),
h as (select contig, start_pos, length, cast(length as double) * 1.3 + start_pos % 7 as duration from s where length between 3 and 9),
t as (select contig, start_pos, length, duration, n, {_density("n")} as score from h, (select unnest(range(3, 10)) as n)),
g as (select contig, start_pos, length, n, sum(score) as score from t group by all),
b as (select contig, start_pos, length, arg_max(n, score) as called, max(score) as top, max(score) filter (n = length) as own from g group by all)
select contig, start_pos, length, case when top - own >= 10 then called else length end as called from b""", "v_ref")
def homopolymer_lengths(v, spark, sf_dir):
    runs = islands.homopolymers(v("v_ref")).withColumn("duration", F.col("length") * 1.3 + F.col("start_pos") % 7)
    return calling.homopolymer_lengths(runs, F.lit(2.0))


@query()
def trained_model(v, spark, sf_dir):
    e = signal.with_model(v("v_events"), v("v_model")).select("kmer", F.col("mean").alias("x"), (1 + (F.col("event_idx") % 5) / 10).alias("read_var"))
    return training.rounds(e, v("v_model"), n=2, least=10)


@query()
def tail_classes(v, spark, sf_dir):
    return polya.tail_classes(v("v_signal").select("read_id", F.transform("samples", lambda x: x / F.lit(100.0)).alias("samples")))


@query()
def event_alignment(v, spark, sf_dir):
    """Anchors are every tenth event on its own k-mer: the fixture names a k-mer for each event."""
    w = _work(v)
    n = F.size("means")
    anchors = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i % 10 == 0) | (i == n - 1)), lambda i: F.struct(i.alias("kmer"), i.alias("event")))
    return hmm.align_to_reference(w.withColumn("anchors", anchors), stride=25, emit=12)
