"""All queries of the engine over the provided tables and, where DuckDB can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import sql, view
from .functions import sequence as seq
from .functions import stats
from .operators import alignment, events, haplotype, islands, methylation, rangejoin, reads, signal

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None, *views: str):
    """Registers a function of (v, spark, sf_dir), where v(name) is a view, and its SQL over these views."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name), spark, sf_dir)
        if text:
            _SQL[f.__name__] = sql(text, *views) if views else text
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_calls, catalog_dp  # noqa: F401  register their queries

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL


# ---- modified sites ----

_FREQ = """select chromosome, start_pos, end_pos, count(*) as num_reads, cast(min(num_motifs) as int) as num_motifs_in_group,
 cast(sum(num_motifs) as bigint) as called_sites, cast(sum(case when llr > 0 then num_motifs else 0 end) as bigint) as called_sites_methylated,
 sum(case when llr > 0 then num_motifs else 0 end)::double / sum(num_motifs) as methylated_frequency
 from {0} where abs(llr) >= 2.0 * num_motifs group by all"""


@query(_FREQ.format("v_calls"), "v_calls")
def meth_frequency(v, spark, sf_dir):
    return methylation.frequency(v("v_calls"))


@query("--with x as (select c.read_id, chromosome, start_pos, num_motifs, llr, seq as sequence from v_calls c join v_seq s on s.read_id = c.read_id), y as (select *, list_filter(range(0, cast(len(sequence) as bigint)), lambda i: substr(sequence, i + 1, 2) = 'CG') as ats from x where num_motifs > 1), z as (select chromosome, start_pos + unnest(ats) - ats[1] as start_pos, 1 as num_motifs, llr from y), a as (select chromosome, start_pos, start_pos as end_pos, num_motifs, llr from z union all select chromosome, start_pos, start_pos as end_pos, num_motifs, llr from x where num_motifs <= 1) " + _FREQ.format("a"), "v_calls", "v_seq")
def meth_frequency_split(v, spark, sf_dir):
    calls = v("v_calls").withColumn("end_pos", F.col("start_pos"))
    return methylation.frequency(methylation.split_by_places(calls, methylation.motif_places(v("v_seq"), "CG")))


@query("""--with a as (select chromosome || ':' || start_pos || '-' || start_pos as key, cast(sum(num_motifs) as bigint) as depth, cast(sum(case when llr > 0 then num_motifs else 0 end) as bigint) as methylated from v_calls where abs(llr) >= 2.0 * num_motifs and num_motifs = 1 group by all),
b as (select l_returnflag || l_linestatus || ':' || p || '-' || p as key, cast(sum(cast(floor(l_quantity) as bigint)) as bigint) as depth, cast(sum(cast(floor(cast(floor(l_discount * 1000) as double) / 100 * floor(l_quantity)) as bigint)) as bigint) as methylated
 from (select *, case when l_linenumber % 2 = 0 then l_partkey else l_partkey - 1 end as p from lineitem) group by all)
select key, a.depth as depth_1, a.methylated::double / a.depth as frequency_1, b.depth as depth_2, b.methylated::double / b.depth as frequency_2 from a join b using (key) where a.depth > 0 and b.depth > 0""", "v_calls")
def meth_compare(v, spark, sf_dir):
    first = methylation.frequency(v("v_calls").filter("num_motifs = 1"))
    start = F.col("start_pos").cast("string")
    first = first.select(F.concat("chromosome", F.lit(":"), start, F.lit("-"), start).alias("key"), F.col("called_sites").alias("depth"), F.col("called_sites_methylated").alias("methylated"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("chromosome"), F.col("l_partkey").alias("start_pos"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), F.floor("l_quantity").alias("reads"), F.floor(F.col("l_discount") * 1000).cast("double").alias("percent"))
    return methylation.compare(first, methylation.bisulfite(rows))


_MOTIF = "m as (select read_id, unnest(list_filter(range(0, cast(len(seq) as bigint)), lambda i: substr(seq, i + 1, 2) = 'CG')) as pos from v_seq)"
_GROUP = ", f as (select *, case when pos - lag(pos) over (partition by read_id order by pos) <= 10 then 0 else 1 end as far from m), n as (select *, sum(far) over (partition by read_id order by pos) as group_id from f), g as (select read_id, cast(group_id as bigint) as group_id, min(pos) as start_pos, max(pos) as end_pos, count(*) as num_motifs from n group by read_id, group_id)"


@query("--with " + _MOTIF + " select * from m", "v_seq")
def motif_scan(v, spark, sf_dir):
    return methylation.motif_scan(v("v_seq"), "CG")


@query("--with " + _MOTIF + _GROUP + " select * from g", "v_seq")
def motif_groups(v, spark, sf_dir):
    return methylation.scanned_groups(v("v_seq"), "CG")


@query("--with " + _MOTIF + _GROUP + " select * from g where start_pos - 10 > 10 and end_pos - start_pos <= 200", "v_seq")
def scoreable_groups(v, spark, sf_dir):
    return methylation.scoreable_groups(methylation.scanned_groups(v("v_seq"), "CG"))


_CONTEXT = ", x as (select g.read_id, start_pos, end_pos, num_motifs, substr(seq, greatest(start_pos - 5, 0) + 1, end_pos + 7 - greatest(start_pos - 5, 0)) as sequence from g join v_seq s on s.read_id = g.read_id)"


@query("--with " + _MOTIF + _GROUP + _CONTEXT + " select * from x", "v_seq")
def site_output_context(v, spark, sf_dir):
    return methylation.scanned_groups(v("v_seq"), "CG", flank=5)


@query("--with " + _MOTIF + _GROUP + _CONTEXT + ", y as (select *, list_filter(range(0, cast(len(sequence) as bigint)), lambda i: substr(sequence, i + 1, 2) = 'CG') as ats from x), z as (select read_id, start_pos, ats[1] as f, unnest(ats) as p from y) select read_id, start_pos, start_pos + p - f as pos from z", "v_seq")
def site_positions(v, spark, sf_dir):
    return methylation.expand_sites(methylation.scanned_groups(v("v_seq"), "CG", flank=5))


@query("--with " + _MOTIF + ", c as (select m.read_id, pos, len(replace(replace(replace(substr(seq, 1, pos), 'A', ''), 'G', ''), 'T', '')) as n from m join v_seq s on s.read_id = m.read_id), d as (select *, n - coalesce(lag(n) over (partition by read_id order by pos) + 1, 0) as delta from c) select read_id, string_agg(cast(delta as varchar), ',' order by pos) as mm from d group by read_id", "v_seq")
def mm_tag(v, spark, sf_dir):
    return v("v_seq").select("read_id", methylation.mm_tag(F.col("seq")).alias("mm")).filter("mm is not null")


@query("select read_id, chromosome, start_pos, llr, cast(least(255, floor(255 * (1 / (1 + exp(0.0 - llr))))) as int) as ml from v_calls", "v_calls")
def ml_probability(v, spark, sf_dir):
    return v("v_calls").select("read_id", "chromosome", "start_pos", "llr", methylation.ml_value(F.col("llr")).alias("ml"))


# ---- islands and tiles ----


@query("""--with f as (select *, case when pos - lag(pos) over w <= 10 then 0 else 1 end as far from v_var window w as (partition by contig order by pos, ref, alt)),
n as (select *, sum(far) over (partition by contig order by pos, ref, alt rows unbounded preceding) as group_id from f)
select contig, cast(group_id as bigint) as group_id, min(pos) as start_pos, max(pos) as end_pos, count(*) as n from n group by contig, group_id having max(pos) - min(pos) <= 200""", "v_var")
def variant_groups(v, spark, sf_dir):
    return islands.variant_groups(v("v_var"), bin_size=256)


@query("""--with r as (select contig, regexp_extract_all(seq, 'A+|C+|G+|T+') as runs from v_ref),
e as (select contig, unnest(range(1, len(runs) + 1)) as i, unnest(runs) as run from r),
s as (select contig, i, run, cast(coalesce(sum(len(run)) over (partition by contig order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos from e)
select contig, start_pos, run[1] as base, len(run) as length from s where len(run) between 3 and 9""", "v_ref")
def homopolymers(v, spark, sf_dir):
    return islands.homopolymers(v("v_ref"))


@query("""--with d as (select read_id, event_idx, ref_pos - lag(ref_pos) over (partition by read_id order by event_idx) as m from v_events),
l as (select read_id, event_idx, case when m is null or m = 1 then 'M' when m = 0 then 'I' else 'D' end as label from d),
f as (select *, case when label = lag(label) over (partition by read_id order by event_idx) then 0 else 1 end as new from l),
r as (select *, sum(new) over (partition by read_id order by event_idx) as run from f), g as (select read_id, run, count(*) as n, any_value(label) as label from r group by read_id, run)
select read_id, string_agg(n || label, '' order by run) as cigar from g group by read_id""", "v_events")
def event_cigar_rle(v, spark, sf_dir):
    move = F.col("ref_pos") - F.lag("ref_pos").over(signal.ordered())
    e = v("v_events").withColumn("move", move)
    return islands.run_lengths(e, ["read_id"], ["event_idx"], F.when(F.col("move").isNull() | (F.col("move") == 1), "M").when(F.col("move") == 0, "I").otherwise("D"))


_TILES = """l as (select contig, cast(len(seq) as bigint) * 100 as length from v_ref), k as (select contig, length, greatest(cast(ceil((length - 500 - 100 + 1) / 500.0) as bigint), 0) as last from l where length > 0),
t as (select contig, length, last, unnest(range(0, last + 1)) as i from k), w as (select contig, i * 500 as start_pos, case when i = last then length - 1 else (i + 1) * 500 + 20 end as end_pos from t)"""


@query("--with " + _TILES + " select * from w", "v_ref")
def genome_tiles(v, spark, sf_dir):
    lengths = v("v_ref").select("contig", (F.length("seq").cast("long") * 100).alias("length"))
    return islands.tiles(lengths, size=500, overlap=20)


@query("--with " + _TILES + ", g as (select *, start_pos > lag(end_pos) over (partition by contig order by start_pos, end_pos) as gap from w), a as (select contig, min(start_pos) as f, max(end_pos) as e, cast(sum(case when gap then 1 else 0 end) as bigint) as gaps from g group by contig) select a.contig, gaps, f = 0 and gaps = 0 and length - e <= 500 as covered from a join l using (contig)", "v_ref")
def tile_coverage_check(v, spark, sf_dir):
    lengths = v("v_ref").select("contig", (F.length("seq").cast("long") * 100).alias("length"))
    return islands.coverage(islands.tiles(lengths, size=500, overlap=20), lengths)


# ---- events and signal ----


@query("select read_id, cast(count(*) as bigint) as num_events, cast(count(*) filter (m = 0) as bigint) as num_stays, cast(count(*) filter (m = 1) as bigint) as num_steps, cast(count(*) filter (m > 1) as bigint) as num_skips, cast(coalesce(sum(dur_us), 0) as bigint) as total_duration, max(ref_pos) - min(ref_pos) + 1 as ref_span from (select *, ref_pos - lag(ref_pos) over (partition by read_id order by event_idx) as m from v_events) group by read_id", "v_events")
def event_moves(v, spark, sf_dir):
    return signal.moves(v("v_events"))


@query("select read_id, event_idx, cast(coalesce(sum(dur_us) over (partition by read_id order by event_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start_time from v_events", "v_events")
def event_start_time(v, spark, sf_dir):
    return signal.start_times(v("v_events")).select("read_id", "event_idx", "start_time")


@query("select read_id, event_idx, (mean - start_us / 1e6 * 0.5 - 10.0) / 1.2 as level from v_events", "v_events")
def event_scaled_level(v, spark, sf_dir):
    level = signal.scaled_level(F.col("mean"), F.col("start_us") / F.lit(1e6), F.lit(10.0), F.lit(1.2), F.lit(0.5))
    return v("v_events").select("read_id", "event_idx", level.alias("level"))


@query("select read_id, event_idx, round(-ln(sqrt(2 * pi())) - ln(s) - (mean - m) * (mean - m) / (s * s) / 2, 5) as log_prob from (select read_id, event_idx, mean, level_mean * 1.2 + 10.0 as m, level_stdv * 1.3 as s from v_events join v_model on rank = kmer_rank)", "v_events", "v_model")
def event_log_prob(v, spark, sf_dir):
    m, s = signal.model_for_read(F.col("level_mean"), F.col("level_stdv"), F.lit(10.0), F.lit(1.2), F.lit(1.3))
    return signal.with_model(v("v_events"), v("v_model")).select("read_id", "event_idx", F.round(signal.match_log_prob(F.col("mean"), m, s), 5).alias("log_prob"))


@query("select read_id, count(*) as n, round(sum((mean - level_mean) / (sqrt(1.3) * level_stdv)), 5) as sum_z from v_events join v_model on rank = kmer_rank group by read_id", "v_events", "v_model")
def event_zscore_summary(v, spark, sf_dir):
    z = signal.standardised(F.col("mean"), F.col("level_mean"), F.col("level_stdv"), F.lit(1.3))
    return signal.with_model(v("v_events"), v("v_model")).groupBy("read_id").agg(F.count("*").alias("n"), F.round(F.sum(z), 5).alias("sum_z"))


@query("--with r as (select *, cast(floor((row_number() over (partition by read_id order by event_idx) - 1) / 10) as bigint) as segment from v_events) select read_id, segment, round(sum(mean), 4) as total from r where segment > 0 group by read_id, segment having count(*) = 10", "v_events")
def segment_windows(v, spark, sf_dir):
    return signal.count_windows(v("v_events"), "mean", 10).withColumn("total", F.round("total", 4))


@query("--with e as (select read_id, avg(mean) as em, avg(mean * mean) as e2 from v_events group by read_id), m as (select read_id, avg(level_mean) as km, avg(level_mean * level_mean) as k2 from v_events join v_model on rank = kmer_rank group by read_id) select read_id, round(em - sqrt((e2 - em * em) / (k2 - km * km)) * km, 5) as shift, round(sqrt((e2 - em * em) / (k2 - km * km)), 5) as scale from e join m using (read_id) where k2 - km * km > 0", "v_events", "v_model")
def scalings_mom(v, spark, sf_dir):
    e = v("v_events")
    out = signal.scalings_by_moments(e, signal.with_model(e, v("v_model")).select("read_id", "level_mean"))
    return out.select("read_id", F.round("shift", 5).alias("shift"), F.round("scale", 5).alias("scale"))


_SUMS = "s as (select read_id, count(*) as n, sum(w) as w, sum(w*x) as wx, sum(w*x*x) as wxx, sum(w*y) as wy, sum(w*x*y) as wxy, sum(w*y*y) as wyy, sum(w*t) as wt, sum(w*t*t) as wtt, sum(w*x*t) as wxt, sum(w*y*t) as wyt from (select read_id, 1/(level_stdv*level_stdv) as w, level_mean as x, mean as y, start_us / 1e9 as t from v_events join v_model on rank = kmer_rank) group by read_id having count(*) >= 20)"
_FIT = ", f as (select *, {0} as shift, {1} as scale, {2} as drift from s) select read_id, n, round(shift, 4) as shift, round(scale, 5) as scale, round(drift, 3) as drift, round(sqrt(greatest(wyy - shift*wy - scale*wxy - drift*wyt, 0) / n), 5) as var from f"


def _fit(v, drift):
    e = signal.with_model(v("v_events"), v("v_model")).withColumn("t", F.col("start_us") / F.lit(1e9))
    out = signal.calibrate(e, drift, least=20)
    return out.select("read_id", "n", F.round("shift", 4).alias("shift"), F.round("scale", 5).alias("scale"), F.round("drift", 3).alias("drift"), F.round("var", 5).alias("var"))


@query("--with " + _SUMS + _FIT.format("(wy*wxx - wx*wxy)/(w*wxx - wx*wx)", "(w*wxy - wx*wy)/(w*wxx - wx*wx)", "0.0::double"), "v_events", "v_model")
def calibrate_wls2(v, spark, sf_dir):
    return _fit(v, False)


def _det3(a):
    return f"({a[0][0]}*({a[1][1]}*{a[2][2]}-{a[1][2]}*{a[2][1]})-{a[0][1]}*({a[1][0]}*{a[2][2]}-{a[1][2]}*{a[2][0]})+{a[0][2]}*({a[1][0]}*{a[2][1]}-{a[1][1]}*{a[2][0]}))"


_M = [["w", "wx", "wt"], ["wx", "wxx", "wxt"], ["wt", "wxt", "wtt"]]
_CRAMER = [_det3([[("wy", "wxy", "wyt")[i] if j == k else _M[i][j] for j in range(3)] for i in range(3)]) + "/" + _det3(_M) for k in range(3)]


@query("--with " + _SUMS + _FIT.format(*_CRAMER), "v_events", "v_model")
def calibrate_wls3(v, spark, sf_dir):
    return _fit(v, True)


@query("select read_id, list_sort(list(dur_us))[count(*) // 2 + 1] as median, 1.0 / nullif(list_sort(list(dur_us))[count(*) // 2 + 1], 0) as rate from v_events where dur_us is not null group by read_id", "v_events")
def read_rate_median(v, spark, sf_dir):
    return signal.read_rate(v("v_events"))


@query("--with x as (select read_id, event_idx, dur_us, ref_pos, row_number() over (partition by read_id order by event_idx) * 37.0 as a, row_number() over (partition by read_id order by event_idx) * 61.0 as b from v_events) select read_id, event_idx, round(greatest((b - (a + 1)) / 4000.0 * 30.0 - 5, 0), 7) as tail, case when a < 200 or b - a < 200 then 'NOREGION' when ref_pos * 8 > 300 then 'ADAPTER' else 'PASS' end as tag from x", "v_events")
def polya_length(v, spark, sf_dir):
    n = F.row_number().over(signal.ordered())
    e = v("v_events").withColumn("a", n * F.lit(37.0)).withColumn("b", n * F.lit(61.0))
    tail = signal.tail_length(F.col("a"), F.col("b"), F.lit(4000.0), F.lit(30.0))
    return e.select("read_id", "event_idx", F.round(tail, 7).alias("tail"), signal.tail_tag(F.col("a"), F.col("b") - F.col("a"), F.col("ref_pos") * 8).alias("tag"))


@query("select read_id, list_transform(samples, lambda x: (x + 10.0) * (1400.0 / 8192.0)) as pa from v_signal", "v_signal")
def sample_to_pa(v, spark, sf_dir):
    return v("v_signal").select("read_id", signal.to_picoamperes(F.col("samples"), F.lit(10.0), F.lit(1400.0), F.lit(8192.0)).alias("pa"))


_SCALED = "x as (select read_id, list_transform(samples, lambda x: x / 100.0) as s from v_signal)"
_N = "exp(-ln(sqrt(2*pi())) - ln({1}) - pow((y - {0})/{1}, 2)/2)"
_EMIT = f"list_transform(list_transform(s, lambda x: case when x > 200 or x < 40 then 100.0 else x end), lambda y: {{{{'s': ln(0.5*{_N.format(70.2737, 3.7743)} + 0.5*0.00476), 'l': ln({_N.format(110.973, 5.237)}), 'a': ln(0.874*{_N.format(79.347, 8.3702)} + (1-0.874)*{_N.format(63.3126, 2.7464)}), 'p': ln({_N.format(108.883, 3.257)}), 'c': case when y > 70 and y < 140 then -4.2485 else -1e30 end, 't': ln(0.346*{_N.format(79.679, 6.966)} + (1-0.346)*{_N.format(105.784, 16.022)})}}}})".replace("{{", "{").replace("}}", "}")


@query("--with " + _SCALED + f""", e as (select read_id, {_EMIT} as e from x),
f as (select read_id, list_reduce(e[2:], lambda a, b: {{'s': a.s + ln(0.1) + b.s, 'l': greatest(a.s + ln(0.9), a.l + ln(0.9)) + b.l, 'a': greatest(a.l + ln(0.1), a.a + ln(0.95)) + b.a, 'p': greatest(a.a + ln(0.05), a.p + ln(0.89), a.c + ln(0.99)) + b.p, 'c': greatest(a.p + ln(0.01), a.c + ln(0.01)) + b.c, 't': greatest(a.p + ln(0.1), a.t) + b.t}}, {{'s': e[1].s, 'l': -1e30::double, 'a': -1e30::double, 'p': -1e30::double, 'c': -1e30::double, 't': -1e30::double}}) as r from e)
select read_id, round(r.t, 3) as score from f""", "v_signal")
def segmentation_score(v, spark, sf_dir):
    scaled = F.transform("samples", lambda x: x / F.lit(100.0))
    return v("v_signal").select("read_id", F.round(signal.segmentation_score(scaled), 3).alias("score"))


@query("--with " + _SCALED + """, m as (select read_id, list_transform(s, lambda x: x - list_avg(s) + 108.0) as s from x),
b as (select read_id, list_transform(list_transform(s, lambda x: case when x > 200 or x < 40 then 100.0 else x end), lambda y: case when (-ln(sqrt(2*pi())) - ln(5.257) - pow((y-108.498)/5.257, 2)/2) / (-ln(sqrt(2*pi())) - ln(3.257) - pow((y-108.883)/3.257, 2)/2) > 1 then 1 else 0 end) as b from m),
e as (select read_id, b, list_transform(b, lambda x: {'i': case when x = 1 then ln(0.72304) else ln(1-0.72304) end, 'a': case when x = 1 then ln(0.92154) else ln(1-0.92154) end}) as e from b),
f as (select read_id, b, list_reduce(e[2:], lambda p, q: {'i': p.i + ln(0.9) + q.i, 'a': greatest(p.i + ln(0.1), p.a) + q.a}, {'i': e[1].i, 'a': -1e30::double}) as r from e)
select read_id, cast(list_sum(b) as bigint) as ones, round(r.i, 5) as score_i, round(r.a, 5) as score_a from f""", "v_signal")
def bernoulli_switch(v, spark, sf_dir):
    bits = signal.polyi_bits(F.transform("samples", lambda x: x / F.lit(100.0)))
    df = v("v_signal").select("read_id", bits.alias("bits")).withColumn("r", signal.switch_score(F.col("bits")))
    return df.select("read_id", F.aggregate("bits", F.lit(0), lambda a, b: a + b).cast("long").alias("ones"), F.round("r.i", 5).alias("score_i"), F.round("r.a", 5).alias("score_a"))


@query("--with x as (select *, ref_pos - lag(ref_pos) over w as m, lag(level_mean) over w as l from v_events join v_model on rank = kmer_rank window w as (partition by read_id order by event_idx)) select cast(least(floor(abs(level_mean - l) / 0.5), 29) as int) as bin, count(*) as n, cast(sum(case when m > 1 then 1 else 0 end) as bigint) as skips from x where m >= 1 group by 1", "v_events", "v_model")
def skip_bins(v, spark, sf_dir):
    return signal.skip_counts(signal.with_model(v("v_events"), v("v_model")))


@query("select from_label, label as to_label, count(*) as n from (select *, lag(label) over (partition by read_id order by event_idx) as from_label from v_events) where from_label is not null group by all", "v_events")
def transition_counts(v, spark, sf_dir):
    return signal.transition_counts(v("v_events"))


@query("select substr(kmer, 1, len(kmer) - 1) as kmer, avg(level_mean) as level_mean, round(sqrt(avg(level_stdv*level_stdv) + avg(level_mean*level_mean) - avg(level_mean)*avg(level_mean)), 7) as level_stdv from v_model group by 1", "v_model")
def model_drop_k(v, spark, sf_dir):
    return signal.drop_k(v("v_model")).withColumn("level_stdv", F.round("level_stdv", 7))


# ---- sequences ----


@query("--with k as (select unnest(list_transform(range(1, cast(len(seq) as bigint) - 3), lambda i: substr(seq, i, 5))) as kmer from v_seq where len(seq) >= 5) select kmer, count(*) as n from k group by kmer", "v_seq")
def kmer_count(v, spark, sf_dir):
    return v("v_seq").select(F.explode(seq.kmers(F.col("seq"), 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("--with k as (select read_id, unnest(list_transform(range(1, cast(len(seq) as bigint) - 6), lambda i: substr(seq, i, 8))) as kmer from v_seq where len(seq) >= 8) select read_id, kmer, list_reduce(list_transform(string_split(kmer, ''), lambda b: cast(instr('ACGT', b) - 1 as bigint)), lambda a, b: a * 4 + b) as rank from k", "v_seq")
def kmer_rank(v, spark, sf_dir):
    return seq.ranked_kmers(v("v_seq"), 8)


@query("--with k as (select read_id, unnest(list_transform(range(1, cast(len(seq) as bigint) - 1), lambda i: substr(seq, i, 3))) as kmer from v_seq where len(seq) >= 3) select read_id, count(*) as n, sum(level_mean) as total from k join v_model using (kmer) group by read_id", "v_seq", "v_model")
def kmer_model_join(v, spark, sf_dir):
    kmers = v("v_seq").select("read_id", F.explode(seq.kmers(F.col("seq"), 3)).alias("kmer"))
    return kmers.join(v("v_model"), "kmer").groupBy("read_id").agg(F.count("*").alias("n"), F.sum("level_mean").alias("total"))


@query("select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) as seq from v_seq", "v_seq")
def revcomp(v, spark, sf_dir):
    return v("v_seq").select("read_id", seq.revcomp(F.col("seq")).alias("seq"))


def _methylated(name, expression):
    @query(f"select read_id, {expression} as seq from v_seq", "v_seq")
    def f(v, spark, sf_dir):
        return v("v_seq").select("read_id", seq.methylate(F.col("seq"), name).alias("seq"))

    _QUERIES[f"methylate_{name}"], _SQL[f"methylate_{name}"] = _QUERIES.pop("f"), _SQL.pop("f")


_methylated("cpg", "replace(seq, 'CG', 'MG')")
_methylated("gpc", "replace(seq, 'GC', 'GM')")
_methylated("dam", "replace(seq, 'GATC', 'GMTC')")
_methylated("dcm", r"regexp_replace(seq, 'CC([AT])GG', 'CM\1GG', 'g')")


@query("select doc_id as read_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'MRWSYKVHDBN', 'AAACCGAAACA') as seq from documents")
def disambiguate(v, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("read_id"), seq.disambiguate(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


# ---- alignments ----

@query("""--with c as (select row_number() over () as a, * from v_cigar),
o as (select a, read_id, line, pos, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as x, unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) + 1)) as i from c),
q as (select *, right(x, 1) as op, cast(left(x, len(x) - 1) as bigint) as n from o),
s as (select *, coalesce(sum(case when op in ('M','D') then n else 0 end) over w, 0) as r0, coalesce(sum(case when op in ('M','I','S') then n else 0 end) over w, 0) as q0 from q window w as (partition by a order by i rows between unbounded preceding and 1 preceding)),
e as (select *, unnest(range(0, n)) as j from s where op = 'M')
select read_id, line, 0 as segment, cast(pos + r0 + j as bigint) as ref_pos, cast(q0 + j as bigint) as read_pos from e""", "v_cigar")
def cigar_pairs(v, spark, sf_dir):
    return alignment.aligned_pairs(v("v_cigar"))


@query("--with d as (select contig, start_pos as pos, 1 as d from v_aln where end_pos > start_pos union all select contig, end_pos, -1 from v_aln where end_pos > start_pos), s as (select contig, pos, sum(d) as d from d group by all) select contig, pos, cast(sum(d) over (partition by contig order by pos) as bigint) as depth from s", "v_aln")
def pileup_depth(v, spark, sf_dir):
    return alignment.depth(v("v_aln"), ["contig"], bin_size=256)


@query("""--with n as (select count(*) as n from v_ref), p as (select s.read_id, s.read_id % n as contig, unnest(range(0, len(seq))) as i, seq from v_seq s, n),
j as (select r.contig, p.i as ref_pos, substr(r.seq, p.i + 1, 1) as ref, substr(p.seq, p.i + 1, 1) as alt from p join v_ref r on r.contig = p.contig where p.i < len(r.seq)),
c as (select contig, ref_pos, ref, alt, count(*) as n from j where ref <> '' group by all), t as (select *, cast(sum(n) over (partition by contig, ref_pos) as bigint) as depth from c)
select contig, ref_pos, ref, alt, n, depth, n::double / depth as share from t where ref <> alt and depth >= 20 and n::double / depth >= 0.2""", "v_seq", "v_ref")
def allele_pileup(v, spark, sf_dir):
    ref, reads_ = v("v_ref"), v("v_seq")
    # Fixture: read i lies on contig i mod the number of contigs, from its first base on; nothing beyond the contig is aligned.
    n = ref.select(F.count("*").alias("n"))
    lengths = ref.select("contig", F.length("seq").alias("size"))
    placed = reads_.join(F.broadcast(n)).withColumn("contig", F.col("read_id") % F.col("n")).join(lengths, "contig")
    zero = F.lit(0).cast("long")
    blocks = placed.select("read_id", "contig", zero.alias("ref_pos"), zero.alias("read_pos"), F.least(F.length("seq"), F.col("size")).cast("long").alias("n"))
    return alignment.alleles(blocks, reads_, ref)


@query("select a.read_id, a.contig, a.start_pos, a.end_pos, v.pos, v.ref, v.alt from v_aln a join v_var v on v.contig = a.contig and v.pos between a.start_pos and a.end_pos", "v_aln", "v_var")
def variants_in_reads(v, spark, sf_dir):
    return rangejoin.points_in_intervals(v("v_var"), v("v_aln"), ["contig"], "pos", "start_pos", "end_pos").select("read_id", "contig", "start_pos", "end_pos", "pos", "ref", "alt")


@query("""--with s as (select read_id, event_idx as k_idx, case when event_idx % 4 = 1 or kmer_rank < 8 then event_idx * 2 end as ev from v_events),
x as (select *, case when k_idx > min(k_idx) over (partition by read_id) then ev end as b, case when k_idx < max(k_idx) over (partition by read_id) then ev end as f from s)
select read_id, k_idx, ev, coalesce(ev, last_value(b ignore nulls) over (partition by read_id order by k_idx range between 999 preceding and current row), first_value(f ignore nulls) over (partition by read_id order by k_idx range between current row and 999 following)) as nearest from x""", "v_events")
def nearest_event(v, spark, sf_dir):
    slots = v("v_events").select("read_id", F.col("event_idx").alias("k_idx"), F.when((F.col("event_idx") % 4 == 1) | (F.col("kmer_rank") < 8), F.col("event_idx") * 2).alias("ev"))
    return rangejoin.nearest(slots, ["read_id"], "k_idx", "ev")


@query("""--with w as (select distinct read_id, ref_pos - 3 as s, ref_pos + 40 as e from v_events), p as (select read_id, ref_pos, min(event_idx) as v from v_events group by all)
select w.read_id, s as start_pos, e as end_pos, arg_min(v, ref_pos) filter (ref_pos >= s) as first_value, arg_min(v, ref_pos) filter (ref_pos >= e) as last_value,
 coalesce(count(*) filter (ref_pos >= s) > 0 and count(*) filter (ref_pos >= e) > 0 and min(ref_pos) <= s, false) as bounded from w join p on p.read_id = w.read_id group by w.read_id, w.s, w.e""", "v_events")
def lower_bound_lookup(v, spark, sf_dir):
    e = v("v_events")
    windows = e.select("read_id", (F.col("ref_pos") - 3).alias("start_pos"), (F.col("ref_pos") + 40).alias("end_pos")).distinct()
    return rangejoin.lower_bound(e, windows, ["read_id"], "ref_pos", "event_idx", "start_pos", "end_pos")


@query("select * from v_aln where mapq >= 20 and rg = 'O'", "v_aln")
def usable_alignments(v, spark, sf_dir):
    return alignment.usable(v("v_aln"), 20, "O")


# ---- reads and files ----


@query("select a.read_id, a.contig, a.start_pos, len(s.seq) as read_length, 'run' || a.read_id % 7 || '.fast5' as path from v_aln a join v_seq s on s.read_id = a.read_id", "v_aln", "v_seq")
def read_index_join(v, spark, sf_dir):
    s = v("v_seq")
    index = s.select("read_id", F.concat(F.lit("run"), (F.col("read_id") % 7).cast("string"), F.lit(".fast5")).alias("path"))
    return reads.join_reads(v("v_aln").select("read_id", "contig", "start_pos"), s, index).select("read_id", "contig", "start_pos", F.length("seq").cast("long").alias("read_length"), "path")


@query("select distinct a.read_id from v_aln a where not exists (select 1 from v_seq s where s.read_id = a.read_id)", "v_aln", "v_seq")
def unindexed_reads(v, spark, sf_dir):
    return reads.missing(v("v_aln"), v("v_seq"))


@query("--with c as (select l_suppkey as path, count(*) as n from lineitem group by 1), m as (select n, count(*) as k from c group by n order by k desc, n limit 1) select path, c.n from c, m where c.n > case when m.k > 2 then m.n else 4000 end".replace("--with", "with"))
def file_mode_outliers(v, spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("path"))
    return reads.crowded_files(files, least=2)


@query("select v.* from v_aln v where contig = 'A' and start_pos < 500 and end_pos >= 100 and exists (select 1 from v_seq s where s.read_id = v.read_id)", "v_aln", "v_seq")
def region_semi(v, spark, sf_dir):
    return reads.in_region(v("v_aln"), "A", 100, 500).join(v("v_seq"), "read_id", "left_semi").select(*v("v_aln").columns)


@query("select event_id, user_id from events where user_id % 5 = 2")
def shard_filter(v, spark, sf_dir):
    return reads.shard(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id"), 5, 2).select("event_id", "user_id")


@query("--with x as (select s.read_id, case when g.read_id is null then 'MISSING' when len(samples) = 0 then 'EMPTY' else 'OK' end as status from v_seq s left join v_signal g on g.read_id = s.read_id) select status, count(*) as n from x group by status", "v_seq", "v_signal")
def signal_check(v, spark, sf_dir):
    return reads.check_signal(v("v_seq").select("read_id"), v("v_signal")).groupBy("status").agg(F.count("*").alias("n"))


@query("select read_id, case when len(seq) <= 20 then 'TOO_SHORT' when samples is null then 'NO_SIGNAL' else 'PASS' end as qc from v_seq left join v_signal using (read_id)", "v_seq", "v_signal")
def read_qc(v, spark, sf_dir):
    j = v("v_seq").join(v("v_signal"), "read_id", "left")
    return j.select("read_id", reads.quality_tag(F.length("seq"), F.col("samples")).alias("qc"))


# ---- variants ----


@query("select distinct contig, pos, ref, alt from (select * from v_var union all select * from v_var)", "v_var")
def variant_dedup(v, spark, sf_dir):
    return haplotype.distinct(v("v_var").unionAll(v("v_var"))).select(*haplotype.KEY)


_A, _B = "(select distinct contig, pos, ref, alt from v_var where qual < 1500)", "(select distinct contig, pos, ref, alt from v_var where qual > 1200)"


@query(f"select *, 'lost' as side from ({_A} except {_B}) union all select *, 'new' as side from ({_B} except {_A})", "v_var")
def round_diff(v, spark, sf_dir):
    return haplotype.changed(v("v_var").filter("qual < 1500"), v("v_var").filter("qual > 1200"))


@query(f"{_A} union {_B}", "v_var")
def key_union(v, spark, sf_dir):
    return v("v_var").filter("qual < 1500").select(*haplotype.KEY).union(v("v_var").filter("qual > 1200").select(*haplotype.KEY)).distinct()


@query(f"{_A} intersect {_B}", "v_var")
def key_intersect(v, spark, sf_dir):
    return v("v_var").filter("qual < 1500").select(*haplotype.KEY).intersect(v("v_var").filter("qual > 1200").select(*haplotype.KEY))


@query("select * from v_var where gt <> '0/0'", "v_var")
def hom_ref_filter(v, spark, sf_dir):
    return v("v_var").filter("gt <> '0/0'")


@query("select contig || ':' || pos || ':' || ref || ':' || alt as key, qual from v_var where len(ref) = 1 and len(alt) = 1", "v_var")
def snp_filter(v, spark, sf_dir):
    return v("v_var").filter((F.length("ref") == 1) & (F.length("alt") == 1)).select(haplotype.key().alias("key"), "qual")


@query("""--with c as (select contig, seq, unnest(range(0, len(seq))) as i from v_ref), b as (select contig, i, substr(seq, i + 1, 1) as b, substr(seq, i + 2, 1) as n from c), x as (select unnest(['A','C','G','T']) as x)
select contig, i as pos, b as ref, x as alt from b, x where x <> b union all select contig, i, b, b || x from b, x where x <> b union all select contig, i, b || n, b from b where n <> '' and n <> b""", "v_ref")
def single_base_edits(v, spark, sf_dir):
    return haplotype.single_base_edits(v("v_ref"))


@query("""--with d as (select contig, pos, ref || 'A' as ref, alt from v_var where gt = '0/1' union all select contig, pos, ref, alt || 'C' as alt from v_var where gt = '1/1' union all select contig, pos, ref, alt from v_var where gt = '0/0')
select contig, pos, ref, alt || x as alt from d, (select unnest(['A','C','G','T']) as x) where len(alt) > len(ref) union all select contig, pos, ref || 'G', alt from d where len(alt) < len(ref)""", "v_var")
def expand_indels(v, spark, sf_dir):
    d = v("v_var").select("contig", "pos", F.when(F.col("gt") == "0/1", F.concat("ref", F.lit("A"))).otherwise(F.col("ref")).alias("ref"), F.when(F.col("gt") == "1/1", F.concat("alt", F.lit("C"))).otherwise(F.col("alt")).alias("alt"))
    return haplotype.expand_indels(d, F.lit("G"))


_ON_REF = "p as (select p_partkey % (select count(*) from v_ref) as contig, p_partkey % 97 as pos, ref, alt from (select p_partkey, substr('ACGT', cast(p_partkey % 4 as int)+1,1) as ref, substr('ACGT', cast((p_partkey+1+p_size % 3) % 4 as int)+1,1) as alt from part))"


def _on_ref(v, spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = v("v_ref").select(F.count("*").alias("n"))
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4).cast("int") + 1, F.lit(1))
    return p.join(F.broadcast(n)).select((F.col("p_partkey") % F.col("n")).alias("contig"), (F.col("p_partkey") % 97).alias("pos"), base(F.col("p_partkey")).alias("ref"), base(F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("alt"))


@query("--with " + _ON_REF + """, s as (select contig, pos, ref, min(alt) as alt from p group by all), b as (select contig, unnest(range(0, len(seq))) as i, unnest(string_split(seq, '')) as b from v_ref),
j as (select b.contig, i, coalesce(s.alt, b.b) as b, s.alt is not null as hit from b left join s on s.contig = b.contig and s.pos = b.i and s.ref = b.b)
select contig, string_agg(b, '' order by i) as seq, cast(count(*) filter (hit) as int) as n_applied from j group by contig""", "v_ref")
def apply_snps(v, spark, sf_dir):
    return haplotype.apply_substitutions(v("v_ref"), _on_ref(v, spark, sf_dir))


@query("--with " + _ON_REF + " select p.contig, pos, ref, alt, substr(seq, greatest(pos - 5, 0) + 1, least(pos + 6, len(seq)) - greatest(pos - 5, 0)) as context from p join v_ref r on r.contig = p.contig where pos < len(seq)", "v_ref")
def ref_context(v, spark, sf_dir):
    return haplotype.context(_on_ref(v, spark, sf_dir), v("v_ref"))


@query("--with n as (select unnest(range(1, 9)) as n), r as (select n, unnest(range(0, n + 1)) as r from n), m as (select n, r, unnest(range(0, cast(1 << n as bigint))) as m from r) select cast(n as int) as n, cast(r as int) as r, list_filter(range(0, n), lambda i: (m >> i) % 2 = 1)::int[] as items from m where bit_count(m) = r".replace("--with", "with"))
def combos_wo(v, spark, sf_dir):
    n = spark.range(1, 9).select(F.col("id").cast("int").alias("n"))
    return haplotype.subsets(n.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("r")), "n", "r")


@query("with n as (select unnest(range(1, 6)) as n), a as (select n, unnest(range(0, n)) as x from n) select cast(a.n as int) as n, [a.x, b.x]::int[] as items from a join a b on a.n = b.n and b.x >= a.x")
def combos_with(v, spark, sf_dir):
    return haplotype.multisets(spark.range(1, 6).select(F.col("id").cast("int").alias("n")), "n", 2)


_LOGSUM = "m as (select read_id, max(llr) as m from v_calls group by 1)"


@query("--with " + _LOGSUM + " select c.read_id, round(max(m) + ln(sum(exp(llr - m))), 7) as logsum from v_calls c join m using (read_id) group by c.read_id", "v_calls")
def haplotype_logsum(v, spark, sf_dir):
    return haplotype.logsum_by(v("v_calls"), ["read_id"], "llr").withColumn("logsum", F.round("logsum", 7))


@query("--with " + _LOGSUM + ", p as (select chromosome, exp(llr - m) / sum(exp(llr - m)) over (partition by c.read_id) as p from v_calls c join m using (read_id)) select chromosome, round(sum(p), 4) as support, count(*) as n from p group by chromosome", "v_calls")
def read_support_posterior(v, spark, sf_dir):
    return haplotype.support(v("v_calls"), ["read_id"], "chromosome", "llr").withColumn("support", F.round("support", 4))


_SCORES = "s as (select start_pos as site, read_id, -llr / 4 as s0, llr / 3 as s1 from v_calls)"


def _scores(v):
    return v("v_calls").select(F.col("start_pos").alias("site"), "read_id", (-F.col("llr") / 4).alias("s0"), (F.col("llr") / 3).alias("s1"))


@query("--with " + _SCORES + """, g as (select site, count(*) as n_reads, sum(s0) as g0, sum(greatest(s0, s1) + ln(1 + exp(-abs(s0 - s1))) - ln(2.0)) as g1, sum(s1) as g2 from s group by site),
c as (select site, n_reads, greatest(g0, g1, g2) - g0 as gain, case when greatest(g0, g1, g2) - g0 >= 20.0 then case when g2 > g1 and g2 > g0 then 2 when g1 > g0 then 1 else 0 end else 0 end as n_alt from g)
select site, n_reads, round(gain, 5) as gain, cast(n_alt as int) as n_alt, case n_alt when 0 then '0/0' when 1 then '0/1' else '1/1' end as gt from c""", "v_calls")
def genotype_call(v, spark, sf_dir):
    return haplotype.genotype(_scores(v)).withColumn("gain", F.round("gain", 5))


@query("with p as (select unnest(range(1, 6)) as p), n as (select p, unnest(range(0, p + 1)) as n from p) select cast(p as int) as ploidy, cast(n as int) as n_alt, array_to_string(list_transform(range(0, p), lambda i: case when i < p - n then '0' else '1' end), '/') as gt from n")
def genotype_string(v, spark, sf_dir):
    out = None
    for p in range(1, 6):
        n = spark.range(p + 1).select(F.lit(p).alias("ploidy"), F.col("id").cast("int").alias("n_alt"))
        n = n.withColumn("gt", haplotype.genotype_text(F.col("n_alt"), p))
        out = n if out is None else out.unionAll(n)
    return out


@query("--with " + _SCORES + " select read_id, site, case when s1 > s0 then 1 else 0 end as allele, round(least(30.0, -10 * log10(1 / (1 + exp(abs(s1 - s0))))), 6) as quality from s", "v_calls")
def phase_call(v, spark, sf_dir):
    return haplotype.phase(_scores(v)).withColumn("quality", F.round("quality", 6))


_COUNTS = "select start_pos as site, cast(count(*) filter (llr <= 0 and num_motifs % 2 = 0) as bigint) as a, cast(count(*) filter (llr <= 0 and num_motifs % 2 = 1) as bigint) as b, cast(count(*) filter (llr > 0 and num_motifs % 2 = 0) as bigint) as c, cast(count(*) filter (llr > 0 and num_motifs % 2 = 1) as bigint) as d from v_calls group by 1"


@query(f"select site, round(ln(r + 1/r) + ln(least(a+1.0, b+1.0) / greatest(a+1.0, b+1.0)) - ln(least(c+1.0, d+1.0) / greatest(c+1.0, d+1.0)), 7) as sor from (select *, ((a+1.0)*(d+1.0)) / ((b+1.0)*(c+1.0)) as r from ({_COUNTS}))".replace("1.0", "1.0::double"), "v_calls")
def strand_odds(v, spark, sf_dir):
    c = _strand_counts(v)
    return c.select("site", F.round(stats.strand_odds(*map(F.col, "abcd")), 7).alias("sor"))


def _strand_counts(v):
    up, odd = F.col("llr") > 0, F.col("num_motifs") % 2 == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return v("v_calls").groupBy(F.col("start_pos").alias("site")).agg(n(~up & ~odd).alias("a"), n(~up & odd).alias("b"), n(up & ~odd).alias("c"), n(up & odd).alias("d"))


@query("select rank, round(shape_part + lg, 6) as density from (select rank, 2.461964 * rank1 * ln(level_stdv) + (2.461964 * rank1 - 1) * ln(level_mean) - level_stdv * level_mean as shape_part, -lgamma(2.461964 * rank1) as lg from (select *, rank + 1 as rank1 from v_model))", "v_model")
def gamma_duration(v, spark, sf_dir):
    d = stats.gamma_sum_log_density(F.col("level_mean"), F.col("rank") + 1, 2.461964, F.col("level_stdv"))
    return v("v_model").select("rank", F.round(d, 6).alias("density"))


# ---- event time, beyond the reference's own windows ----


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as s from g) select user_id, min(ts) as first_ts, count(*) as n from s group by user_id, s")
def event_sessions(v, spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n from events group by all")
def event_tumbling(v, spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


# ---- maps between events, samples and positions ----


@query("select read_id, ref_pos, min(event_idx) as ev_start, max(event_idx) as ev_stop from v_events group by all", "v_events")
def base_event_map(v, spark, sf_dir):
    return events.base_event_map(v("v_events"))


@query("select read_id, event_idx, case when lag(kmer_rank) over (partition by read_id order by event_idx) = kmer_rank then 'E' else 'M' end as state from v_events", "v_events")
def event_states(v, spark, sf_dir):
    return events.event_states(v("v_events")).select("read_id", "event_idx", "state")


@query("select read_id, ref_pos, cast(coalesce(sum(dur_us), 0) as bigint) as duration from v_events group by all", "v_events")
def aligned_durations(v, spark, sf_dir):
    return events.durations(v("v_events"), ["read_id", "ref_pos"])


@query("select read_id, event_idx, cast(floor(start_us / 1e6 * 4000.0) as bigint) as first_sample, cast(floor((start_us / 1e6 + dur_us / 1e6) * 4000.0) as bigint) as end_sample from v_events", "v_events")
def event_samples(v, spark, sf_dir):
    a, b = events.sample_range(F.col("start_us") / F.lit(1e6), F.col("dur_us") / F.lit(1e6), 4000.0)
    return v("v_events").select("read_id", "event_idx", a.alias("first_sample"), b.alias("end_sample"))


@query("select kmer_rank, cast(count(*) filter (m = 1) as bigint) as num_matches, cast(count(*) filter (m = 0) as bigint) as num_stays, cast(count(*) filter (m > 1) as bigint) as num_skips from (select kmer_rank, coalesce(ref_pos - lag(ref_pos) over (partition by read_id order by event_idx), 1) as m from v_events) group by 1", "v_events")
def kmer_moves(v, spark, sf_dir):
    return events.kmer_moves(v("v_events"))


@query("""--with l as (select read_id, cast(ceil(ref_pos / 10.0) * 10 as bigint) as slot, arg_max(event_idx, ref_pos * 100000 + event_idx) as value from v_events group by all),
n as (select read_id, cast(min(ceil(ref_pos / 10.0) * 10) as bigint) as a, cast(max(floor(ref_pos / 10.0) * 10) as bigint) as b from v_events group by 1), e as (select read_id, unnest(range(a, b + 1, 10)) as slot from n where a <= b)
select e.read_id, e.slot, last_value(value ignore nulls) over (partition by e.read_id order by e.slot) as value from e left join l on l.read_id = e.read_id and l.slot = e.slot""", "v_events")
def anchor_positions(v, spark, sf_dir):
    e = v("v_events").groupBy("read_id", "ref_pos").agg(F.max("event_idx").alias("event_idx"))
    return events.anchors(e, "read_id", "ref_pos", "event_idx", 10)


@query("select l_orderkey, l_linenumber, l_returnflag as contig, l_partkey as start_pos, l_partkey + l_suppkey as end_pos from lineitem")
def parsed_regions(v, spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat("l_returnflag", F.lit(":"), F.format_number("l_partkey", 0), F.lit("-"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string"))
    return lines.select("l_orderkey", "l_linenumber", events.region(text).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("select contig, cast(count(*) filter (len(ref) = len(alt)) as bigint) as subs, cast(count(*) filter (len(ref) < len(alt)) as bigint) as ins, cast(count(*) filter (len(ref) > len(alt)) as bigint) as dels from (select contig, ref, alt || case when gt = '1/1' then 'C' else '' end as alt from v_var) group by contig", "v_var")
def edit_counts(v, spark, sf_dir):
    d = v("v_var").withColumn("alt", F.concat("alt", F.when(F.col("gt") == "1/1", "C").otherwise("")))
    return haplotype.edit_counts(d)


@query("--with " + _ON_REF + " select p.contig, pos, ref, alt from p join v_ref r on r.contig = p.contig where substr(seq, cast(pos as bigint) + 1, 1) = ref", "v_ref")
def matching_variants(v, spark, sf_dir):
    return haplotype.matching(_on_ref(v, spark, sf_dir), v("v_ref"))


@query("--with r as (select read_id, chromosome, llr, row_number() over (partition by read_id order by llr desc, chromosome) as k from v_calls) select chromosome, count(*) as n from r where k = 1 group by 1", "v_calls")
def hard_support(v, spark, sf_dir):
    return haplotype.hard_support(v("v_calls"), ["read_id"], "chromosome", "llr")


@query("select read_id, median(dur_us) as median from v_events where dur_us is not null group by read_id", "v_events")
def duration_median(v, spark, sf_dir):
    return v("v_events").filter("dur_us is not null").groupBy("read_id").agg(F.percentile("dur_us", 0.5).alias("median"))


@query("""--with e as (select read_id, min(event_idx) filter (ref_pos >= 5) as a, min(event_idx) filter (ref_pos >= 30) as b from v_events group by 1) select read_id, coalesce(a is not null and b is not null and abs(b - a) > 10, false) as usable from e""", "v_events")
def bounded_stretches(v, spark, sf_dir):
    ends = v("v_events").groupBy("read_id").agg(F.min(F.when(F.col("ref_pos") >= 5, F.col("event_idx"))).alias("a"), F.min(F.when(F.col("ref_pos") >= 30, F.col("event_idx"))).alias("b"))
    return ends.select("read_id", events.bounded(F.col("a"), F.col("b"), F.lit(5), F.lit(30)).alias("usable"))


@query("""--with """ + _ON_REF + """, c as (select contig, pos, case when pos % 5 = 0 then ref || 'A' else ref end as ref, case when pos % 7 = 0 then alt || 'GG' else alt end as alt from p),
g as (select contig, list_sort(list_distinct(list({'pos': pos, 'ref': ref, 'alt': alt}))) as changes from c group by contig),
f as (select r.contig, r.seq, coalesce(len(changes), 0) as n, list_reduce(coalesce(list_transform(changes, lambda x: {'at': 0::bigint, 'out': '', 'k': 0, 'pos': x.pos::bigint, 'ref': x.ref, 'alt': x.alt, 'seq': r.seq}), []),
 lambda a, v: case when v.pos >= a.at and substr(v.seq, v.pos + 1, len(v.ref)) = v.ref then {'at': v.pos + len(v.ref), 'out': a.out || substr(v.seq, a.at + 1, v.pos - a.at) || v.alt, 'k': a.k + 1, 'pos': v.pos, 'ref': v.ref, 'alt': v.alt, 'seq': v.seq}
 else {'at': a.at, 'out': a.out, 'k': a.k, 'pos': v.pos, 'ref': v.ref, 'alt': v.alt, 'seq': v.seq} end, {'at': 0::bigint, 'out': '', 'k': 0, 'pos': 0::bigint, 'ref': '', 'alt': '', 'seq': ''}) as f from v_ref r left join g on g.contig = r.contig)
select contig, f.out || substr(seq, f.at + 1) as seq, cast(f.k as int) as n_applied, cast(n - f.k as int) as n_skipped from f""", "v_ref")
def apply_variants(v, spark, sf_dir):
    p = _on_ref(v, spark, sf_dir)
    p = p.select("contig", "pos", F.when(F.col("pos") % 5 == 0, F.concat("ref", F.lit("A"))).otherwise(F.col("ref")).alias("ref"), F.when(F.col("pos") % 7 == 0, F.concat("alt", F.lit("GG"))).otherwise(F.col("alt")).alias("alt"))
    return haplotype.apply_variants(v("v_ref"), p)


@query("select contig, list_distinct([seq, replace(seq, 'CG', 'MG'), replace(seq, 'GATC', 'GMTC')]).len() as n_forms from v_ref", "v_ref")
def methylated_forms(v, spark, sf_dir):
    return v("v_ref").select("contig", F.size(haplotype.methylated_alternatives(F.col("seq"), ["cpg", "dam"])).cast("long").alias("n_forms"))
