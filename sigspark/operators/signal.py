"""Signal and events: units, scaling, calibration, summaries, segmentation scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import log_normal_pdf, normal_pdf, z_score


def to_picoamperes(samples: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    unit = range_ / digitisation
    return F.transform(samples, lambda x: (x + offset) * unit)


def ordered(by: str = "read_id", order: str = "event_idx"):
    return Window.partitionBy(by).orderBy(order)


def start_times(events: DataFrame, by: str = "read_id", order: str = "event_idx", duration: str = "dur_us") -> DataFrame:
    """Start of each event as the sum of the durations before it."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("start_time", F.coalesce(F.sum(duration).over(w), F.lit(0)).cast("long"))


def scaled_level(mean: Column, t: Column, shift: Column, scale: Column, drift: Column) -> Column:
    return (mean - t * drift - shift) / scale


def model_for_read(level_mean: Column, level_stdv: Column, shift: Column, scale: Column, var: Column) -> tuple[Column, Column]:
    return level_mean * scale + shift, level_stdv * var


def match_log_prob(level: Column, model_mean: Column, model_stdv: Column) -> Column:
    return log_normal_pdf(level, model_mean, model_stdv)


def with_model(events: DataFrame, model: DataFrame, rank: str = "kmer_rank", how: str = "inner") -> DataFrame:
    """Events with their k-mer's state. A model has a row for each k-mer, 4,096 for six bases; it is broadcast up to ten. how:
    left keeps events whose k-mer the model lacks, with nulls."""
    return events.join(model.withColumnRenamed("rank", rank), rank, how)


def from_model_set(asked: DataFrame, models: DataFrame, key: tuple[str, ...] = ("kit", "alphabet", "strand", "k")) -> DataFrame:
    """The model of each composite key asked for; nulls where the set has none."""
    return asked.join(models, [*key], "left")


def standardised(level: Column, model_mean: Column, model_stdv: Column, var: Column) -> Column:
    """As event tables print it: by the root of the read's variance factor."""
    return z_score(level, model_mean, model_stdv * F.sqrt(var))


def moves(events: DataFrame, by: str = "read_id") -> DataFrame:
    """Steps, stays and skips along the reference, with total duration, by read."""
    d = F.col("ref_pos") - F.lag("ref_pos").over(ordered(by))
    m = events.withColumn("move", d)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return m.groupBy(by).agg(F.count("*").alias("num_events"), count(F.col("move") == 0).alias("num_stays"), count(F.col("move") == 1).alias("num_steps"), count(F.col("move") > 1).alias("num_skips"), F.coalesce(F.sum("dur_us"), F.lit(0)).cast("long").alias("total_duration"), (F.max("ref_pos") - F.min("ref_pos") + 1).alias("ref_span"))


def count_windows(events: DataFrame, value: str, size: int = 500, by: str = "read_id") -> DataFrame:
    """Sums over windows of size events; the first window and a partial last one don't count."""
    rank = F.row_number().over(ordered(by))
    w = events.withColumn("segment", F.floor((rank - 1) / size))
    return w.groupBy(by, "segment").agg(F.count("*").alias("n"), F.sum(value).alias("total")).filter((F.col("segment") > 0) & (F.col("n") == size)).select(by, "segment", "total")


def scalings_by_moments(events: DataFrame, levels: DataFrame, by: str = "read_id") -> DataFrame:
    """Shift and scale that bring the read's moments to those of its k-mers' levels. levels: read_id, level_mean."""
    e = events.groupBy(by).agg(F.avg("mean").alias("em"), F.avg(F.col("mean") * F.col("mean")).alias("e2"))
    m = levels.groupBy(by).agg(F.avg("level_mean").alias("km"), F.avg(F.col("level_mean") * F.col("level_mean")).alias("k2"))
    scale = F.sqrt((F.col("e2") - F.col("em") ** 2) / F.col("k2_var"))
    j = e.join(m, by).withColumn("k2_var", F.col("k2") - F.col("km") ** 2).filter("k2_var > 0")
    return j.withColumn("scale", scale).select(by, (F.col("em") - F.col("scale") * F.col("km")).alias("shift"), "scale")


def calibrate(events: DataFrame, drift: bool, by: str = "read_id", least: int = 200) -> DataFrame:
    """Weighted least squares of event means on model levels (and time): shift, scale, drift and the residual's deviation in
    model deviations. One aggregation of the normal equations' sums, solved in closed form. events: mean, t, level_mean,
    level_stdv."""
    w, x, y, t = 1 / (F.col("level_stdv") ** 2), F.col("level_mean"), F.col("mean"), F.col("t")
    s = lambda e, n: F.sum(e).alias(n)
    g = events.groupBy(by).agg(F.count("*").alias("n"), s(w, "w"), s(w * x, "wx"), s(w * x * x, "wxx"), s(w * y, "wy"), s(w * x * y, "wxy"), s(w * y * y, "wyy"), s(w * t, "wt"), s(w * t * t, "wtt"), s(w * x * t, "wxt"), s(w * y * t, "wyt")).filter(F.col("n") >= least)
    c = F.col
    if not drift:
        det = c("w") * c("wxx") - c("wx") ** 2
        g = g.withColumn("det", det).filter("det <> 0").withColumn("shift", (c("wy") * c("wxx") - c("wx") * c("wxy")) / c("det")).withColumn("scale", (c("w") * c("wxy") - c("wx") * c("wy")) / c("det")).withColumn("drift", F.lit(0.0))
    else:
        def det3(a):
            return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

        m = [[c("w"), c("wx"), c("wt")], [c("wx"), c("wxx"), c("wxt")], [c("wt"), c("wxt"), c("wtt")]]
        right = [c("wy"), c("wxy"), c("wyt")]
        by_column = [det3([[right[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
        g = g.withColumn("det", det3(m)).filter("det <> 0")
        for k, name in enumerate(("shift", "scale", "drift")):
            g = g.withColumn(name, by_column[k] / c("det"))
    rss = c("wyy") - c("shift") * c("wy") - c("scale") * c("wxy") - c("drift") * c("wyt")
    return g.withColumn("var", F.sqrt(F.greatest(rss, F.lit(0.0)) / c("n"))).select(by, "n", "shift", "scale", "drift", "var")


def read_rate(durations: DataFrame, by: str = "read_id", value: str = "dur_us") -> DataFrame:
    """Upper median of the durations, and its inverse; nulls don't count. One sort inside the shuffle that groups."""
    w = Window.partitionBy(by).orderBy(value)
    n = F.count(value).over(Window.partitionBy(by))
    df = durations.filter(F.col(value).isNotNull()).select(by, value, F.row_number().over(w).alias("i"), n.alias("n"))
    return df.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select(by, F.col(value).alias("median"), F.when(F.col(value) > 0, 1 / F.col(value)).alias("rate"))


def tail_length(adapter_end: Column, tail_end: Column, sample_rate: Column, rate: Column) -> Column:
    """Bases of the tail: its seconds times the read's bases a second, less five, at least 0."""
    return F.greatest((tail_end - (adapter_end + 1)) / sample_rate * rate - 5, F.lit(0.0))


def tail_tag(adapter_samples: Column, tail_samples: Column, adapter_bases: Column) -> Column:
    return F.when((adapter_samples < 200) | (tail_samples < 200), "NOREGION").when(adapter_bases > 300, "ADAPTER").otherwise("PASS")


#: The six states' order, their transition probabilities, and what their samples look like.
STATES = ["START", "LEADER", "ADAPTER", "POLYA", "CLIFF", "TRANSCRIPT"]
TRANSITIONS = {("START", "START"): 0.10, ("START", "LEADER"): 0.90, ("LEADER", "LEADER"): 0.90, ("LEADER", "ADAPTER"): 0.10, ("ADAPTER", "ADAPTER"): 0.95, ("ADAPTER", "POLYA"): 0.05, ("POLYA", "POLYA"): 0.89, ("POLYA", "CLIFF"): 0.01, ("POLYA", "TRANSCRIPT"): 0.10, ("CLIFF", "POLYA"): 0.99, ("CLIFF", "CLIFF"): 0.01, ("TRANSCRIPT", "TRANSCRIPT"): 1.00}
EMISSIONS = {"START": (70.2737, 3.7743, 0.5, 0.00476), "LEADER": (110.973, 5.237), "ADAPTER": (79.347, 8.3702, 0.874, 63.3126, 2.7464), "POLYA": (108.883, 3.257), "CLIFF": (70.0, 140.0, -4.2485), "TRANSCRIPT": (79.679, 6.966, 0.346, 105.784, 16.022)}
#: Stands for minus infinity in folds, where a null would spread.
NEVER = -1e30


def emissions(x: Column) -> list[Column]:
    """Log-probability of a scaled sample in each state; samples out of 40..200 count as 100."""
    x = F.when((x > 200) | (x < 40), F.lit(100.0)).otherwise(x)
    pdf = lambda m, s: normal_pdf(x, F.lit(m), F.lit(s))
    m, s, share, flat = EMISSIONS["START"]
    out = [F.ln(share * pdf(m, s) + (1 - share) * flat), log_normal_pdf(x, *map(F.lit, EMISSIONS["LEADER"]))]
    for name in ("ADAPTER", "TRANSCRIPT"):
        a, b, share, c, d = EMISSIONS[name]
        out.append(F.ln(share * pdf(a, b) + (1 - share) * pdf(c, d)))
    low, high, level = EMISSIONS["CLIFF"]
    cliff = F.when((x > low) & (x < high), F.lit(level)).otherwise(F.lit(NEVER))
    return [out[0], out[1], out[2], log_normal_pdf(x, *map(F.lit, EMISSIONS["POLYA"])), cliff, out[3]]


def segmentation_score(samples: Column) -> Column:
    """Log-probability of the best path that ends in the transcript, as one fold over the array; null for no samples."""
    names = [s.lower()[0] for s in STATES]
    log = {k: math.log(v) for k, v in TRANSITIONS.items()}
    start = F.struct(F.lit(0).alias("n"), *[F.lit(0.0 if i == 0 else NEVER).alias(n) for i, n in enumerate(names)])

    def step(a, x):
        e = emissions(x)
        best = []
        for j, to in enumerate(STATES):
            ways = [a[names[i]] + log[frm, to] for i, frm in enumerate(STATES) if (frm, to) in log]
            best.append((F.greatest(*ways) if len(ways) > 1 else ways[0]) + e[j])
        first = [(F.lit(0.0) + e[0]) if j == 0 else F.lit(NEVER) + e[j] for j in range(6)]
        return F.struct((a["n"] + 1).alias("n"), *[F.when(a["n"] == 0, first[j]).otherwise(best[j]).alias(n) for j, n in enumerate(names)])

    return F.when(F.size(samples) > 0, F.aggregate(samples, start, step)["t"])


#: Two Gaussians whose ratio gives the bits, the mean that samples are moved to, the share of ones, transitions.
BITS = {"polyi": (108.498, 5.257), "polya": (108.883, 3.257)}
CENTRE, ONES_I, ONES_A, STAY_I = 108.0, 0.72304, 0.92154, 0.90


def polyi_bits(samples: Column) -> Column:
    """1 where the log-likelihoods' quotient (polyI over polyA) exceeds 1, after moving the mean."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)

    def bit(x, m):
        y = x - m + CENTRE
        y = F.when((y > 200) | (y < 40), F.lit(100.0)).otherwise(y)
        return F.when(log_normal_pdf(y, *map(F.lit, BITS["polyi"])) / log_normal_pdf(y, *map(F.lit, BITS["polya"])) > 1, 1).otherwise(0)

    # As a variable of an outer function the mean is taken once, not for each sample.
    held = F.array(F.struct(samples.alias("s"), mean.alias("m")))
    return F.get(F.transform(held, lambda h: F.transform(h["s"], lambda x: bit(x, h["m"]))), F.lit(0))


def switch_score(bits: Column) -> Column:
    """Best log-probabilities of ending in polyI and in polyA, a struct (i, a): a fold of two states."""
    one = lambda p: (math.log(p), math.log(1 - p))
    (i1, i0), (a1, a0) = one(ONES_I), one(ONES_A)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("i"), F.lit(NEVER).alias("a"))

    def step(s, b):
        ei, ea = F.when(b == 1, i1).otherwise(i0), F.when(b == 1, a1).otherwise(a0)
        ii, ia = s["i"] + math.log(STAY_I), s["i"] + math.log(1 - STAY_I)
        return F.struct((s["n"] + 1).alias("n"), (F.when(s["n"] == 0, s["i"]).otherwise(ii) + ei).alias("i"), (F.when(s["n"] == 0, s["a"]).otherwise(F.greatest(ia, s["a"])) + ea).alias("a"))

    return F.aggregate(bits, start, step)


def skip_counts(events: DataFrame, by: str = "read_id", width: float = 0.5, bins: int = 30) -> DataFrame:
    """How often a k-mer was skipped, by how far its level lies from the one before."""
    from ..functions.stats import skip_bin

    w = ordered(by)
    d = events.withColumn("_move", F.col("ref_pos") - F.lag("ref_pos").over(w)).withColumn("_last", F.lag("level_mean").over(w)).filter("_move >= 1")
    d = d.withColumn("bin", skip_bin(F.col("level_mean"), F.col("_last"), width, bins))
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_move") > 1, 1).otherwise(0)).cast("long").alias("skips"))


def transition_counts(events: DataFrame, by: str = "read_id") -> DataFrame:
    w = ordered(by)
    d = events.withColumn("from_label", F.lag("label").over(w)).filter("from_label is not null")
    return d.groupBy("from_label", F.col("label").alias("to_label")).agg(F.count("*").alias("n"))


def drop_k(model: DataFrame) -> DataFrame:
    """The model of k-mers one base shorter: mean of the means, and variance within plus between."""
    g = model.groupBy(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("kmer"))
    return g.agg(F.avg("level_mean").alias("level_mean"), F.sqrt(F.avg(F.col("level_stdv") ** 2) + F.avg(F.col("level_mean") ** 2) - F.avg("level_mean") ** 2).alias("level_stdv"))


def longest_read(events: DataFrame, by: str = "read_id") -> DataFrame:
    """The read of most events; of equals the first by name."""
    return events.groupBy(by).agg(F.count("*").alias("n_events")).orderBy(F.desc("n_events"), by).limit(1)


def collapsed(events: DataFrame, by: str = "read_id") -> DataFrame:
    """Durations of stretches of events on one position."""
    w = Window.partitionBy(by).orderBy("event_idx")
    new = F.when(F.lag("ref_pos").over(w) == F.col("ref_pos"), 0).otherwise(1)
    run = events.select(by, "event_idx", "dur_us", new.alias("_new")).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(by, "_run").agg(F.sum("dur_us").alias("dur_us")).select(by, "dur_us")


def segment_moments(samples: DataFrame, tag: str, value: str) -> DataFrame:
    """Number, mean and deviation of each kind of segment: the likeliest Gaussian."""
    return samples.groupBy(tag).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdv"))


def tagged_samples(regions: DataFrame) -> DataFrame:
    """A row for each sample with its region's name. regions: read_id, samples, and the last sample of start, leader, adapter and
    polya; the tail's last sample counts with what follows it."""
    i = F.col("sample_idx")
    rows = regions.select("read_id", "start", "leader", "adapter", "polya", F.posexplode("samples").alias("sample_idx", "sample"))
    tag = F.when(i < F.col("start") + 1, "START").when(i < F.col("leader") + 1, "LEADER").when(i < F.col("adapter") + 1, "ADAPTER").when(i < F.col("polya"), "POLYA").otherwise("TRANSCRIPT")
    return rows.select("read_id", "sample_idx", "sample", tag.alias("tag"))
