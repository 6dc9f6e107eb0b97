"""Variant calling from events: groups of candidates, their haplotypes, scores, genotypes; and consensus by rounds of it.

A group's row holds its variants and haplotypes, whose number has a bound; reads pass by their group one by one and are never gathered in a row. Sets of
haplotypes are scored read by read and summed behind the join by group, without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..functions import stats
from ..operators import haplotype, islands, rangejoin
from ..sources.tables import stored
from . import calling

_STEP = "struct(cast(0 as int) as at, '' as out, true as ok)"


def groups(candidates: DataFrame, ref: DataFrame, distance: int | None = 10, flank: int = 30, most_span: int = 200) -> DataFrame:
    """Candidates (contig, pos, ref, alt; repeats count once) that stand within distance of the one before are one group; each is
    a group of its own if distance is None. group_id, contig, sub_start, sub_end (the last base), base (the reference there,
    with flanks that end at the contig's ends), variants in order. Groups of a longer span aren't called; the span is taken
    before their variants are gathered."""
    v = haplotype.distinct(candidates.select(*haplotype.KEY))
    if distance is None:
        v = v.withColumn("group_id", haplotype.key())
    else:
        v = islands.grouped(v, distance).withColumn("group_id", F.concat_ws(":", "contig", F.col("group_id").cast("string")))
    last = F.max_by(F.length("ref"), F.struct("pos", "ref", "alt"))
    span = v.groupBy("group_id", "contig").agg((F.min("pos") - flank).alias("a"), (F.max("pos") + last + flank).alias("b")).filter(F.col("b") - F.col("a") <= most_span)
    held = v.join(span.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))).alias("variants"))
    j = span.join(held, "group_id").join(ref.select("contig", "seq"), "contig")
    start, end = F.greatest(F.col("a"), F.lit(0)), F.least(F.col("b"), F.length("seq") - 1)
    j = j.filter(start <= end)
    return j.select("group_id", "contig", start.cast("long").alias("sub_start"), end.cast("long").alias("sub_end"), F.substring("seq", (start + 1).cast("int"), (end - start + 1).cast("int")).alias("base"), "variants")


def most_variants(n: Column, max_haplotypes: int) -> Column:
    """How many of n variants a haplotype may hold, so that all combinations of at least one stay under max_haplotypes."""

    def add(a, r):
        c = a["c"] * (n - r + 1) / r
        more = a["open"] & (a["sum"] + c < max_haplotypes)
        return F.struct(F.when(more, r).otherwise(a["r"]).alias("r"), c.alias("c"), F.when(more, a["sum"] + c).otherwise(a["sum"]).alias("sum"), more.alias("open"))

    start = F.struct(F.lit(0).alias("r"), F.lit(1.0).alias("c"), F.lit(0.0).alias("sum"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), n), start, add)["r"]


def with_haplotypes(grouped: DataFrame, max_haplotypes: int = 1000) -> DataFrame:
    """The groups with combos: the variants' numbers of each haplotype (items) and its sequence (seq), smaller sets first; the
    first is the base. A combination whose variants overlap, or differ from the reference, is left out."""
    df = grouped.withColumn("_r", most_variants(F.size("variants"), max_haplotypes))
    # Sets grow item by item and never hold more than _r, so no more of them exist than are used.
    grow = lambda acc, i: F.concat(acc, F.transform(F.filter(acc, lambda c: F.size(c) < F.col("_r")), lambda c: F.array_append(c, i)))
    sets = F.aggregate(F.sequence(F.lit(0), F.size("variants") - 1), F.expr("array(cast(array() as array<int>))"), grow)
    sets = F.array_sort(F.transform(sets, lambda c: F.struct(F.size(c).alias("n"), c.alias("items"))))

    def apply(a, i):
        v = F.get("variants", i)
        at = (v["pos"] - F.col("sub_start")).cast("int")
        ok = a["ok"] & (at >= a["at"]) & (F.substring("base", at + 1, F.length(v["ref"])) == v["ref"])
        out = F.concat(a["out"], F.substring("base", a["at"] + 1, at - a["at"]), v["alt"])
        return F.struct(F.when(ok, at + F.length(v["ref"])).otherwise(a["at"]).alias("at"), F.when(ok, out).otherwise(a["out"]).alias("out"), ok.alias("ok"))

    done = F.transform(sets, lambda s: F.struct(s["items"].alias("items"), F.aggregate(s["items"], F.expr(_STEP), apply).alias("f")))
    good = F.filter(done, lambda d: d["f"]["ok"])
    rest = lambda f: F.concat(f["out"], F.substring("base", f["at"] + 1, F.length("base")))
    combos = F.transform(good, lambda d: F.struct(d["items"].alias("items"), rest(d["f"]).alias("seq")))
    return df.withColumn("combos", combos).drop("_r")


def reads_over(grouped: DataFrame, events: DataFrame, k: int, least: int = 10, most_ratio: float = 20.0) -> DataFrame:
    """Events of each read over each group that it spans: group_id, read_id, rc, means. events: read_id, contig, event_idx, mean,
    ref_pos, and rc (reverse strand; false where it lacks). Reads of least or fewer events there, or of over most_ratio
    events a base, are left out."""
    rc = F.col("rc") if "rc" in events.columns else F.lit(False)
    e = events.select("read_id", "contig", "event_idx", "mean", "ref_pos", rc.alias("rc"))
    spans = e.groupBy("read_id", "contig").agg(F.min("ref_pos").alias("first"), F.max("ref_pos").alias("last"))
    places = grouped.select("group_id", "contig", "sub_start", (F.col("sub_end") - k + 1).alias("sub_end")).filter("sub_start < sub_end")
    inside = rangejoin.points_in_intervals(places, spans, ["contig"], "sub_start", "first", "last", bin_size=1 << 13).filter("sub_end <= last")
    near = rangejoin.points_in_intervals(e, inside.select("group_id", "read_id", "contig", "sub_start", "sub_end"), ["read_id", "contig"], "ref_pos", "sub_start", "sub_end", bin_size=256)
    x = F.array_sort(F.collect_list(F.struct("event_idx", "mean")))
    rows = near.groupBy("group_id", "read_id").agg(F.first("rc").alias("rc"), F.max(F.col("sub_end") - F.col("sub_start")).alias("_n"), F.transform(x, lambda y: y["mean"]).alias("means"))
    return rows.filter((F.size("means") > least) & (F.size("means") <= most_ratio * F.col("_n"))).drop("_n")


def scores(grouped: DataFrame, reads: DataFrame, model: DataFrame, k: int, alphabets: tuple[str, ...] = (), events_per_base: float = 1.5) -> DataFrame:
    """Each read's log-likelihood of each haplotype: group_id, haplotype_id, read_id, rc, score. With alphabets a haplotype also
    stands in its modified forms, whose likelihoods are averaged."""
    h = grouped.select("group_id", F.posexplode("combos").alias("haplotype_id", "c")).select("group_id", F.col("haplotype_id").cast("long"), seq.disambiguate(F.col("c.seq")).alias("seq"))
    forms = h.select("group_id", "haplotype_id", F.posexplode(haplotype.methylated_alternatives(F.col("seq"), [*alphabets])).alias("form", "seq"))
    width = len(alphabets) + 1
    forms = forms.select("group_id", (F.col("haplotype_id") * width + F.col("form")).alias("haplotype_id"), "seq")
    s = calling.score_haplotypes(reads.select("group_id", "read_id", "means"), forms, model, k, events_per_base)
    if alphabets:
        s = haplotype.mixture_by(s.withColumn("haplotype_id", F.floor(F.col("haplotype_id") / width)), ["group_id", "haplotype_id", "read_id"]).withColumnRenamed("mixture", "score")
    return s.join(reads.select("group_id", "read_id", "rc"), ["group_id", "read_id"])


def call(scored: DataFrame, grouped: DataFrame, ploidy: int = 2, least_gain: float = 20.0, genotype_all: bool = False) -> DataFrame:
    """The variants of each group's likeliest set of haplotypes, if it beats the base's by least_gain: group_id, contig, pos, ref, alt,
    quality, total_reads, allele_count, support_fraction, ref_fwd, ref_rev, alt_fwd, alt_rev, fisher, sor, genotype. scored: group_id,
    haplotype_id (place in combos), read_id, score, rc if known; or a row a read, with its scores in order as s. Of equal sets the first counts. With genotype_all all variants
    stay, uncalled ones with quality 0, and with genotype '.' where no read spans the group. A read without a score of every
    haplotype says nothing about the sets and is left out. Groups of one haplotype give nothing."""
    rc = F.col("rc") if "rc" in scored.columns else F.lit(False)
    g = grouped.select("group_id", "contig", "variants", F.transform("combos", lambda c: c["items"]).alias("items")).filter(F.size("items") > 1)
    if "s" in scored.columns:
        read = scored.select("group_id", "read_id", rc.alias("rc"), "s")
    else:
        read = scored.groupBy("group_id", "read_id").agg(F.first(rc).alias("rc"), F.transform(F.array_sort(F.collect_list(F.struct("haplotype_id", "score"))), lambda x: x["score"]).alias("s"))
    n_items = g.select("group_id", F.size("items").alias("_n"), "items", F.size("variants").alias("n_variants"))
    # A sorted join: reads pass by their group one by one, and lie by group for the sums below, which then shuffle nothing.
    read = read.join(n_items.hint("merge"), "group_id").filter(F.size("s") == F.col("_n"))

    # Sets of haplotypes, ascending with repeats: a generator a member, so that a row never holds all of them.
    sets, members = read.select("group_id", "s", "_n"), []
    for i in range(ploidy):
        sets = sets.withColumn(f"_h{i}", F.explode(F.sequence(F.col(members[-1]) if members else F.lit(0), F.col("_n") - 1)))
        members.append(f"_h{i}")
    one = [F.get("s", F.col(m)) for m in members]
    most = F.greatest(*one) if ploidy > 1 else one[0]
    total = one[0] * 0
    for x in one:
        total = total + F.exp(x - F.col("_m"))
    # Fixed value: each member's score counts half, whatever the ploidy.
    sets = sets.withColumn("_m", most).withColumn("_score", F.col("_m") + F.ln(total) - F.ln(F.lit(2.0)))
    sets = sets.groupBy("group_id", *members).agg(F.sum("_score").alias("_score"))
    base = F.col(members[-1]) == 0  # the members ascend
    best = sets.groupBy("group_id").agg(F.max_by(F.array(*members), F.struct("_score", *[-F.col(m) for m in members])).alias("_set"), (F.max("_score") - F.max(F.when(base, F.col("_score")))).alias("gain"))
    best = best.withColumn("_set", F.when(F.col("gain") >= least_gain, F.col("_set")).otherwise(F.array_repeat(F.lit(0), ploidy)))

    # Each read's share of a variant: the posteriors of the haplotypes that hold it.
    top = F.array_max("s")
    p = F.transform("s", lambda x: F.exp(x - top))
    shares = read.withColumn("_p", p).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
    holds = F.transform(F.sequence(F.lit(0), F.col("n_variants") - 1), lambda v: F.aggregate(F.zip_with("_p", "items", lambda x, i: F.when(F.array_contains(i, v), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x))
    shares = shares.select("group_id", "rc", "_sum", F.posexplode(holds).alias("v", "_w")).select("group_id", "rc", "v", (F.col("_w") / F.col("_sum")).alias("p"))
    side = lambda on, x: F.sum(F.when(F.col("rc") == on, x).otherwise(0.0))
    support = shares.groupBy("group_id", "v").agg(F.count("*").alias("total_reads"), F.avg("p").alias("support_fraction"), side(False, 1 - F.col("p")).alias("ref_fwd"), side(True, 1 - F.col("p")).alias("ref_rev"), side(False, F.col("p")).alias("alt_fwd"), side(True, F.col("p")).alias("alt_rev"))

    each = g.join(best, "group_id", "left").select("group_id", "contig", "items", "_set", "gain", F.posexplode("variants").alias("v", "x"))
    n = F.size(F.filter("_set", lambda h: F.array_contains(F.get("items", h), F.col("v"))))
    each = each.withColumn("allele_count", F.when(F.col("_set").isNull(), 0).otherwise(n)).join(support, ["group_id", "v"], "left")
    if not genotype_all:
        each = each.filter("allele_count > 0")
    counts = [F.col(c) for c in ("ref_fwd", "ref_rev", "alt_fwd", "alt_rev")]
    out = each.select("group_id", "contig", "x.pos", "x.ref", "x.alt", F.when(F.col("allele_count") > 0, F.col("gain")).otherwise(0.0).alias("quality"), F.coalesce("total_reads", F.lit(0)).cast("long").alias("total_reads"), "allele_count", "support_fraction", *counts)
    out = out.withColumn("fisher", F.when(counts[0].isNotNull(), stats.fisher_phred(*[c.cast("long") for c in counts]))).withColumn("sor", stats.strand_odds(*counts))
    return out.withColumn("genotype", F.when(F.col("total_reads") > 0, haplotype.genotype_text(F.col("allele_count"), ploidy)).otherwise("."))


def call_variants(candidates: DataFrame, ref: DataFrame, events: DataFrame, model: DataFrame, k: int, ploidy: int = 2, max_haplotypes: int = 1000, alphabets: tuple[str, ...] = (), genotype_all: bool = False) -> DataFrame:
    """Candidates called against a reference by the reads' events, as call() gives them."""
    g = with_haplotypes(groups(candidates, ref), max_haplotypes)
    return call(scores(g, reads_over(g, events, k), model, k, alphabets), g, ploidy, genotype_all=genotype_all)


def screened(candidates: DataFrame, ref: DataFrame, events: DataFrame, model: DataFrame, k: int, flank: int = 10) -> DataFrame:
    """Candidates that, each alone, make the reads that span them likelier: contig, pos, ref, alt, gain."""
    g = with_haplotypes(groups(candidates, ref, None, flank))
    gains = calling.screen(scores(g, reads_over(g, events, k, least=0), model, k))
    return g.join(gains, "group_id").select("contig", F.explode("variants").alias("v"), "gain").select("contig", "v.*", "gain")


def expanded(called: DataFrame, ref: DataFrame, flank: int = 30) -> DataFrame:
    """The calls; and those that aren't substitutions of one base also with one more deleted base, unless within flank of the
    contig's end, and with each base inserted behind."""
    j = called.select(*haplotype.KEY).join(ref.select("contig", "seq"), "contig")
    end = F.col("pos") + F.length("ref")
    deeper = F.when(F.length("seq") - end > flank, F.array(F.struct(F.concat("ref", F.substring("seq", (end + 1).cast("int"), F.lit(1))).alias("ref"), F.col("alt").alias("alt")))).otherwise(F.expr("cast(array() as array<struct<ref: string, alt: string>>)"))
    longer = F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.struct(F.col("ref").alias("ref"), F.concat("alt", b).alias("alt")))
    own = F.array(F.struct("ref", "alt"))
    plain = (F.length("ref") == 1) & (F.length("alt") == 1)
    every = F.when(plain, own).otherwise(F.concat(own, deeper, longer))
    return haplotype.distinct(j.select("contig", "pos", F.explode(every).alias("e")).select("contig", "pos", "e.ref", "e.alt"))


def consensus(candidates: DataFrame, ref: DataFrame, events: DataFrame, model: DataFrame, k: int, edits: bool = True, most_rounds: int = 50, max_haplotypes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Contigs polished by the reads' events, and the calls. Candidates, with edits also every single-base edit that gains alone, go
    through rounds of screening, calling of one haplotype, and expansion, until the calls stay the same. Each round is a job
    over all contigs; its calls are stored, and only counts come to the driver."""
    # Events and contigs are read in every round.
    events, ref = stored(events, "events"), stored(ref.select("contig", "seq"), "contigs")
    if edits:
        candidates = candidates.select(*haplotype.KEY).unionAll(screened(haplotype.single_base_edits(ref), ref, events, model, k).select(*haplotype.KEY))
    candidates, last = stored(haplotype.distinct(candidates.select(*haplotype.KEY)), "candidates"), None
    for _ in range(most_rounds):
        fit = stored(screened(candidates, ref, events, model, k).select(*haplotype.KEY), "fit")
        now = stored(call_variants(fit, ref, events, model, k, 1, max_haplotypes), "calls")
        if last is None:
            changed = now.count()
        else:
            changed = haplotype.changed(last, now).count()
        last = now
        if not changed:
            break
        candidates = stored(expanded(now, ref), "candidates")
    return haplotype.apply_variants(ref, last.select(*haplotype.KEY)), last
