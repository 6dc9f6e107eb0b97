"""Variants and haplotypes: edits, application, combinations, support, genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["contig", "pos", "ref", "alt"]


def key(contig="contig", pos="pos", ref="ref", alt="alt") -> Column:
    return F.concat_ws(":", contig, F.col(pos).cast("string"), ref, alt)


def distinct(variants: DataFrame) -> DataFrame:
    return variants.dropDuplicates(KEY)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that only one of two rounds has, with the side."""
    a, b = before.select(*KEY).distinct(), after.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("side", F.lit("lost")).unionAll(b.join(a, KEY, "left_anti").withColumn("side", F.lit("new")))


def single_base_edits(ref: DataFrame) -> DataFrame:
    """Every substitution, insertion after a base (not of that base) and deletion of a base (not where it repeats)."""
    bases = F.array(*map(F.lit, "ACGT"))
    # Each base with the next one, in one pass over the sequence.
    two = F.regexp_extract_all("seq", F.lit("(?s)(?=(.{1,2}))"), F.lit(1))
    at = ref.select("contig", F.posexplode(two).alias("i", "two")).select("contig", "i", F.substring("two", 1, 1).alias("base"), F.substring("two", 2, 1).alias("next"))
    subs = F.transform(F.filter(bases, lambda b: b != F.col("base")), lambda b: F.struct(F.col("i").cast("long").alias("pos"), F.col("base").alias("ref"), b.alias("alt")))
    ins = F.transform(F.filter(bases, lambda b: b != F.col("base")), lambda b: F.struct(F.col("i").cast("long").alias("pos"), F.col("base").alias("ref"), F.concat("base", b).alias("alt")))
    gone = F.filter(F.array(F.struct(F.col("i").cast("long").alias("pos"), F.concat("base", "next").alias("ref"), F.col("base").alias("alt"))), lambda _: (F.col("next") != "") & (F.col("next") != F.col("base")))
    return at.select("contig", F.explode(F.concat(subs, ins, gone)).alias("e")).select("contig", "e.*")


def expand_indels(variants: DataFrame, next_base: Column) -> DataFrame:
    """An insertion grows by each base, a deletion by the next reference base; others give nothing."""
    bases = F.array(*map(F.lit, "ACGT"))
    longer = F.transform(bases, lambda b: F.struct(F.col("ref").alias("ref"), F.concat("alt", b).alias("alt")))
    deeper = F.array(F.struct(F.concat("ref", next_base).alias("ref"), F.col("alt").alias("alt")))
    grown = F.when(F.length("alt") > F.length("ref"), longer).when(F.length("alt") < F.length("ref"), deeper)
    return variants.select("contig", "pos", F.explode(grown).alias("e")).select("contig", "pos", "e.ref", "e.alt")


def apply_substitutions(ref: DataFrame, variants: DataFrame) -> DataFrame:
    """Each contig with its substitutions, where the reference base is the variant's; of several at one place the least alt.
    Variants are gathered by contig (changes, not bases) and laid into the sequence in one pass."""
    snp = variants.filter((F.length("ref") == 1) & (F.length("alt") == 1)).groupBy("contig", "pos", "ref").agg(F.min("alt").alias("alt"))
    held = snp.join(ref, "contig").filter(F.expr("substring(seq, cast(pos as int) + 1, 1)") == F.col("ref")).groupBy("contig").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "alt"))).alias("changes"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate("changes", start, lambda a, v: F.struct((v["pos"] + 1).alias("at"), F.concat(a["out"], F.substring("seq", a["at"] + 1, v["pos"] - a["at"]), v["alt"]).alias("out")))
    joined = ref.join(held, "contig", "left").withColumn("f", folded)
    whole = F.when(F.col("changes").isNull(), F.col("seq")).otherwise(F.concat("f.out", F.substring("seq", F.col("f.at") + 1, F.length("seq"))))
    return joined.select("contig", whole.alias("seq"), F.coalesce(F.size("changes"), F.lit(0)).alias("n_applied"))


def context(variants: DataFrame, ref: DataFrame, flank: int = 5) -> DataFrame:
    """The reference around each variant, cut at the contig's ends."""
    start = F.greatest(F.col("pos") - flank, F.lit(0)).cast("int")
    end = F.least(F.col("pos") + F.length("ref") + flank, F.length("seq")).cast("int")
    j = variants.join(ref, "contig").filter(F.col("pos") < F.length("seq"))
    return j.select(*KEY, F.substring("seq", start + 1, end - start).alias("context"))


def subsets(df: DataFrame, n: str, r: str) -> DataFrame:
    """All r-subsets of 0..n-1 as arrays, by counting through the bits of n; n is small (a bounded group of variants)."""
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {n}) - 1")), lambda m: F.bit_count(m) == F.col(r))
    bits = lambda m: F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return df.select(n, r, F.explode(masks).alias("m")).select(n, r, bits(F.col("m")).alias("items"))


def multisets(df: DataFrame, n: str, r: int) -> DataFrame:
    """All ascending r-tuples of 0..n-1 with repeats."""
    out = df.select(n, F.array().cast("array<int>").alias("items"))
    for _ in range(r):
        low = F.coalesce(F.try_element_at("items", F.lit(-1)), F.lit(0))
        out = out.select(n, "items", F.explode(F.sequence(low, F.col(n) - 1)).alias("x")).select(n, F.array_append("items", F.col("x")).alias("items"))
    return out


def logsum_by(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """ln of the summed exponentials of a group's scores: partial sums need the largest, so two aggregations by one key."""
    most = scores.groupBy(*by).agg(F.max(score).alias("_most"))
    return scores.join(most, by).groupBy(*by).agg((F.max("_most") + F.ln(F.sum(F.exp(F.col(score) - F.col("_most"))))).alias("logsum"))


def mixture_by(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The log of the mean likelihood of a group's forms, such as a sequence's modified ones."""
    most = scores.groupBy(*by).agg(F.max(score).alias("_most"))
    total = F.ln(F.sum(F.exp(F.col(score) - F.col("_most")))) - F.ln(F.count("*"))
    return scores.join(most, by).groupBy(*by).agg((F.max("_most") + total).alias("mixture"))


def thresholded(scores: DataFrame, by: list[str], order: str, score: str = "score", threshold: float = 100.0) -> DataFrame:
    """A group's score summed read by read until its size reaches the threshold; later reads don't count."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.withColumn("_sum", F.sum(score).over(w)).withColumn("_i", F.count("*").over(w))
    met = F.abs("_sum") >= threshold
    rank = F.when(met, -F.col("_i"))
    return run.groupBy(*by).agg(F.coalesce(F.max_by("_sum", rank), F.max_by("_sum", "_i")).alias("score"), F.coalesce(F.min(F.when(met, F.col("_i"))), F.max("_i")).alias("n_reads"))


def sub_haplotype(ref_seq: Column, changes: Column, start: Column, end: Column) -> Column:
    """A haplotype between two reference positions, both included, as a struct start_pos, end_pos, seq. changes: its variants in order of
    position, an array of structs pos, ref, alt that don't overlap. A bound inside a change moves out of it: to the base before
    and to the base behind. Null where there is none."""
    size = F.length(ref_seq)
    past = lambda v: v["pos"] + F.length(v["ref"])
    inside = lambda a, v: (a >= v["pos"]) & (a < past(v))
    a = F.aggregate(F.reverse(changes), start.cast("long"), lambda a, v: F.when(inside(a, v), v["pos"] - 1).otherwise(a).cast("long"))
    b = F.aggregate(changes, end.cast("long"), lambda b, v: F.when(inside(b, v), past(v)).otherwise(b).cast("long"))

    def cut(a, b):
        step = F.struct(a.alias("at"), F.lit("").alias("out"))
        own = F.filter(changes, lambda v: (v["pos"] >= a) & (v["pos"] <= b))
        f = F.aggregate(own, step, lambda s, v: F.struct(past(v).cast("long").alias("at"), F.concat(s["out"], F.substring(ref_seq, (s["at"] + 1).cast("int"), (v["pos"] - s["at"]).cast("int")), v["alt"]).alias("out")))
        return F.struct(a.alias("start_pos"), b.alias("end_pos"), F.concat(f["out"], F.substring(ref_seq, (f["at"] + 1).cast("int"), (b + 1 - f["at"]).cast("int"))).alias("seq"))

    return F.when((a >= 0) & (b < size) & (a <= b), cut(a, b))


def product(lists: list[Column], *keep: str):
    """Selects every choice of one item from each list, first lists first: a function of a DataFrame with columns keep, choice."""

    def of(df: DataFrame) -> DataFrame:
        out = df.select(*keep, *[x.alias(f"_l{i}") for i, x in enumerate(lists)])
        for i in range(len(lists)):
            out = out.withColumn(f"_x{i}", F.explode(f"_l{i}"))
        return out.select(*keep, F.array(*[f"_x{i}" for i in range(len(lists))]).alias("choice"))

    return of


def support(scores: DataFrame, read: list[str], choice: str, score: str = "score") -> DataFrame:
    """Expected reads for each choice, from each read's posterior over them."""
    w = Window.partitionBy(*read)
    most = F.max(score).over(w)
    df = scores.withColumn("_most", most).withColumn("_p", F.exp(F.col(score) - F.col("_most")) / F.sum(F.exp(F.col(score) - F.col("_most"))).over(w))
    return df.groupBy(choice).agg(F.sum("_p").alias("support"), F.count("*").alias("n"))


def genotype(scores: DataFrame, site: str = "site", read: str = "read_id", least_gain: float = 20.0) -> DataFrame:
    """Diploid call of each site from reads' scores of both alleles (s0 of the reference, s1): for 0, 1 or 2 copies of the
    alternative, the sum over reads of ln of the mean likelihood; a call needs least_gain over the reference."""
    a, b = F.col("s0"), F.col("s1")
    het = F.greatest(a, b) + F.ln(1 + F.exp(-F.abs(a - b))) - F.ln(F.lit(2.0))
    g = scores.groupBy(site).agg(F.sum(a).alias("g0"), F.sum(het).alias("g1"), F.sum(b).alias("g2"), F.count("*").alias("n_reads"))
    best = F.when((F.col("g2") > F.col("g1")) & (F.col("g2") > F.col("g0")), 2).when(F.col("g1") > F.col("g0"), 1).otherwise(0)
    top = F.greatest("g0", "g1", "g2")
    called = F.when(top - F.col("g0") >= least_gain, best).otherwise(0)
    return g.select(site, "n_reads", (top - F.col("g0")).alias("gain"), called.alias("n_alt"), genotype_text(called, 2).alias("gt"))


def genotype_text(n_alt: Column, ploidy: int) -> Column:
    return F.array_join(F.concat(F.array_repeat(F.lit("0"), F.lit(ploidy) - n_alt), F.array_repeat(F.lit("1"), n_alt.cast("int"))), "/")


def phase(scores: DataFrame, most: float = 30.0) -> DataFrame:
    """The likelier allele of each read at each site (read_id, site, s0, s1), with the quality of that choice."""
    wrong = 1 / (1 + F.exp(F.abs(F.col("s1") - F.col("s0"))))
    q = F.least(F.lit(most), -10 * F.log10(wrong))
    return scores.select("read_id", "site", F.when(F.col("s1") > F.col("s0"), 1).otherwise(0).alias("allele"), q.alias("quality"))


def edit_counts(variants: DataFrame) -> DataFrame:
    """Substitutions, insertions and deletions of each contig."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    a, b = F.length("ref"), F.length("alt")
    return variants.groupBy("contig").agg(n(a == b).alias("subs"), n(a < b).alias("ins"), n(a > b).alias("dels"))


def matching(variants: DataFrame, ref: DataFrame) -> DataFrame:
    """Variants whose reference bases are those of the contig."""
    j = variants.join(ref, "contig")
    return j.filter(F.substring("seq", (F.col("pos") + 1).cast("int"), F.length("ref")) == F.col("ref")).select(*KEY)


def hard_support(scores: DataFrame, read: list[str], choice: str, score: str = "score") -> DataFrame:
    """How many reads score each choice best; of equals the first by name."""
    best = scores.groupBy(*read).agg(F.max(score).alias("_s"))
    top = scores.join(best, read).filter(F.col(score) == F.col("_s")).groupBy(*read).agg(F.min(choice).alias(choice))
    return top.groupBy(choice).agg(F.count("*").alias("n"))


def apply_variants(ref: DataFrame, variants: DataFrame) -> DataFrame:
    """Each contig with its variants of any length, in order of position; one that overlaps an earlier one, or whose
    reference bases aren't the contig's, is left out and counted."""
    v = variants.filter(F.length("ref") > 0).groupBy("contig").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "ref", "alt")))).alias("changes"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(a, v):
        ok = (v["pos"] >= a["at"]) & (F.substring("seq", v["pos"] + 1, F.length(v["ref"])) == v["ref"])
        return F.when(ok, F.struct((v["pos"] + F.length(v["ref"])).alias("at"), F.concat(a["out"], F.substring("seq", a["at"] + 1, v["pos"] - a["at"]), v["alt"]).alias("out"), (a["n"] + 1).alias("n"))).otherwise(a)

    j = ref.join(v, "contig", "left").withColumn("f", F.aggregate(F.coalesce("changes", F.expr("cast(array() as array<struct<pos: int, ref: string, alt: string>>)")), start, step))
    return j.select("contig", F.concat("f.out", F.substring("seq", F.col("f.at") + 1, F.length("seq"))).alias("seq"), F.col("f.n").alias("n_applied"), (F.coalesce(F.size("changes"), F.lit(0)) - F.col("f.n")).alias("n_skipped"))


def methylated_alternatives(seq: Column, alphabets: list[str]) -> Column:
    """The sequence and its modified forms, without repeats."""
    from ..functions.sequence import methylate

    return F.array_distinct(F.array(seq, *[methylate(seq, a) for a in alphabets]))
