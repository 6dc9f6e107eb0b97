"""Re-estimation of a k-mer model: bounded samples of events, mixtures, rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hmm


def sample_events(events: DataFrame, by: str = "kmer", most: int = 1000) -> DataFrame:
    """At most so many events of each k-mer, by a hash: the same ones whatever the order. The limit is the operator's own."""
    w = Window.partitionBy(by).orderBy("_h", *[c for c in events.columns if c != by])
    return events.withColumn("_h", F.xxhash64(*events.columns)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_h", "_n")


def mixtures(events: DataFrame, least: int = 100, most: int = 1000) -> DataFrame:
    """Of each k-mer with enough events, the level fitted by a mixture that starts at the model's own level; k-mers with a
    modified base get a second component at the same place, of small weight. events: kmer, x, read_var, level_mean,
    level_stdv."""

    def group(t: pa.Table) -> pa.Table:
        if t.num_rows < least:
            return pa.table({"kmer": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "trained_mean": pa.array([], pa.float64()), "trained_stdv": pa.array([], pa.float64())})
        col = lambda n: t.column(n).to_numpy().astype(float)
        kmer = t.column("kmer")[0].as_py()
        m, s = col("level_mean")[0], col("level_stdv")[0]
        two = "M" in kmer
        w, means, stdvs = hmm.train_mixture(col("x"), col("read_var"), np.array([0.95, 0.05]) if two else np.ones(1), np.array([m, m + s]) if two else np.array([m]), np.full(2 if two else 1, s))
        return pa.table({"kmer": [kmer], "n": [t.num_rows], "trained_mean": [float(means[0])], "trained_stdv": [float(stdvs[0])]})

    return sample_events(events, most=most).groupBy("kmer").applyInArrow(group, "kmer string, n long, trained_mean double, trained_stdv double")


def rounds(events: DataFrame, model: DataFrame, n: int = 5, least: int = 100) -> DataFrame:
    """Rounds of fitting, each from the model that the last one gave; k-mers that weren't fitted keep their state. Models have
    a row for each k-mer; each round's is written, so lineage stays short."""
    for _ in range(n):
        fit = mixtures(events.join(F.broadcast(model.select("kmer", "level_mean", "level_stdv")), "kmer"), least)
        model = model.join(F.broadcast(fit), "kmer", "left").select("kmer", F.coalesce("trained_mean", "level_mean").alias("level_mean"), F.coalesce("trained_stdv", "level_stdv").alias("level_stdv"))
        from ..sources.tables import stored

        model = stored(model, "model")
    return model
