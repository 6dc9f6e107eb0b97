"""Range, as-of and lower-bound joins as equi-joins and window frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, bin_size: int = 64) -> DataFrame:
    """Pairs of a point and an interval (both ends included) that holds it. Intervals are laid into the bins they touch, so
    the join is on keys and bin. A hot bin is split by skew handling, as both sides are shuffled by the join itself."""
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    return p.join(i, [*on, "_bin"]).filter((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_bin")


def nearest(slots: DataFrame, by: list[str], order: str, value: str, reach: int = 1000) -> DataFrame:
    """For each slot the value at or before it, less than reach away; else the next one less than reach after it. The first
    slot is found from others never backwards, the last never forwards: the search stops before them."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    own = F.col(value)
    first, last = F.min(order).over(whole), F.max(order).over(whole)
    df = slots.withColumn("_back", F.when(F.col(order) > first, own)).withColumn("_ahead", F.when(F.col(order) < last, own))
    back = F.last("_back", ignorenulls=True).over(w.rangeBetween(-(reach - 1), 0))
    ahead = F.first("_ahead", ignorenulls=True).over(w.rangeBetween(0, reach - 1))
    return df.withColumn("nearest", F.coalesce(own, back, ahead)).drop("_back", "_ahead")


def lower_bound(pairs: DataFrame, windows: DataFrame, on: list[str], position: str, value: str, start: str, end: str) -> DataFrame:
    """For each window the value of the first pair at or after its start, and of the first at or after its end; bounded if
    both are there and the pairs begin at or before the start. Windows and pairs meet through one sort by position: each
    window's bounds are rows among the pairs, so nothing is multiplied."""
    low = windows.select("*", F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit("a").alias("k")), F.struct(F.col(end).alias("p"), F.lit("b").alias("k")))).alias("_x"))
    asked = low.select(*on, F.col("_x.p").alias("p"), F.lit(0).alias("is_pair"), F.lit(None).cast("long").alias("v"), F.col("_x.k").alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    have = pairs.groupBy(*on, position).agg(F.min(value).alias("v")).select(*on, F.col(position).alias("p"), F.lit(1).alias("is_pair"), F.col("v").cast("long").alias("v"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    w = Window.partitionBy(*on).orderBy("p", "is_pair")
    near = asked.unionAll(have).withColumn("at", F.first("v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = near.withColumn("least", F.min(F.when(F.col("is_pair") == 1, F.col("p"))).over(Window.partitionBy(*on)))
    out = near.filter("is_pair = 0").groupBy(*on, "s", "e").agg(F.max(F.when(F.col("k") == "a", F.col("at"))).alias("first_value"), F.max(F.when(F.col("k") == "b", F.col("at"))).alias("last_value"), F.max("least").alias("least"))
    bounded = F.coalesce(F.col("first_value").isNotNull() & F.col("last_value").isNotNull() & (F.col("least") <= F.col("s")), F.lit(False))
    return out.select(*on, F.col("s").alias(start), F.col("e").alias(end), "first_value", "last_value", bounded.alias("bounded"))
