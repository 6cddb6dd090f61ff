"""Drift of raw scores: histograms of a model's periods against its first ones, and a sequential rule that marks it stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BASE, WIDTH = 6, 0.05
ALLOWED, ALARM = 1.36, 2.0  # a distance that chance exceeds in 5 % of periods; the excess over it, added up, that marks a model stale


def score_sketch(scores: DataFrame, width: float = WIDTH) -> DataFrame:
    """(model, period, bin, n): counts of scores by bins of a fixed width. Sketches of parts add up by ``merged``. Rows without
    a model, a period or a finite score are left out. Scores of a wide range are best given as logarithms."""
    known = scores.where(F.col("model").isNotNull() & F.col("period").isNotNull() & (F.abs("score") < float("inf")))
    return known.groupBy("model", "period", F.floor(F.col("score") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of several, such as the day's and what is stored."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("model", "period", "bin").agg(F.sum("n").alias("n"))


def distances(sketch: DataFrame, base: int = BASE) -> DataFrame:
    """(model, period, n, distance, z) of each period after a model's first ``base`` ones: the greatest difference of the two
    distribution functions over all bins, and the same in units of what the two counts let chance do.

    Works on the sketch alone: a model's periods times its bins, whatever the number of scores."""
    sketch = written(sketch, "sketch")
    ranked = sketch.withColumn("turn", F.dense_rank().over(Window.partitionBy("model").orderBy("period")))
    first = ranked.where(F.col("turn") <= base).groupBy("model", "bin").agg(F.sum("n").alias("base_n"))
    later = ranked.where(F.col("turn") > base).select("model", "period", "bin", "n")
    places = later.select("model", "period").distinct().join(ranked.select("model", "bin").distinct().hint("merge"), "model")
    both = places.join(later.hint("merge"), ["model", "period", "bin"], "left").join(first.hint("merge"), ["model", "bin"], "left").na.fill(0, ["n", "base_n"])
    whole = Window.partitionBy("model", "period")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: F.sum(c).over(below) / F.sum(c).over(whole)
    gap = both.withColumn("gap", F.abs(share("n") - share("base_n")))
    out = gap.groupBy("model", "period").agg(F.sum("n").alias("n"), F.sum("base_n").alias("base_n"), F.max("gap").alias("distance"))
    n, m = F.col("n").cast("double"), F.col("base_n").cast("double")
    return out.withColumn("z", F.col("distance") * F.sqrt(n * m / (n + m))).drop("base_n")


def drift(sketch: DataFrame, base: int = BASE, allowed: float = ALLOWED, alarm: float = ALARM) -> DataFrame:
    """Distances with ``excess`` (the sum of z - allowed since it was last lowest, never below zero) and ``stale``: whether it was
    above ``alarm`` in this period or an earlier one. One bad period is forgiven, some in a row or a lasting small shift are not."""
    so_far = Window.partitionBy("model").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    out = distances(sketch, base).withColumn("_sum", F.sum(F.col("z") - allowed).over(so_far))
    out = out.withColumn("excess", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(so_far))).drop("_sum")
    return out.withColumn("stale", F.max(F.col("excess") > alarm).over(so_far))


def stale_models(drifted: DataFrame) -> DataFrame:
    """(model, periods, since): every model that was tested, with the first period in which it was stale, else null."""
    return drifted.groupBy("model").agg(F.count("*").alias("periods"), F.min(F.when(F.col("stale"), F.col("period"))).alias("since"))
