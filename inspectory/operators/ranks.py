"""Places, prefix sums and exact quantiles of large groups.

Rows are dealt in ranges of (group, value), each range sums for itself, and the ranges' sums are carried over, so no task
holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

FEW = 100_000
#: Bytes of values that are broadcast at most.
LIGHT = 32 << 20


def row_bytes(df: DataFrame) -> F.Column:
    """Bytes of a row's values: eight a number, a string's or array's own length, other nested values by their JSON."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array<double>", "array<float>", "array<bigint>", "array<int>"):
            total += F.coalesce(8 * F.size(c), F.lit(0))
        elif "<" in kind:
            total += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total += 8
    return total


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast while its rows and their bytes are few; merge-joined beyond."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= FEW and size <= LIGHT else df.hint("merge")


def same_keys(keys: list[str], other: str = "_") -> F.Column:
    """Equal keys, null with null; the other side's have a prefix."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(other + k))
    return same


def with_group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds how many rows the group has; null keys are a group too. Counts are added up before they meet the rows."""
    sizes = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias(name))
    return df.join(small(written(sizes, "group-sizes")), same_keys(keys)).drop(*(f"_{k}" for k in keys))


def carried(dealt: DataFrame, keys: list[str], sums: dict[str, F.Column]) -> DataFrame:
    """Rows of written ranges with, for each name, the sum over their group's rows in earlier ranges. Null keys are a group too."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "part").agg(*(c.alias(n) for n, c in sums.items()))
    before = totals.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "part")), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums))
    return dealt.join(small(written(before, "range-sums")), (F.col("part") == F.col("_part")) & same_keys(keys)).drop("_part", *(f"_{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, few: int = FEW) -> DataFrame:
    """Adds the row's place in its group, from 1 in this order; the order tells all rows of a group apart. Up to ``few`` rows are numbered in one window."""
    df = written(df, "unnumbered")
    if df.count() <= few:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    dealt = written(df.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    return carried(dealt, keys, {"_n": F.count("*")}).withColumn(name, inside + F.col("_n")).drop("part", "_n")


def with_sums_below(df: DataFrame, key: str, value: str, sums: tuple[str, ...], few: int = FEW) -> DataFrame:
    """Adds below_<s> for each of ``sums``: its sum over the group's rows of lesser value. (key, value) is unique; null values are dropped.

    The rows are written before they are dealt, as dealing reads them twice; up to ``few`` rows of all groups are summed in one window."""
    df = written(df.where(F.col(value).isNotNull()), "values")
    if df.count() <= few:
        below = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"below_{s}": F.coalesce(F.sum(s).over(below), F.lit(0)) for s in sums})
    dealt = written(df.repartitionByRange(key, value).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = carried(dealt, [key], {f"before_{s}": F.sum(s) for s in sums})
    out = out.withColumns({f"below_{s}": F.col(f"before_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return out.drop("part", *(f"before_{s}" for s in sums))


def exact_quantiles(df: DataFrame, key: str, value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """(key, one column for each name) by linear interpolation between the two nearest ranks."""
    ranked = written(with_sums_below(df.groupBy(key, value).agg(F.count("*").alias("n")), key, value, ("n",), few), "ranks")
    ranked = ranked.join(small(written(ranked.groupBy(key).agg(F.sum("n").alias("total")), "totals")), key)
    at = lambda r: F.max(F.when((F.col("below_n") <= r) & (r < F.col("below_n") + F.col("n")), F.col(value)))
    place = {c: q * (F.col("total") - 1) for c, q in wanted.items()}
    ends = [x for c, r in place.items() for x in (at(F.floor(r)).alias(f"lo_{c}"), at(F.ceil(r)).alias(f"hi_{c}"), F.first(r - F.floor(r)).alias(f"part_{c}"))]
    out = ranked.groupBy(key).agg(*ends)
    return out.select(key, *((F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * F.col(f"part_{c}")).alias(c) for c in wanted))
