"""Connected components of a link table, by alternating star contraction.

Links are first contracted inside each partition; then each round points every node's larger neighbours at its least
neighbour, and then its smaller ones, until only stars are left. Rounds are written to the shared folder, so lineage stays
short. The number of rounds grows with the logarithm of the longest chain. Least neighbours are written before they are
joined, so that Spark can split the edges of a node that has very many.

Links of a node with itself and repeated links change nothing; a null end is no link; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written


def forest(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each node's least reachable node."""
    up: dict[int, int] = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _contract(links: DataFrame) -> DataFrame:
    def make():
        def each(batch):
            own = [(x, r) for x, r in forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))).items() if x != r]
            yield {"a": [r for _, r in own], "b": [x for x, _ in own]}

        return each

    return arrow_map(links, "a long, b long", make)


def _stars(edges: DataFrame) -> bool:
    """True if every node hangs on one other or has others on it, never both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("down")).where("up > 1 or (up > 0 and down = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); component is the least node reachable."""
    edges = written(_contract(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")).distinct(), "links")
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m")), "least")
        small = large.withColumnRenamed("b", "x").join(least.hint("merge"), "x")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("x", "a")).alias("b")).where("a <> b").distinct()
        edges = written(small, "star")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
