"""Memory banks that grow without a refit: a merge-and-reduce tree of weighted covers.

New patches of a class are dealt into leaves of at most ``leaf_rows``; each leaf is covered by at most ``size`` of its patches,
whose weights count the patches they stand for. Covers 2 i and 2 i + 1 of a level are merged and reduced to one cover of the
next level, so a class of n leaves holds at most log2(n) + 1 covers, and an extension reads the new patches and the covers it
merges, never the patches seen before. ``reach`` is how far any patch that a row stands for can be from it. Every reduction
is a farthest-first cover, whose radius is at most twice the best one's, so at level h the reach is at most 2 (h + 1) times
the radius of the best cover of ``size`` patches, and so of any refit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import written
from .ranks import numbered, small
from .scoring import greedy_cover


def _schema(fresh: DataFrame, key: str) -> str:
    kinds = dict(fresh.dtypes)
    return f"`{key}` {kinds[key]}, cover long, level int, frame_id {kinds['frame_id']}, patch_id {kinds['patch_id']}, pvec array<double>, weight long, reach double"


def reduced(rows: DataFrame, size: int, key: str) -> DataFrame:
    """One cover of ``size`` rows at most for each (class, level, cover): weights are added up, reaches carried on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_id", "patch_id"], kind="stable").reset_index(drop=True)
        if len(pdf) <= size:
            return pdf
        x = np.stack(pdf.pvec.to_numpy())
        taken = greedy_cover(x, size)
        own, far = np.zeros(len(x), int), np.full(len(x), np.inf)
        for n, i in enumerate(taken):
            d = np.linalg.norm(x - x[i], axis=1)
            own, far = np.where(d < far, n, own), np.minimum(far, d)
        reach = np.zeros(len(taken))
        np.maximum.at(reach, own, far + pdf.reach.to_numpy())
        return pdf.iloc[taken].assign(weight=np.bincount(own, pdf.weight.to_numpy(), len(taken)).astype("int64"), reach=reach)

    return rows.groupBy(key, "level", "cover").applyInPandas(run, rows.schema)


def extended(tree: DataFrame | None, fresh: DataFrame, size: int, leaf_rows: int = 4096, key: str = "asset_class") -> DataFrame:
    """The tree with new patches (class, frame_id, patch_id, pvec) in it; without a tree, a new one.

    Patches without a class or vector are left out; a patch that is given again counts again. A task holds one leaf or two
    covers, whatever the size of a class, and each level is one shuffle of its covers alone."""
    schema = _schema(fresh, key)
    names = StructType.fromDDL(schema).names
    tree = fresh.sparkSession.createDataFrame([], schema) if tree is None else tree
    first = tree.groupBy(key).agg(F.max(F.expr("shiftleft(cover + 1, level)")).alias("first"))
    own = fresh.where(F.col(key).isNotNull() & F.col("pvec").isNotNull()).select(key, "frame_id", "patch_id", F.col("pvec").cast("array<double>").alias("pvec"))
    placed = numbered(own, [key], ["frame_id", "patch_id"], "place").join(small(written(first, "first-leaves")), key, "left")
    leaf = F.coalesce("first", F.lit(0)) + F.floor((F.col("place") - 1) / leaf_rows)
    leaves = placed.select(key, leaf.cast("long").alias("cover"), F.lit(0).alias("level"), "frame_id", "patch_id", "pvec", F.lit(1).cast("long").alias("weight"), F.lit(0.0).alias("reach"))
    risen, kept, level = written(reduced(leaves, size, key), "covers"), [], 0
    while not risen.isEmpty():
        here = tree.where(F.col("level") == level).unionByName(risen).withColumn("parent", F.shiftright("cover", 1))
        children = written(here.groupBy(key, "parent").agg(F.count_distinct("cover").alias("children")), "children")
        here = here.join(small(children), [key, "parent"])
        kept.append(here.where("children < 2").select(*names))
        merged = here.where("children = 2").withColumn("cover", F.col("parent")).withColumn("level", F.lit(level + 1)).select(*names)
        risen, level = written(reduced(merged, size, key), "covers"), level + 1
    out = tree.where(F.col("level") >= level).select(*names)
    for part in kept:
        out = out.unionAll(part)
    return written(out, "bank-tree")


def bank(tree: DataFrame, key: str = "asset_class") -> DataFrame:
    """The tree's rows as a memory bank to search."""
    return tree.select("frame_id", key, "patch_id", "pvec")
