"""A bank that grows by merging covers against a refit of all patches."""

import numpy as np
from pyspark.sql import functions as F

from inspectory.operators import bank_tree as B
from inspectory.operators.scoring import greedy_cover

SCHEMA = "frame_id long, asset_class string, patch_id int, pvec array<double>"


def rows(lo, hi, classes=("a", "b"), seed=1):
    rng = np.random.default_rng(seed + lo)
    return [(i, classes[i % len(classes)], int(j), rng.normal(size=4).tolist()) for i in range(lo, hi) for j in range(2)]


def radius(x, bank):
    return max(min(np.linalg.norm(v - b) for b in bank) for v in x)


def test_grows_like_a_refit(spark):
    parts = [rows(0, 150), rows(150, 220), rows(220, 221), rows(221, 400)]
    tree = None
    for part in parts:
        tree = B.extended(tree, spark.createDataFrame(part, SCHEMA), size=12, leaf_rows=20)
    got, every = tree.collect(), [r for part in parts for r in part]
    vectors = {(f, p): v for f, _, p, v in every}
    assert all(vectors[r.frame_id, r.patch_id] == r.pvec for r in got)
    for c in ("a", "b"):
        own = [r for r in got if r.asset_class == c]
        x = np.array([v for _, k, _, v in every if k == c])
        assert sum(r.weight for r in own) == len(x)
        covers = {(r.level, r.cover) for r in own}
        assert len({level for level, _ in covers}) == len(covers)  # one cover a level: no two were left unmerged
        assert all(sum((r.level, r.cover) == k for r in own) <= 12 for k in covers)
        bank = np.array([r.pvec for r in own])
        height = max(level for level, _ in covers)
        far = radius(x, bank)
        refit = radius(x, x[greedy_cover(x, 12)])
        assert height >= 3 and far <= max(r.reach for r in own) + 1e-9 and max(r.reach for r in own) <= 2 * (height + 1) * refit
    assert B.bank(tree).columns == ["frame_id", "asset_class", "patch_id", "pvec"]


def test_odd_patches(spark):
    odd = [(1, None, 0, [1.0]), (2, "a", 0, None), (3, "a", 0, [0.0]), (3, "a", 0, [0.0]), (4, "a", 1, [5.0])]
    tree = B.extended(None, spark.createDataFrame(odd, SCHEMA).withColumn("weight", F.lit("clash")), size=2, leaf_rows=10)
    assert sorted((r.frame_id, r.weight, r.reach) for r in tree.collect()) == [(3, 2, 0.0), (4, 1, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert B.extended(None, empty, 2).count() == 0
    assert sorted(map(tuple, B.extended(tree, empty, 2).collect())) == sorted(map(tuple, tree.collect()))
