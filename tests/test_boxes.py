"""Box joins by cells against all pairs, and a crowded frame that no task squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectory.functions import columns as C
from inspectory.operators import corpus

BOX = "frame_id long, box_id long, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rng, n, frames, first, least=0.0, most=4.0):
    x, y = rng.uniform(-200, 800, n), rng.uniform(-200, 800, n)
    w, h = 10 ** rng.uniform(least, most, (2, n)) / 10
    whole = rng.random(n) < 0.3  # whole numbers, so that edges touch
    rows = [(int(f), first + i, *(float(round(v)) if r else float(v) for v in own)) for i, (f, r, own) in enumerate(zip(rng.integers(0, frames, n), whole, zip(x, y, x + w, y + h)))]
    return spark.createDataFrame(rows, BOX)


@pytest.mark.parametrize("reach", [0.0, 30.0])
def test_near_pairs_equal_all_pairs(spark, reach):
    rng = np.random.default_rng(3)
    a, b = boxes(spark, rng, 400, 3, 0), boxes(spark, rng, 400, 3, 1000)
    odd = spark.createDataFrame([(0, 5000, None, 0.0, 5.0, 5.0), (0, 5001, float("nan"), 0.0, 5.0, 5.0), (0, 5002, 0.0, 0.0, 0.0, 0.0), (0, 5003, 4.0, 4.0, 4.0, 4.0), (0, 5004, 50.0, 50.0, 20.0, 20.0), (7, 5005, 0.0, 0.0, 9.0, 9.0)], BOX)
    a, b = a.unionAll(odd), b.unionAll(odd)
    tests = [C.intersects("a_", "b_"), C.centre_inside("b_", "a_")] if not reach else [C.gap("a_", "b_") <= reach]
    every, near = corpus.pairs_in_frame(a, b).where("a_x0 is not null and b_x0 is not null and not isnan(a_x0) and not isnan(b_x0)"), corpus.near_pairs(a, b, reach)
    for test in tests:
        want = sorted(tuple(r) for r in every.where(test).select("a_box_id", "b_box_id").collect())
        got = sorted(tuple(r) for r in near.where(test).select("a_box_id", "b_box_id").collect())
        assert got == want and len(want) > 20


def test_metrics(spark):
    rng = np.random.default_rng(5)
    a, b = boxes(spark, rng, 300, 2, 0, 2.0, 3.5), boxes(spark, rng, 300, 2, 1000, 2.0, 3.5)
    for metric, t in (("intersect", 0.0), ("iou", 0.1), ("iou", 0.0), ("overlap_smaller", 0.2), ("gap", 25.0), ("gap", 0.0)):
        want = corpus.encroaching(corpus.pairs_in_frame(a, b), metric, t).select("a_box_id", "b_box_id").collect()
        got = corpus.encroachments(a, b, metric, t).select("a_box_id", "b_box_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    with pytest.raises(ValueError):
        corpus.encroachments(a, b, "area")


def test_empty_sets(spark):
    none = spark.createDataFrame([], BOX)
    one = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert corpus.near_pairs(none, one).count() == corpus.near_pairs(one, none, 5.0).count() == 0


def test_crowded_frame(spark):
    """One frame with 100,000 boxes a side (10 billion pairs) and a box over all of it: candidates stay near the results."""
    n = 100_000
    grid = spark.range(n).select(F.lit(1).cast("long").alias("frame_id"), F.col("id").alias("box_id"), (F.col("id") % 400 * 10.0).alias("x0"), (F.floor(F.col("id") / 400) * 10.0).alias("y0"))
    small = grid.select("*", (F.col("x0") + 4).alias("x1"), (F.col("y0") + 4).alias("y1"))
    moved = grid.select("frame_id", "box_id", (F.col("x0") + 2).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") + 6).alias("x1"), (F.col("y0") + 6).alias("y1"))
    large = spark.createDataFrame([(1, n, -5.0, -5.0, 5000.0, 5000.0)], BOX)
    pairs = corpus.encroachments(small.unionByName(large), moved, "intersect")
    assert pairs.count() == 2 * n and pairs.where(f"a_box_id < {n}").where("a_box_id <> b_box_id").isEmpty()


def test_encroached_tells_boxes_apart_that_share_an_id(spark):
    """All variants at once against all pairs; boxes that share an id are judged one by one, and frames without partners or with odd corners stay."""
    rng = np.random.default_rng(11)
    a, b = boxes(spark, rng, 300, 4, 0, 2.0, 3.5), boxes(spark, rng, 300, 4, 1000, 2.0, 3.5)
    a = a.unionAll(boxes(spark, rng, 40, 30, 2000, 2.0, 3.5)).withColumn("box_id", F.col("box_id") % 150)
    a = a.unionAll(a.where("box_id = 3")).unionAll(spark.createDataFrame([(0, 3, None, 0.0, 5.0, 5.0), (99, 4, 0.0, 0.0, 9.0, 9.0)], BOX))
    for variants in ((("intersect", 0.0), ("iou", 0.05), ("overlap_smaller", 0.1), ("gap", 30.0)),):
        got = sorted(map(tuple, corpus.encroached(a, b, variants).collect()))
        marked = a.withColumn("box_id", F.struct(F.monotonically_increasing_id().alias("row"), "box_id")).localCheckpoint()
        want = []
        for metric, t in variants:
            hit = {r.a_box_id.row for r in corpus.encroaching(corpus.pairs_in_frame(marked, b), metric, t).collect() if r.a_x0 is not None}
            want += [(metric, r.box_id.box_id, r.box_id.row in hit) for r in marked.collect()]
        assert got == sorted(want) and {r[2] for r in got} == {True, False}
