"""Drift: distances against plain counting, a planted shift, and scores that were only shuffled."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from inspectory.operators import drift as D

ROW = "model string, period string, score double"


def scores(seed, shift=0.0, slow=0.0, periods=30, n=200):
    r = random.Random(seed)
    return [(f"2024-{p:02d}", r.gauss(1.0, 0.3) + (shift if p >= 18 else 0.0) + slow * max(0, p - 6)) for p in range(periods) for _ in range(n)]


def test_distances_equal_counting(spark):
    rows = [("m", p, s) for p, s in scores(1, 0.2, periods=10, n=80)]
    odd = [("m", None, 1.0), (None, "2024-01", 1.0), ("m", "2024-01", None), ("m", "2024-09", float("nan")), ("m", "2024-09", float("inf")), ("short", "2024-01", 1.0)]
    got = {r.period: r for r in D.distances(D.score_sketch(spark.createDataFrame(rows + odd, ROW))).collect()}
    cells = [(p, int(s // 0.05)) for _, p, s in rows]
    base = sorted(b for p, b in cells if p < "2024-06")
    assert sorted(got) == [f"2024-{p:02d}" for p in range(6, 10)]
    for p, r in got.items():
        own = sorted(b for q, b in cells if q == p)
        want = max(abs(bisect_right(own, b) / len(own) - bisect_right(base, b) / len(base)) for b in own + base)
        assert r.n == 80 and abs(r.distance - want) < 1e-12
        assert abs(r.z - want * (80 * len(base) / (80 + len(base))) ** 0.5) < 1e-9


def test_sketches_of_parts_add_up(spark):
    df = spark.createDataFrame([("m", p, s) for p, s in scores(2, n=50)], ROW).withColumn("part", F.hash("score") % 3)
    parts = [D.score_sketch(df.where(c)) for c in ("part = 0", "part > 0", "part < 0")]
    assert sorted(map(tuple, D.merged(*parts).collect())) == sorted(map(tuple, D.score_sketch(df).collect()))


def test_shift_is_found_and_shuffles_are_not(spark):
    rows = [(m, p, s) for m, own in (("jump", scores(3, 0.15)), ("slow", scores(4, slow=0.02))) for p, s in own]
    for seed in range(20):  # the shifted scores themselves, dealt to the periods anew
        r = random.Random(seed)
        own = scores(3, 0.15)
        dealt = [s for _, s in own]
        r.shuffle(dealt)
        rows += [(f"shuffled-{seed}", p, s) for (p, _), s in zip(own, dealt)]
    got = {r.model: r for r in D.stale_models(D.drift(D.score_sketch(spark.createDataFrame(rows, ROW)))).collect()}
    assert "2024-18" <= got["jump"].since <= "2024-21" and "2024-07" < got["slow"].since <= "2024-18"
    assert [m for m in got if m.startswith("shuffled") and got[m].since] == [] and len(got) == 22 and got["jump"].periods == 24


def test_one_odd_period_is_forgiven(spark):
    rows = [("m", p, s + (0.1 if p == "2024-12" else 0.0)) for p, s in scores(5)]
    out = D.drift(D.score_sketch(spark.createDataFrame(rows, ROW))).collect()
    assert max(out, key=lambda r: r.distance).period == "2024-12" and not any(r.stale for r in out)


def test_empty(spark):
    assert D.stale_models(D.drift(D.score_sketch(spark.createDataFrame([], ROW)))).count() == 0
