"""Fixtures with known results: trends, abstention, corpus order, crops, duplicates, sessions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectory.operators import corpus, findings, routing, scoring
from inspectory.sources import tables
from inspectory.streaming import sessions

# Findings and figures that are known to follow from them.
NOW = datetime(2026, 8, 11, 12)
ROWS = [("insulator", "defect", 0.9, (1, 2, 3, 20)), ("insulator", "nominal", 0.1, (21, 22, 23)), ("corrosion", "defect", 0.9, (20, 21, 22)), ("corrosion", "nominal", 0.1, (23, 1, 2, 3)), ("rail_surface", "unroutable", 0.0, (5,))]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(f"{c}{v}{n}", NOW - timedelta(days=n), c, v, s) for c, v, s, ns in ROWS for n in ns]
    return spark.createDataFrame(rows, "finding_id string, ts timestamp, asset_class string, verdict string, severity double")


def by(df, key="asset_class"):
    return {r[key]: r for r in df.collect()}


def test_trends(golden):
    start, mid = findings.window_of(NOW, 30)
    rates = by(findings.failing_fastest(findings.by_asset_class(golden, start, mid)))
    i, c = rates["insulator"], rates["corrosion"]
    assert (i.inspections, i.defects, i.defect_rate, i.recent_rate, i.acceleration) == (7, 4, 0.5714, 1.0, 0.4286)
    assert (c.inspections, c.defects, c.defect_rate, c.recent_rate, c.acceleration) == (7, 3, 0.4286, 0.0, -0.4286)
    assert list(rates) == ["insulator", "corrosion"]
    assert {r.verdict: r.n for r in findings.verdict_counts(golden, start).collect()} == {"defect": 7, "nominal": 7, "unroutable": 1}
    assert {r.bucket: r.n for r in findings.severity_distribution(golden, start).collect()} == {"0.8-1.0": 7, "0.0-0.2": 7}
    week = by(findings.by_asset_class(golden, *findings.window_of(NOW, 7)))
    assert (week["insulator"].inspections, week["insulator"].defects, week["corrosion"].defects) == (3, 3, 0)


def test_coverage_backfill_and_missing_severity(spark, golden):
    models = spark.createDataFrame([("insulator-v1", "insulator", "seed"), ("corrosion-v1", "corrosion", "seed"), ("rail-v1", "rail_surface", "agent-coldstart")], "name string, asset_class string, created_by string")
    rows = by(findings.registry_coverage(models, golden), "created_by")
    assert {o: r.models for o, r in rows.items()} == {"seed": 2, "agent-coldstart": 1}
    assert {(r.total_models, tuple(r.asset_classes), r.total_inspections) for r in rows.values()} == {(3, ("corrosion", "insulator", "rail_surface"), 15)}
    start, mid = findings.window_of(NOW, 7)
    shifted = golden.withColumn("backfilled", F.col("verdict") == "nominal")
    (r,) = findings.backfill_disclosure(shifted, start).collect()
    assert (r.shifted, r.total, r.fraction) == (3, 7, 0.4286)
    unknown = golden.withColumn("severity", F.lit(None).cast("double"))
    assert {r.mean_severity for r in findings.by_asset_class(unknown, start, mid).collect()} == {0.0} == {r.mean_severity for r in findings.defect_rate_over_time(unknown, start).collect()}


def test_guards(golden):
    for bad in ({"verdict": "maybe"}, {"days": 0}, {"days": 366}, {"limit": 26}, {"k": 0}):
        with pytest.raises(ValueError):
            findings.checked(**bad)
    assert findings.routable(golden.withColumn("verdict", F.lit(None).cast("string"))).count() == 15


def test_abstention(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    centres = [base + 0.35 * rng.normal(size=16) for _ in range(6)]
    rows = [(100 * c + i, [float(x) for x in centres[c] / np.linalg.norm(centres[c]) + rng.normal(size=16) * 0.02], f"class_{c}", f"{i:03d}") for c in range(6) for i in range(60)]
    frames = spark.createDataFrame(rows, "frame_id long, vec array<double>, asset_class string, ord string")
    known = frames.where("asset_class <> 'class_5'")
    models = routing.register_models(known)
    decided = routing.decide(routing.route(frames, models))
    tops = decided.join(frames.select("frame_id", "asset_class"), "frame_id").select(F.col("routing_score").alias("score"), F.col("best_gate").alias("gate"), (F.col("asset_class") != "class_5").alias("registered"))
    rules = by(routing.compare_rules(tops), "rule")
    assert rules["global_0.82"].refused == 0 and rules["per_model_gate"].refused == 60 and rules["per_model_gate"].accepted > 240
    none = routing.decide(routing.route(frames, models.limit(0)))
    assert {r.decision for r in none.collect()} == {"unroutable"}
    angles = [r.angle for r in routing.layout(models).collect()]
    assert len(set(angles)) == 5 and all(0 <= a < 2 * np.pi for a in angles)


def test_interleave(spark):
    rows = [(i, "c", "bent_wire" if i < 30 else "cable_swap", f"{i:03d}") for i in range(32)]
    got = corpus.interleave(spark.createDataFrame(rows, "row_id long, asset_class string, defect string, ord string")).orderBy("place").collect()
    assert len(got) == 32 and {r.defect for r in got[:4]} == {"bent_wire", "cable_swap"}


def test_perceptual(spark):
    rng = np.random.default_rng(1)
    fp = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    for i in range(160):
        x = fp[int(rng.integers(0, len(fp)))]
        for b in rng.integers(0, 63, int(rng.integers(0, 5))):
            x ^= 1 << int(b)
        fp.append(x)
    df = spark.createDataFrame(list(enumerate(fp)), "place long, fp long")
    for d in (-1, 0, 3, 4):
        kept = []
        for i, x in enumerate(fp):
            if d < 0 or all(bin((x ^ fp[j]) & (2**64 - 1)).count("1") > d for j in kept):
                kept.append(i)
        assert sorted(r.place for r in corpus.perceptual_dedupe(df, d).collect()) == kept, d


def test_crops(spark):
    df = spark.createDataFrame([(40, 40, 120, 90, 320, 240), (0, 0, 20, 20, 100, 100)], "x int, y int, w int, h int, fw int, fh int")
    a, b = (r.c for r in df.select(scoring.padded_crop("x", "y", "w", "h", "fw", "fh").alias("c")).collect())
    assert a.right - a.left > 120 and a.left >= 0 and a.right <= 320
    assert (b.left, b.top) == (0, 0) and b.right <= 100 and b.bottom <= 100


def test_regions_and_coreset(spark):
    v = np.zeros((64, 64))
    v[4:12, 4:14], v[40:50, 30:36], v[60, 60] = 0.9, 0.8, 1.0
    cells = spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(64) for x in range(64)], "frame_id long, y int, x int, norm double")
    got = sorted((r.x, r.y, r.w, r.h, r.area, r.peak) for r in scoring.regions(cells).collect())
    assert got == [(4, 4, 10, 8, 80, 0.9), (30, 40, 6, 10, 60, 0.8)]
    assert scoring.kept_regions(scoring.regions(cells)).count() == 2
    p = spark.createDataFrame([(i, "c", j, [float(i % 7), float(j)], "x") for i in range(50) for j in range(4)], "frame_id long, asset_class string, patch_id int, pvec array<double>, ord string")
    bank = scoring.coreset(p, 0.25)
    assert bank.count() == 50 and scoring.patch_distances(p, bank).agg(F.max("distance")).first()[0] == 0


def test_descriptions(spark):
    rows = [('{"component": "clip", "difference_visible": true, "description": "bent"}',), ('{"difference_visible": true, "description": "NO_VISIBLE_DIFFERENCE"}',), ("only prose",), ("  ",), ('{"description": ""}',)]
    got = scoring.normalised_descriptions(spark.createDataFrame(rows, "payload string")).collect()
    assert [(r.component, r.visible, r.rejected) for r in got[:3]] == [("clip", True, False), (None, False, False), (None, True, False)]
    assert got[3].rejected and got[4].rejected


def test_hold(spark):
    rows = [(1, 125.0 * i, 0.001) for i in range(40)] + [(1, 5000.0, 0.5)] + [(1, 5000.0 + 125 * i, 0.001) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "session_id long, ms double, score double")
    assert [r.fired_ms for r in sessions.hold_still(df).orderBy("fired_ms").collect()] == [1875.0, 7000.0]
    assert sessions.hold_step((False, 0.0, 100.0), [(50.0, 0.1)])[2] == 1


def test_stream_equals_batch(spark, sf_dir):
    from inspectory.plans import session_queries as q

    key = lambda df: sorted((r.session_id, r.fired_ms) for r in df.where("fired_ms is not null").collect())
    assert key(q.st2(spark, sf_dir)) == key(q.st2_stream(spark, sf_dir))


def test_named_holdout(spark):
    rows = spark.createDataFrame([("a", "1.png"), ("a", "2.png"), ("b", "1.png"), ("b", "1.png")], "asset_class string, name string")
    held = lambda *r: spark.createDataFrame(list(r), "asset_class string, name string")
    got = corpus.named_holdout(rows, held(("a", "1.png"), ("a", "1.png")))
    assert sorted((r.asset_class, r.name, r.split) for r in got.collect()) == [("a", "1.png", "held_out"), ("a", "2.png", "train_good"), ("b", "1.png", "train_good"), ("b", "1.png", "train_good")]
    with pytest.raises(ValueError, match="a: not present: 3.png"):
        corpus.named_holdout(rows, held(("a", "3.png")))
    with pytest.raises(ValueError, match="b: every frame is held out"):
        corpus.named_holdout(rows, held(("b", "1.png")))


def test_sources(spark, tmp_path):
    for name in ("train/good/1.png", "test/crack/2.png", "ground_truth/crack/2_mask.png", "test/good/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = tables.pair_masks(tables.folder_layout(tables.scan_paths(spark, str(tmp_path)))).collect()
    assert {(r.split, r.defect, r.mask_path is not None) for r in rows} == {("train", "good", False), ("test", "crack", True)}
    held = tables.scan_capture_dir(tables.scan_paths(spark, str(tmp_path)), ["1.png"])
    assert {(r.name, r.split) for r in held.collect()} >= {("1.png", "held_out"), ("2.png", "train_good")}
    f = spark.createDataFrame([("a", NOW, True)], "finding_id string, ts timestamp, backfilled boolean")
    tables.append_findings(f, str(tmp_path / "out"))
    tables.append_findings(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_split_is_a_folder(spark, tmp_path):
    """A split of one file, of a folder of part files, and of files in folders of partitions."""
    rows = spark.range(7)
    rows.write.parquet(str(tmp_path / "a" / "train.parquet"))
    rows.where("id < 3").repartition(2).write.parquet(str(tmp_path / "a" / "test.parquet"))
    part = next((tmp_path / "a" / "test.parquet").glob("part-*.parquet"))
    for own in ("b/train-0.parquet", "b/test-0.parquet", "c/day=1/train-0.parquet", "c/day=2/train-0.parquet"):
        (tmp_path / own).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / own).write_bytes(part.read_bytes())
    n = spark.read.parquet(str(part)).count()
    assert tables.split_files(spark, str(tmp_path / "a"), "train", "{split}.parquet").count() == 7
    assert tables.split_files(spark, str(tmp_path / "a"), "test", "{split}.parquet").count() == 3
    assert tables.split_files(spark, str(tmp_path / "b"), "train").count() == n
    assert tables.split_files(spark, str(tmp_path / "c"), "train").count() == 2 * n
