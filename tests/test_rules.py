"""Queries without SQL against brute force in plain Python, on whole small tables."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inspectory.operators import corpus, routing, scoring
from inspectory.plans import registry, registry_queries, scoring_queries, session_queries
from inspectory.plans.adapters import frames, map_cells, patches

D = "/root/testdata/sf0.001"
COVERED = "bnk1_coreset bnk3_reweighted bnk5_gaussian cu6_perceptual_dedupe_d4 knn2_approximate knn2_rows_read knn2_sign_codes knn4_agreement met3_supervised_ceiling met6_reload_parity rt12_layout sc5_regions sc5_tiled_regions sc6_region_filters st2_hold_still st2_hold_still_stream st2_timed_holds st2_timed_holds_stream st9_stream_inspection thr1_fold_scores thr4_leave_out_audit v2c_refusal_clusters".split()


def rows_of(spark, name, d=D):
    return registry.queries()[name](spark, d).collect()


@pytest.fixture(scope="module")
def patch_rows(spark):
    return sorted(patches(spark, D).collect(), key=lambda r: (r.frame_id, r.patch_id))


@pytest.fixture(scope="module")
def split(spark):
    train, test = scoring_queries.split_patches(spark, D)
    key = lambda r: (r.frame_id, r.patch_id)
    return sorted(train.collect(), key=key), sorted(test.collect(), key=key)


def cover(rows, size):
    """Farthest first, from the first row on."""
    x = [np.array(r.pvec) for r in rows]
    taken = [0]
    while len(taken) < min(size, len(rows)):
        far = [min(np.sqrt(((v - x[t]) ** 2).sum()) for t in taken) for v in x] if len(taken) == 1 else [min(f, np.sqrt(((v - x[taken[-1]]) ** 2).sum())) for f, v in zip(far, x)]
        taken.append(int(np.argmax(far)))
    return [rows[i] for i in taken]


def two_covers(rows, ratio):
    one = sorted(cover(rows, max(1, int(min(len(rows), 4 * ratio * len(rows) + 1)))), key=lambda r: (r.frame_id, r.patch_id))
    return cover(one, max(1, int(ratio * len(rows))))


def by_class(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.asset_class].append(r)
    return out


def nearest(row, bank):
    b = np.array([r.pvec for r in bank])
    return np.sqrt(((b - np.array(row.pvec)) ** 2).sum(1))


def frame_scores(rows, banks):
    out = {}
    for r in rows:
        d = nearest(r, banks[r.asset_class]).min()
        out[r.frame_id] = max(out.get(r.frame_id, (0.0, 0)), (d, -r.patch_id))
    return out


def test_coreset(spark, patch_rows):
    got = rows_of(spark, "bnk1_coreset")
    want = {(r.frame_id, r.patch_id) for own in by_class(patch_rows).values() for r in two_covers(own, 0.1)}
    assert {(r.frame_id, r.patch_id) for r in got} == want and len(got) == len(want)
    small = scoring.coreset(patches(spark, D), 0.1, part_rows=50).collect()
    sizes = {c: len(own) for c, own in by_class(patch_rows).items()}
    assert all(0.7 * 0.1 * sizes[c] <= len(own) <= 0.1 * sizes[c] + 1 for c, own in by_class(small).items())
    assert len({(r.frame_id, r.patch_id) for r in small}) == len(small)


def test_reweighted_scores(spark, split):
    train, test = split
    banks = by_class(train)
    got = {r.frame_id: (r.patch_id, r.raw_score) for r in rows_of(spark, "bnk3_reweighted")}
    own = {(r.frame_id, r.patch_id): r for r in test}
    for f, (d, patch) in frame_scores(test, banks).items():
        r = own[f, -patch]
        bank = banks[r.asset_class]
        m = bank[int(nearest(r, bank).argmin())]
        near = [bank[i] for i in np.argsort(nearest(m, bank), kind="stable")[:9]]
        want = (1 - 1 / np.exp(nearest(r, near) - d).sum()) * d
        assert got[f][0] == r.patch_id and abs(got[f][1] - want) < 1e-9
    assert len(got) == len({r.frame_id for r in test})


def test_bank_in_blocks(spark, split):
    train, test = (spark.createDataFrame([(r.frame_id, r.asset_class, r.patch_id, r.pvec) for r in x], "frame_id long, asset_class string, patch_id int, pvec array<double>") for x in split)
    key = lambda df: {(r.frame_id, r.patch_id): round(r.distance, 9) for r in df.collect()}
    assert key(scoring.patch_distances(test, train, block=200)) == key(scoring.patch_distances(test, train))
    a, b = ({r.frame_id: round(r.raw_score, 9) for r in scoring.image_scores(scoring.patch_distances(test, train), train, test, block=n).collect()} for n in (200, 4096))
    assert a == b


def test_gaussian(spark, split):
    train, test = split
    got = {(r.frame_id, r.patch_id): r.distance for r in rows_of(spark, "bnk5_gaussian")}
    fitted = defaultdict(list)
    for r in train:
        fitted[r.asset_class, r.patch_id].append(r.pvec)
    for r in test:
        x = np.array(fitted[r.asset_class, r.patch_id])
        inverse = np.linalg.inv(np.cov(x, rowvar=False) + 0.01 * np.eye(x.shape[1]))
        d = np.array(r.pvec) - x.mean(0)
        assert abs(got[r.frame_id, r.patch_id] - np.sqrt(d @ inverse @ d)) < 1e-6
    assert len(got) == len(test)
    few = spark.createDataFrame([(r.frame_id, r.asset_class, r.patch_id, r.pvec) for r in test], "frame_id long, asset_class string, patch_id int, pvec array<double>")
    base = spark.createDataFrame([(r.frame_id, r.asset_class, r.patch_id, r.pvec) for r in train if r.asset_class != "class_1"], "frame_id long, asset_class string, patch_id int, pvec array<double>")
    for r in scoring.gaussian_scores(base, few, part_rows=3).collect():
        assert r.distance is None if r.asset_class == "class_1" else abs(r.distance - got[r.frame_id, r.patch_id]) < 1e-9


def fingerprint(text):
    import re

    w = re.split(r"\s+", text or "", flags=re.A)
    grams = {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def test_perceptual_dedupe(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect())
    kept = []
    for d, t in docs:
        fp = fingerprint(t)
        if all((fp ^ other).bit_count() > 4 for _, other in kept):
            kept.append((d, fp))
    assert sorted(r.place for r in rows_of(spark, "cu6_perceptual_dedupe_d4")) == [d for d, _ in kept]


def test_close_pairs(spark):
    rng = np.random.default_rng(3)
    fp = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for i in range(240):
        x = fp[int(rng.integers(0, 60))]
        for b in rng.choice(64, int(rng.integers(1, 8)), replace=False):
            x ^= 1 << int(b)
        fp.append(x - (1 << 64) if x >= 1 << 63 else (x + (1 << 64) if x < -(1 << 63) else x))
    df = spark.createDataFrame([(i, x, f"g{i % 2}") for i, x in enumerate(fp)], "place long, fp long, kind string")
    for distance, by in ((1, None), (4, None), (4, "kind"), (6, None)):
        want = {(i, j) for j in range(len(fp)) for i in range(j) if ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= distance and (by is None or i % 2 == j % 2)}
        assert {(r.earlier, r.later) for r in corpus.close_pairs(df, distance, by).collect()} == want


def test_approximate_recall(spark, sf_dir):
    for d in (D, sf_dir):
        f = frames(spark, d)
        exact = {(r.query_id, r.item_id): r.score for r in routing.recall(registry_queries.queries_of(f), f, 5).collect()}
        found = rows_of(spark, "knn2_approximate", d)
        assert all(r.query_id != r.item_id and r["rank"] <= 5 for r in found) and len({r.query_id for r in found}) * 5 == len(found)
        both = [(exact[r.query_id, r.item_id], r.score) for r in found if (r.query_id, r.item_id) in exact]
        assert len(both) >= 0.9 * len(exact) and all(abs(a - b) < 5e-3 for a, b in both)
        codes = rows_of(spark, "knn2_sign_codes", d)
        assert len({(r.query_id, r.item_id) for r in codes} & set(exact)) >= 0.9 * len(exact)
        (a,) = rows_of(spark, "knn4_agreement", d)
        assert a.wanted == len(exact) and abs(a.recall - len(both) / len(exact)) < 1e-12 and a.top1 >= 0.9
    blocks = {(r.query_id, r.item_id) for r in routing.approximate_recall(registry_queries.queries_of(f), f, 5, block=7).collect()}
    assert blocks == {(r.query_id, r.item_id) for r in codes}


def test_supervised_ceiling(spark):
    (r,) = rows_of(spark, "met3_supervised_ceiling")
    labels = [x.label for x in frames(spark, D).select("label").collect()]
    assert r.positives == sum(x < 3 for x in labels) and r.positives + r.negatives == len(labels) and 0.3 <= r.auroc <= 1


def test_reload_parity(spark):
    (r,) = rows_of(spark, "met6_reload_parity")
    assert r.match and r.delta < 1e-9


def test_layout(spark):
    models = sorted(registry_queries.registry(spark, D).collect(), key=lambda r: r.name)
    x = np.array([r.vec for r in models])
    x = x - x.mean(0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:2]
    got = [r.name for r in sorted(rows_of(spark, "rt12_layout"), key=lambda r: r.slot)]
    turns = []
    for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)):  # the sign of a main component is free
        angle = np.arctan2(b * (x @ axes[1]), a * (x @ axes[0]))
        turns.append([models[i].name for i in np.argsort(angle)])
    assert got in turns
    assert [r.angle for r in sorted(rows_of(spark, "rt12_layout"), key=lambda r: r.slot)] == pytest.approx([2 * np.pi * i / len(models) for i in range(len(models))])


def brute_regions(v, cut):
    h, w = v.shape
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    hot = {(y, x) for y in range(h) for x in range(w) if v[y, x] >= cut}
    core = {(y, x) for y, x in hot if all((y + a, x + b) in hot for a, b in around if inside(y + a, x + b))}
    todo = {(y + a, x + b) for y, x in core for a, b in around if inside(y + a, x + b)}
    out = []
    while todo:
        part, stack = set(), [todo.pop()]
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for a, b in around:
                if (y + a, x + b) in todo:
                    todo.discard((y + a, x + b))
                    stack.append((y + a, x + b))
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part), max(v[p] for p in part)))
    return out


@pytest.fixture(scope="module")
def maps(spark):
    out = defaultdict(lambda: np.zeros((8, 8)))
    for r in scoring_queries.norm_cells(spark, D, 0.2).collect():
        out[r.frame_id][r.y, r.x] = r.norm
    return {f: brute_regions(v, 0.5) for f, v in out.items()}


@pytest.mark.parametrize("name", ["sc5_regions", "sc5_tiled_regions"])
def test_regions(spark, maps, name):
    got = defaultdict(list)
    for r in rows_of(spark, name):
        got[r.frame_id].append((r.x, r.y, r.w, r.h, r.area, r.peak))
    assert {f: sorted(x) for f, x in got.items()} == {f: sorted(x) for f, x in maps.items() if x} and len(got) > 100


def test_region_filters(spark, maps):
    got = defaultdict(list)
    for r in rows_of(spark, "sc6_region_filters"):
        got[r.frame_id].append((r["rank"], r.x, r.y, r.w, r.h, r.peak))
    for f, found in maps.items():
        found = [x for x in found if x[4] >= 0.0025 * 64]
        hot = max((x[5] for x in found), default=0)
        kept = sorted((x for x in found if x[5] >= 0.7 * hot), key=lambda x: (-x[5], x[1], x[0], *x[2:5]))[:8]
        want = [(i + 1, round(x * 80), round(y * 60), max(1, round(w * 80)), max(1, round(h * 60)), p) for i, (x, y, w, h, _, p) in enumerate(kept)]
        assert sorted(got[f]) == want
    tiny = spark.createDataFrame([(1, 5, 3, 1, 1, 9, 1.0, 64, 64)], "frame_id long, x int, y int, w int, h int, area int, peak double, map_w int, map_h int")
    (r,) = scoring.kept_regions(tiny, (32, 16), floor=0).collect()
    assert (r.x, r.y, r.w, r.h) == (2, 1, 1, 1)  # halves round to even, one pixel at least


def test_hold_still(spark):
    events = defaultdict(list)
    for r in session_queries.hold_events(spark, D).collect():
        events[r.session_id].append((r.ms, r.score))
    want = []
    for s, own in events.items():
        still, armed, last = 0.0, True, None
        for at, score in sorted(own, key=lambda x: x[0]):
            gap, last = (125.0 if last is None else at - last), at
            if not armed:
                armed, still = score > 0.030, 0.0
            elif score < 0.012:
                still += gap
                if still >= 2000:
                    want.append((s, at))
                    armed, still = False, 0.0
            else:
                still = 0.0
    assert want
    for name in ("st2_hold_still", "st2_hold_still_stream"):
        assert sorted((r.session_id, r.fired_ms) for r in rows_of(spark, name) if r.fired_ms is not None) == sorted(want)


def test_stream_inspection(spark, split):
    got = {r.frame_id: r for r in rows_of(spark, "st9_stream_inspection")}
    decided = {r.frame_id: r for r in registry.queries()["rt2_decide"](spark, D).collect()}
    banks = {c: b for c, b in by_class(split[0]).items() if c != "class_9"}
    own = defaultdict(list)
    for r in patches(spark, D).collect():
        own[r.frame_id].append(r)
    assert set(got) == set(decided)
    for f, d in decided.items():
        r = got[f]
        assert (r.decision, r.best_name) == (d.decision, d.best_name)
        if d.decision != "route":
            assert (r.verdict, r.severity, r.raw_score, r.asset_class) == ("unroutable", 0.0, None, None)
            continue
        raw = max(nearest(p, banks[r.asset_class]).min() for p in own[f])
        assert d.best_name.startswith(r.asset_class) and abs(r.raw_score - raw) < 1e-6
        assert r.verdict == ("defect" if raw >= 0.3 else "nominal") and abs(r.severity - min(1, max(0, raw - 0.3 + 0.5))) < 1e-4
    assert len({r.verdict for r in got.values()}) >= 2


def brute_folds(rows, folds):
    out = {}
    for own in by_class(rows).values():
        order = sorted({(r.ord, r.frame_id) for r in own})
        fold = {f: i % folds for i, (_, f) in enumerate(order)}
        if len(order) - -(-len(order) // folds) < 2:
            continue
        for k in range(folds):
            bank = {own[0].asset_class: two_covers([r for r in own if fold[r.frame_id] != k], 0.25)}
            out |= {f: d for f, (d, _) in frame_scores([r for r in own if fold[r.frame_id] == k], bank).items()}
    return out


def test_fold_scores(spark, patch_rows):
    want = brute_folds(patch_rows, 2)
    got = {r.frame_id: r.raw_score for r in rows_of(spark, "thr1_fold_scores")}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_leave_out_audit(spark, patch_rows):
    unseen, kinds = brute_folds(patch_rows, 5), {r.frame_id: r.asset_class for r in patch_rows}
    seen = frame_scores(patch_rows, {c: two_covers(own, 0.25) for c, own in by_class(patch_rows).items()})
    for r in rows_of(spark, "thr4_leave_out_audit"):
        most = max(d for f, (d, _) in seen.items() if kinds[f] == r.asset_class)
        own = [d for f, d in unseen.items() if kinds[f] == r.asset_class]
        assert (r.frames, r.would_flag) == (len(own), sum(d > most for d in own))
        assert (r.min_ratio, r.max_ratio, r.mean_ratio) == pytest.approx((min(own) / most, max(own) / most, np.mean(own) / most))


def test_refusal_clusters(spark):
    refused = registry_queries.decided(spark, D, registry_queries.REFUSING_FLOOR).where("decision = 'unroutable'")
    ids = {r.frame_id for r in refused.collect()}
    found = rows_of(spark, "v2c_refusal_clusters")
    assert len(ids) > 2 and sum(r.frames for r in found) == len(ids) and all(r.first_frame in ids for r in found)
    none = routing.refusal_clusters(frames(spark, D), refused.where("false"))
    assert none.count() == 0
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 0.01 + (5 if i % 3 else -5)).tolist(), "unroutable") for i in range(30)]
    df = spark.createDataFrame(rows, "frame_id long, vec array<double>, decision string")
    assert sorted(r.frames for r in routing.refusal_clusters(df, df).collect()) == [10, 20]


def test_capped_maps(spark):
    """The registered maps are 8 by 8, so every cell of every frame is read."""
    assert map_cells(spark, D).count() == 64 * frames(spark, D).count()


def test_ranks_over_ranges(spark):
    from inspectory.operators import ranks

    rng = np.random.default_rng(4)
    rows = [(("a", "b", None)[int(rng.integers(3))], int(v), i) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "kind string, v int, i int").repartition(4)
    both = [r for few in (0, ranks.FEW) for r in ranks.numbered(df, ["kind"], ["v", "i"], "place", few).collect()]
    assert len(both) == 2 * len(rows)
    for r in both:
        assert r.place == 1 + sum((k == r.kind) and (v, i) < (r.v, r.i) for k, v, i in rows)
    sums = {(k, v): sum(1 for a, b, _ in rows if a == k and b == v) for k, v, _ in rows}
    h = spark.createDataFrame([(k, v, n) for (k, v), n in sums.items()], "kind string, v int, n long")
    for few in (0, ranks.FEW):
        got = ranks.with_sums_below(h, "kind", "v", ("n",), few).collect()
        assert len(got) == len(sums) and all(r.below_n == sum(n for (k, v), n in sums.items() if k == r.kind and v < r.v) for r in got)
        for r in ranks.exact_quantiles(df.where("kind is not null"), "kind", "v", {"low": 0.05, "mid": 0.5, "top": 1.0}, few).collect():
            own = [v for k, v, _ in rows if k == r.kind]
            assert (r.low, r.mid, r.top) == pytest.approx(tuple(np.quantile(own, [0.05, 0.5, 1.0])))
    sized = ranks.with_group_size(df, ["kind"], "n").collect()
    assert len(sized) == len(rows) and all(r.n == sum(k == r.kind for k, _, _ in rows) for r in sized)
    assert ranks.exact_quantiles(df.limit(0), "kind", "v", {"mid": 0.5}).count() == 0


def test_broadcasts_by_bytes(spark):
    """Wide rows are merge-joined although they are few."""
    from inspectory.operators import ranks

    df = spark.createDataFrame([("é", [1.0, 2.0], None, 3), (None, None, {"a": 1}, 4)], "s string, v array<double>, m map<string,int>, i int")
    assert sorted(r[0] for r in df.select(ranks.row_bytes(df)).collect()) == [8 + 13, 2 + 16 + 8 + 2]
    hinted = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted(ranks.small(df)).lower()
    wide = spark.range(2).select(F.sequence(F.lit(1), F.lit(3_000_000)).alias("v"))
    assert "broadcast" not in hinted(ranks.small(wide)).lower()


def test_search_in_turns(spark):
    """Blocks beyond a turn's are written; the rows are the same, ties and both directions included."""
    f = frames(spark, D).select("frame_id", "vec")
    f = f.unionAll(f.where("frame_id < 5").select(F.col("frame_id") + 100_000, "vec"))
    asked = f.where("frame_id % 20 = 0")
    rows = lambda df: sorted((r[0], r[1], round(r.score, 9), r.rank) for r in df.collect())
    assert rows(routing.recall(asked, f, 4, block=2, at_once=2)) == rows(routing.recall(asked, f, 4))
    targets = f.withColumnRenamed("frame_id", "name")
    assert rows(routing.nearest_targets(asked, targets, 3, block=16, at_once=2)) == rows(routing.nearest_targets(asked, targets, 3))
    assert routing.recall(asked.limit(0), f, 4).count() == 0


def test_bank_in_blocks(spark):
    """Blocks of either side change nothing, ties included; one class has no bank and one no rows to ask."""
    rng = np.random.default_rng(6)
    rows = [(int(i), ("a", "b", "c")[i % 3], p, rng.normal(size=4).round(1).tolist()) for i in range(60) for p in range(2)]
    df = spark.createDataFrame(rows, "frame_id long, asset_class string, patch_id int, pvec array<double>")
    copies = df.where("frame_id < 12").withColumn("frame_id", F.col("frame_id") + 1000)
    asked, bank = df.where("asset_class <> 'c'"), df.unionAll(copies).where("asset_class <> 'b'")
    held = [r for r in bank.collect() if r.asset_class == "a"]
    for k in (1, 5):
        got = [sorted(map(tuple, scoring.nearest_in_bank(asked, bank, k, block=b, asked=q).collect())) for b, q in ((7, 5), (10_000, 10_000))]
        near = {}
        for f, c, p, v in rows:
            if c == "a":
                far = sorted((np.sqrt(((np.array(r.pvec) - np.array(v)) ** 2).sum()), r.frame_id, r.patch_id) for r in held)
                near[f, p] = far[:k]
        for own in got:
            assert len(own) == k * len(near) and {r[1] for r in own} == {"a"}
            for r in own:
                assert abs(r[5] - near[r[0], r[2]][r[6] - 1][0]) < 1e-9 and (k > 1 or r[3:5] == near[r[0], r[2]][0][1:])


def test_cover_is_fast(spark):
    """5,000 of 20,000 rows: 13 s before, when each step made new arrays."""
    import time

    x, began = np.random.default_rng(0).normal(size=(20_000, 8)), time.process_time()
    assert len(set(scoring.greedy_cover(x, 2000))) == 2000 and time.process_time() - began < 4


def test_few_groups_seldom_share_a_task(spark):
    """Ten classes are ten groups of the bank search: of twice as many tasks, several held two or three of them, and one that holds a large one twice decides the time."""
    rows = spark.range(40).select(F.col("id").alias("frame_id"), F.concat(F.lit("class_"), (F.col("id") % 10).cast("string")).alias("asset_class"), F.lit(0).alias("patch_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("pvec"))
    met = scoring.met_in_blocks(rows, rows).withColumn("task", F.spark_partition_id()).collect()
    assert len(met) == 40 and all(r.distance == 0 and r.bank_frame == r.frame_id for r in met)
    assert len({r.task for r in met}) >= 9


@pytest.mark.parametrize("scale, shift", [(1, 0), (1e-4, 1e4), (1e-30, 0), (1e120, 0)])
def test_cover_by_all_differences(scale, shift):
    """Products only choose which differences are taken: also far from zero, for very small and large vectors, and among ties."""
    x = np.random.default_rng(3).normal(size=(3000, 8))
    for rows in (x * scale + shift, x.round() * scale + shift):
        taken, far = [0], sum((rows - rows[0]).T ** 2)
        while len(taken) < 400:
            taken.append(int(far.argmax()))
            far = np.minimum(far, sum((rows - rows[taken[-1]]).T ** 2))
        assert scoring.greedy_cover(rows, 400) == taken


def test_cover_of_copies(spark):
    """Once all is covered, copies follow: the first row was taken again for every place left, and a row with NaN too."""
    x = np.random.default_rng(4).normal(size=(200, 8))
    copies = np.tile(x, (10, 1))
    taken = scoring.greedy_cover(copies, 1500)
    assert sorted(taken[:200]) == list(range(200)) and taken[200:] == list(range(200, 1500))
    x[5], x[9, 2] = np.nan, np.nan
    assert sorted(scoring.greedy_cover(x, 200)) == list(range(200))
    rows = spark.createDataFrame([(i, "a", 0, v.tolist()) for i, v in enumerate(copies)], "frame_id long, asset_class string, patch_id int, pvec array<double>")
    kept = [r.frame_id for r in scoring.coreset(rows, 0.2).collect()]
    assert len(kept) == len(set(kept)) == 400 and {i % 200 for i in kept} == set(range(200))


def test_nearest_rows_of_copies():
    """12,000 copies of a row that is asked and 12,000 of it in the bank; each met each, which took 18 s."""
    import time

    x = np.random.default_rng(5).normal(size=(13_000, 8))
    x[1000:] = x[7]
    for k in (1, 3):
        began = time.process_time()
        at, distance = scoring.nearest_rows(x, x[::-1], k)
        assert time.process_time() - began < 4
        assert (at[1000:] == np.arange(k)).all() and (at[7] == np.arange(k)).all() and not distance[1000:].any()
        assert (at[np.r_[:7, 8:1000], 0] == 12_999 - np.r_[:7, 8:1000]).all() and not distance[:, 0].any()


def test_nearest_rows_passes_over_far_leaves():
    """20,000 rows and 200,000 of a bank in clusters: all pairs took 17 s."""
    import time

    rng = np.random.default_rng(8)
    centres = rng.uniform(-9, 9, (400, 8))
    b, x = (centres[rng.integers(0, 400, n)] + rng.normal(size=(n, 8)) * 0.1 for n in (200_000, 20_000))
    began = time.time()
    at, distance = scoring.nearest_rows(x, b, 1)
    assert time.time() - began < 8
    for i in range(0, len(x), 500):
        far = ((b - x[i]) ** 2).sum(1)
        assert at[i, 0] == far.argmin() and distance[i, 0] == np.sqrt(far.min())


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_rows_far_from_zero(k):
    """Vectors far from zero, copies, and NaN: products alone chose wrong ones."""
    rng = np.random.default_rng(9)
    b, x = rng.normal(size=(900, 8)), rng.normal(size=(200, 8))
    b[600:], b[5], b[7, 2], x[:50] = b[:300], np.nan, np.nan, b[:50]
    b, x = b * 1e-4 + 1e4, x * 1e-4 + 1e4
    for leaf in (16, 4096):
        at, distance = scoring.nearest_rows(x, b, k, leaf)
        far = np.sqrt(((x[:, None] - b[None]) ** 2).sum(2))
        far[np.isnan(far)] = np.inf
        want = np.argsort(far, axis=1, kind="stable")[:, :k]
        assert (at == want).all() and (np.isinf(np.take_along_axis(far, want, 1)) == np.isnan(distance)).all()
