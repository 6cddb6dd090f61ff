"""Inverted lists: recall against the exact search on given and planted vectors, new rows, hot lists and odd rows."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectory.operators import routing
from inspectory.operators import vector_index as I
from inspectory.plans import registry
from inspectory.plans.adapters import frames


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "frame_id long, vec array<double>")


def found(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


def share(spark, index, queries, items, k, probes):
    want = found(routing.recall(queries, items, k))
    return len(want & found(index.search(queries, items, k, probes))) / len(want)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    return centres[rng.integers(40, size=4000)] + 0.25 * rng.normal(size=(4000, 32))


def test_given_vectors(spark, sf_dir):
    f = frames(spark, sf_dir).drop("ord")
    got = registry.queries()["knn2_approximate"](spark, sf_dir)
    q = f.where("frame_id % 20 = 0")
    want = found(routing.recall(q, f, 5))
    assert len(want & found(got)) >= 0.9 * len(want)
    (r,) = registry.queries()["knn2_rows_read"](spark, sf_dir).collect()
    assert r.n_rows == f.count() and 1 <= r.probes <= r.n_lists and 0 < r.share_read <= 1


def test_planted_clusters_read_few_rows_and_take_new_ones(spark, planted, tmp_path):
    items, q = frame(spark, planted[:3000]), frame(spark, planted[:3000]).where("frame_id % 20 = 0")
    index = I.indexed(items, str(tmp_path / "index"), 40)
    probes = index.probes_for(items, 10)
    assert share(spark, index, q, items, 10, probes) >= 0.9 and index.share_read(q, probes) < 0.35
    more = frame(spark, planted[3000:], 3000)
    index.add(more)  # the same quantiser
    both = items.union(more)
    assert index.rows().count() == 4000
    late = both.where("frame_id % 20 = 0")
    assert share(spark, index, late, both, 10, probes) >= 0.9
    pruned = index.rows().where(F.col("list").isin([1, 2]))
    assert {f.split("list=")[1].split("/")[0] for f in pruned.inputFiles()} <= {str(i) for i in range(40)}
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan  # folders of other lists are not read


def test_hot_lists_meet_in_blocks(spark, planted, tmp_path, monkeypatch):
    """One list holds all rows: blocks of a few rows and queries give what one block gives."""
    items = frame(spark, planted[:600])
    index = I.indexed(items, str(tmp_path / "index"), 1)
    q = items.where("frame_id % 5 = 0")
    want = sorted(map(tuple, index.search(q, items, 7, 1).collect()))
    monkeypatch.setattr(I, "CHUNK", 50)
    assert sorted(map(tuple, index.search(q, items, 7, 1).collect())) == want
    assert share(spark, index, q, items, 7, 1) >= 0.9


def test_odd_vectors(spark, tmp_path):
    """Nulls, zeros and equal vectors; fewer items than codewords; ties by id; empty sides."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows, "frame_id long, vec array<double>")
    index = I.indexed(items, str(tmp_path / "index"), 2)
    got = index.search(items, items, 2, 2)
    assert sorted((r.query_id, r.rank, r.item_id) for r in got.collect() if r.query_id <= 3) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert {r.query_id for r in got.collect()} == {1, 2, 3, 4, 7}
    assert index.search(items.limit(0), items, 2, 2).collect() == []
    with pytest.raises(ValueError, match="no searchable"):
        I.fit(items.where("frame_id in (5, 6)"))


def test_tasks_hold_slices(spark):
    """Whatever an Arrow batch holds, a block of queries meets ITEMS items at once, and PROBED lists of queries are yielded at once."""
    from inspectory.operators import routing, vector_index

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3000)], "id long, v array<double>").coalesce(1)

    def scores(ids, own, items, vectors, most=routing.ITEMS):
        assert len(items) <= most
        return own @ np.stack(vectors.to_numpy()).T

    asked = [r.v for r in rows.orderBy("id").limit(3).collect()]
    got = routing._searched(rows, ("id", "v"), [([0, 1, 2], np.array(asked))], scores, 5, -1e9, "bigint", 5).collect()
    every = np.array([r.v for r in rows.orderBy("id").collect()])
    for q in range(3):
        assert {r.item_id for r in got if r.query_id == q} == set(np.argsort(-(np.array(asked[q]) @ every.T))[:5].tolist())

    class Watched(vector_index.Quantiser):
        def lists(self, x, probes, most=vector_index.PROBED):
            assert len(x) * probes <= most
            return super().lists(x, probes)

    own = Watched(rng.normal(size=(64, 4)), rng.normal(size=(2, 256, 2)))
    index = vector_index.VectorIndex(spark, "unused", I.Quantiser(own.centres, own.words))
    index.sent = SimpleNamespace(value=own)
    found = index.probed(rows, 64, id_col="id", vec="v")
    assert found.count() == 3000 * 64 and found.distinct().count() == 3000 * 64


def quantised(rng, lists=6, n=400):
    q = I.Quantiser(rng.normal(size=(lists, 4)), 0.1 * rng.normal(size=(2, 256, 2)))
    own = np.sort(rng.integers(lists, size=n))
    return q, own, rng.integers(256, size=(n, 2)).astype(np.uint8)


@pytest.mark.parametrize("probes", [1, 3, 6])
def test_best_rows_are_those_of_all_products(monkeypatch, probes):
    """Whatever the slices, and with fewer rows than asked, the best rows of the probed lists."""
    rng = np.random.default_rng(6)
    q, own, codes = quantised(rng)
    x = rng.normal(size=(50, 4))
    member = np.zeros((50, 6), bool)
    np.put_along_axis(member, q.lists_of(x, probes), True, 1)
    every = x @ np.array([q.centres[o] + np.concatenate([q.words[0, c[0]], q.words[1, c[1]]]) for o, c in zip(own, codes)]).T
    every[~member[:, own]] = -np.inf
    for most, size in ((7, (3, 11)), (90, (256, 2048)), (500, (64, 64))):
        monkeypatch.setattr(I, "SLICE", size)
        score, at = q.best(x, own, codes, np.arange(400), most, member if probes < 6 else None)
        want = -np.sort(-every, 1)[:, :most]
        assert np.allclose(score[:, : want.shape[1]], want) and (score[:, want.shape[1] :] == -np.inf).all()
        there = score > -np.inf
        assert np.allclose(np.take_along_axis(every, at, 1)[there], score[there])
        assert all(len(set(a[t])) == t.sum() for a, t in zip(at, there))


def test_nothing_is_written_once_a_query_and_list(spark, planted, tmp_path, monkeypatch):
    """However many lists are probed, what a search writes is its candidates; and one scan tells how many lists a recall needs."""
    items = frame(spark, planted[:600])
    index = I.indexed(items, str(tmp_path / "index"), 40)
    q, kept, scans = items.where("frame_id % 5 = 0"), [], []
    written, candidates = I.written, I.VectorIndex.candidates
    monkeypatch.setattr(I, "written", lambda df, name: kept.append(df.columns) or written(df, name))
    monkeypatch.setattr(I.VectorIndex, "candidates", lambda *a, **k: scans.append(1) or candidates(*a, **k))
    assert share(spark, index, q, items, 7, 40) >= 0.9
    assert kept == [["query_id", "item_id"]]
    scans.clear()
    probes = index.probes_for(items, 7, 0.9)
    assert len(scans) == 1
    n = items.count() // 200
    sample = items.where(F.pmod(F.xxhash64(F.lit("probes"), "frame_id"), F.lit(n)) == 0)
    shares = {p: share(spark, index, sample, items, 7, p) for p in (1, 2, 4, 8, 16, 32, 40)}
    assert probes == next((p for p, x in shares.items() if x >= 0.9), 40)


def test_copies_are_found_by_id(spark, planted, tmp_path, monkeypatch):
    """More copies of a vector than candidates: the first by id, as in the exact search, in one block and in many."""
    x = planted[:400].copy()
    x[50:350] = x[50]
    items = frame(spark, x)
    index = I.indexed(items, str(tmp_path / "index"), 8)
    q = items.where("frame_id in (50, 51, 120, 349)")
    want = {(i, j) for i in (50, 51, 120, 349) for j in [j for j in range(50, 60) if j != i][:5]}
    assert found(index.search(q, items, 5, 8)) == found(index.search(q, items, 5, 1)) == want
    monkeypatch.setattr(I, "CHUNK", 2)
    assert found(index.search(q, items, 5, 3)) == want


def test_equal_scores_of_unlike_codes_are_found_by_id(spark, planted, tmp_path):
    """To a query of zeros all rows are equal: the first by id, as in the exact search, though they are in all lists."""
    x = planted[:400].copy()
    x[7] = x[300] = 0
    items = frame(spark, x)
    index = I.indexed(items, str(tmp_path / "index"), 8)
    q = items.where("frame_id in (7, 300)")
    got, want = found(index.search(q, items, 5, 8)), found(routing.recall(q, items, 5))
    assert got == want == {(7, j) for j in (0, 1, 2, 3, 4)} | {(300, j) for j in (0, 1, 2, 3, 4)}


def test_best_so_far():
    """Kept scores are those of one sort of all, equal ones in order of arrival, also if the first slice has just as many."""
    rng = np.random.default_rng(8)
    for first in (2, 5, 9):
        scores = rng.integers(12, size=(30, 80)) / 4
        best, items = routing.Running(30, 5), np.arange(80)
        for lo, hi in [(0, first), *((lo, min(80, lo + 7)) for lo in range(first, 80, 7))]:
            best.add(scores[:, lo:hi].copy(), items[lo:hi])
        want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
        assert (best.item == want).all() and (best.score == np.take_along_axis(scores, want, 1)).all()
