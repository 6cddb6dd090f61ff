"""Streams of sessions: timers, expiry, and a relay whose batches come in any order."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inspectory.plans import registry, session_queries
from inspectory.sources.commits import CommitLog
from inspectory.streaming import sessions as O

D = "/root/testdata/sf0.001"
EVENT = "session_id long, ms double, score double"


def brute(rows, until, expires):
    """Every millisecond at which something can happen, in order: timers before frames."""
    out = []
    sessions = defaultdict(list)
    for s, ms, score in rows:
        if ms is not None and score is not None and ms <= until:
            sessions[s].append((ms, score))
    for s, own in sessions.items():
        still_since, last, cooling, counted = None, None, False, 0.0
        for ms, score in [*sorted(own), (math.inf, 1.0)]:
            if still_since is not None:
                end = last + (2000 - counted)
                if end <= ms and (ms < math.inf or math.ceil(end) < until):
                    out.append((s, round(end, 3)))
                    still_since, cooling = None, True
            if ms == math.inf:
                break
            if last is not None and ms - last > expires:
                still_since, last, cooling, counted = None, None, False, 0.0
            step, last = (125.0 if last is None else ms - last), ms
            if cooling:
                cooling, counted = score <= 0.030, 0.0
            elif score >= 0.012:
                still_since, counted = None, 0.0
            else:
                counted = (counted if still_since is not None else 0.0) + step
                still_since = ms
                if counted >= 2000:
                    out.append((s, round(ms, 3)))
                    still_since, cooling, counted = None, True, 0.0
    return sorted(out)


def fired(df):
    return sorted((r.session_id, round(r.fired_ms, 3)) for r in df.collect())


def frames_of(seed, sessions=8, n=150):
    r, rows = random.Random(seed), []
    for s in range(sessions):
        ms, still = 1_000_000.0 + r.random() * 5000, True
        for _ in range(n):
            ms += r.choice([40.0, 125.0, 125.0, 300.0, 1900.0, 2500.0, 70_000.0 if r.random() < 0.1 else 90.0])
            still = still if r.random() < 0.85 else not still
            rows.append((s, ms, r.uniform(0, 0.012) if still else r.uniform(0.012, 0.06)))
    return rows + [(0, None, 0.0), (1, 1_000_000.0, None)]


def test_timed_holds(spark):
    rows = frames_of(1)
    for until, expires in ((math.inf, 600_000.0), (1_060_000.0, 60_000.0), (1_020_000.0, 2000.0)):
        got = fired(O.timed_holds(spark.createDataFrame(rows, EVENT), until, expires))
        assert got == brute(rows, until, expires) and len(got) > 10
    assert fired(O.timed_holds(spark.createDataFrame([], EVENT))) == []
    with pytest.raises(ValueError):
        O.timed_holds(spark.createDataFrame(rows, EVENT), expires=100.0)


def test_queries_equal_brute_force(spark):
    events = session_queries.timed_events(spark, D)
    want = brute([(r.session_id, r.ms, r.score) for r in events.collect()], session_queries.last_mark(events), 600_000.0)
    assert want
    for name in ("st2_timed_holds", "st2_timed_holds_stream"):
        assert fired(registry.queries()[name](spark, D)) == want


class Stream:
    """Batches of rows, one file each, read as a stream; starts anew from its checkpoint at each run."""

    def __init__(self, spark, at, build):
        self.spark, self.at, self.build = spark, str(at), build
        self.rest = None

    def run(self, *batches):
        for rows in batches:
            df = self.spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_millis(F.floor("ms").cast("long")))
            df.coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        stream = self.spark.readStream.schema(EVENT + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.at}/in")

        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{self.at}/out/batch={number}")

        q = self.build(stream).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        self.rest = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        return fired(self.spark.read.option("mergeSchema", "true").schema("session_id long, fired_ms double").parquet(f"{self.at}/out"))


def test_hold_fires_without_another_frame_and_silent_sessions_go(spark, tmp_path):
    s = Stream(spark, tmp_path, lambda df: O.timed_holds_stream(df, "1 second", 5000.0))
    still = [(1, 10_000.0 + 100 * i, 0.001) for i in range(5)]
    assert s.run(still) == [] and s.rest == 1  # frames wait, and the timer's time has not come
    assert s.run([(2, 13_500.0, 0.5)]) == [(1, 11_875.0)]  # only another session has moved the watermark on
    assert s.rest == 2
    assert s.run([(2, 30_000.0, 0.5)]) == [(1, 11_875.0)] and s.rest == 1  # the first session's state is gone
    assert s.run([(1, 29_500.0, 0.001), (2, 50_000.0, 0.5)]) == [(1, 11_875.0), (1, 31_375.0)]  # it comes back as a new one


def test_order_of_arrival_changes_nothing(spark, tmp_path):
    rows = sorted((r for r in frames_of(2, 4, 40) if r[1] is not None and r[2] is not None), key=lambda r: r[1])
    rows = [(s, float(math.floor(ms)), score) for s, ms, score in rows]
    mark = rows[-1][1] - 600_000
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    got = Stream(spark, tmp_path, lambda df: O.timed_holds_stream(df, "600 seconds", 60_000.0)).run(*(shuffled[i::3] for i in range(3)), [(99, rows[-1][1] + 700_000.0, 0.5)])
    want = brute(rows, rows[-1][1] + 100_000.0, 60_000.0)
    assert got == want and len(want) > 5 and mark < rows[0][1]


def test_relay_over_restarts(spark, tmp_path):
    step = "session_id long, seq long, kind string, value double"
    r = random.Random(6)
    rows = [(r.randrange(5), i, r.choice(["frame", "message", "message", "phase", "presence"]), r.choice([None, 10.0, 50.0, 90.0])) for i in range(900)]
    rows = [x if x[3] is not None or x[2] != "presence" else (*x[:3], 70.0) for x in rows] + [(7, 1000, "phase", None), (8, 1001, "message", None)]
    mixed = rows[:]
    r.shuffle(mixed)
    for part in range(2):
        for i in range(2):
            spark.createDataFrame(mixed[2 * part + i :: 4], step).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(step).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        O.relay_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got, steps = CommitLog(spark, f"{tmp_path}/out").read(), spark.createDataFrame(rows, step)
    for batch, relayed in ((O.latest_frames, O.relayed_frames), (O.last_messages, O.relayed_messages), (O.session_stats, O.relayed_stats), (O.last_status, O.relayed_status)):
        want = batch(steps)
        assert sorted(map(str, relayed(got).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert max(len(x.messages) for x in got.collect()) == 64


def test_relay_step_is_fast():
    """A session's step looks at each row once: 2,000 steps of 20 rows take well under a second."""
    import time

    import pandas as pd

    kinds = ("frame", "presence", "phase", "message")
    rows = pd.DataFrame({"seq": range(20), "kind": [kinds[i % 4] for i in range(20)], "value": [None if i % 7 == 5 else float(i * 7 % 100) for i in range(20)]})
    fresh = (None, None, 0, 0, False, None, None, None, [])
    began = time.process_time()
    for _ in range(2000):
        got = O.relay_step(fresh, rows, 3)
    assert time.process_time() - began < 1
    assert got == (16, 12.0, 5, 5, False, 17, 18, 17, [11, 15, 19])
