"""Session events, in batch and as Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.commits import CommitLog
from ..sources.tables import written

STILL, MOVED, HOLD_MS, FIRST_MS = 0.012, 0.030, 2000.0, 125.0


def luma(r, g, b):
    return F.shiftright(77 * C.col(r) + 151 * C.col(g) + 28 * C.col(b), 8)


def motion_scores(frames: DataFrame) -> DataFrame:
    """Mean absolute luma difference to the frame before, over 255; 1 for the first. Frames: session_id, ts, seq, luma array."""
    before = F.lag("luma").over(Window.partitionBy("session_id").orderBy("ts", "seq"))
    df = frames.withColumn("before", before)
    diff = F.aggregate(F.zip_with("luma", "before", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size("luma") / 255
    return df.withColumn("score", F.when(F.col("before").isNull(), 1.0).otherwise(diff)).drop("before", "luma")


def hold_step(state: tuple[bool, float, float | None], rows: list[tuple[float, float]]) -> tuple[tuple[bool, float, float | None], list[float], int]:
    """Advance (cooling, still ms, last ms) over rows (ms, score) in time order. Returns the new state, firing times, and rows that came too late."""
    cooling, still, last = state
    fired, late = [], 0
    for at, score in rows:
        if last is not None and at < last:
            late += 1
            continue
        dt = FIRST_MS if last is None else at - last
        last = at
        if cooling:
            if score > MOVED:
                cooling, still = False, 0.0
        elif score < STILL:
            still += dt
            if still >= HOLD_MS:
                fired.append(at)
                cooling, still = True, 0.0
        else:
            still = 0.0
    return (cooling, still, last), fired, late


OUT = "session_id long, fired_ms double, late long"


def hold_still(events: DataFrame) -> DataFrame:
    """Firing times of each session in batch: (session_id, ms, score) rows. Sessions are split by id; one session's rows are in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms", kind="stable")
        _, fired, _ = hold_step((False, 0.0, None), list(zip(pdf.ms, pdf.score)))
        return pd.DataFrame({"session_id": [pdf.session_id.iloc[0]] * len(fired), "fired_ms": fired, "late": [0] * len(fired)})

    return events.select("session_id", "ms", "score").groupBy("session_id").applyInPandas(run, OUT)


def hold_still_stream(events: DataFrame) -> DataFrame:
    """The same as a stateful stream; rows older than a session's last one are dropped and counted."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cooling, still, last = state.get if state.exists else (False, 0.0, -1.0)
        rows = sorted((x for pdf in parts for x in zip(pdf.ms, pdf.score)), key=lambda x: x[0])
        (cooling, still, last), fired, late = hold_step((cooling, still, None if last < 0 else last), rows)
        state.update((cooling, still, -1.0 if last is None else last))
        out = [(key[0], at, 0) for at in fired] + ([(key[0], None, late)] if late else [])
        yield pd.DataFrame(out, columns=["session_id", "fired_ms", "late"]).astype({"fired_ms": float})

    return events.select("session_id", "ms", "score").groupBy("session_id").applyInPandasWithState(run, OUT, "cooling boolean, still double, last double", "append", GroupStateTimeout.NoTimeout)


TIMED = "session_id long, fired_ms double"
FRESH = (False, 0.0, None, False)


def timed_step(state: tuple[bool, float, float | None, bool], rows: list[tuple[float, float]], expires: float) -> tuple[tuple, list[float]]:
    """As ``hold_step``, with a timer: a frame held still fires when its 2,000 ms are over, whether or not another frame comes.
    State: cooling, still ms, last ms, held (the last frame was still). After ``expires`` ms without a frame a session begins anew."""
    cooling, still, last, held = state
    fired = []
    for at, score in rows:
        due = last + HOLD_MS - still if held else math.inf
        if due <= at:
            fired.append(due)
            cooling, still, held = True, 0.0, False
        if last is not None and at - last > expires:
            cooling, still, last, held = FRESH
        dt = FIRST_MS if last is None else at - last
        last = at
        if cooling:
            cooling, still, held = score <= MOVED, 0.0, False
        elif score < STILL:
            still, held = still + dt, True
            if still >= HOLD_MS:
                fired.append(at)
                cooling, still, held = True, 0.0, False
        else:
            still, held = 0.0, False
    return (cooling, still, last, held), fired


def timed_end(state: tuple, until: float) -> tuple[tuple, list[float]]:
    """Fire the timer of a state if it is over before ``until``."""
    cooling, still, last, held = state
    if held and math.ceil(due := last + HOLD_MS - still) < until:
        return (True, 0.0, last, False), [due]
    return state, []


def ordered(ms, score) -> list[tuple[float, float]]:
    return sorted((a, b) for a, b in zip(ms, score) if a == a and b == b)


def checked(expires: float) -> float:
    if expires < HOLD_MS:
        raise ValueError(f"a session must not expire within {HOLD_MS:.0f} ms")
    return float(expires)


def timed_holds(events: DataFrame, until: float | None = None, expires: float = 600_000.0) -> DataFrame:
    """Firing times in batch: (session_id, ms, score) rows up to ``until`` ms and timers over before it; all of them if there is no ``until``.
    Rows without a time or a score are left out. One session's rows are in one task, as its frames depend on each other."""
    expires, end = checked(expires), float("inf") if until is None else float(until)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, fired = timed_step(FRESH, ordered(pdf.ms, pdf.score), expires)
        fired += timed_end(state, end)[1]
        return pd.DataFrame({"session_id": [pdf.session_id.iloc[0]] * len(fired), "fired_ms": fired})

    return events.where(F.col("ms") <= end).select("session_id", "ms", "score").groupBy("session_id").applyInPandas(run, TIMED)


def timed_holds_stream(events: DataFrame, delay: str = "10 seconds", expires: float = 600_000.0) -> DataFrame:
    """The same over a stream of (session_id, ts, ms, score), in any order within ``delay``: a frame waits in the session's state
    until the watermark has passed it, so the order of arrival changes nothing. Event-time timers fire holds without a further
    frame and remove the state of a session that was silent for ``expires`` ms. State: four numbers and the frames that wait."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    expires = checked(expires)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cooling, still, last, held, ms, scores = state.get if state.exists else (*FRESH, [], [])
        known = (cooling, still, None if last is None or last != last else last, held)
        waiting = list(zip(ms, scores))
        if not state.hasTimedOut:
            waiting += [x for pdf in parts for x in zip(pdf.ms, pdf.score)]
        mark = state.getCurrentWatermarkMs()
        rows = ordered(*zip(*waiting)) if waiting else []
        open_rows = [x for x in rows if x[0] > mark]
        known, fired = timed_step(known, rows[: len(rows) - len(open_rows)], expires)
        # the watermark has passed all frames before the first that waits, so what falls due before it is settled
        known, more = timed_end(known, mark)
        cooling, still, last, held = known
        if not open_rows and (last is None or math.ceil(last + expires) < mark):
            state.remove()
        else:
            marks = [math.ceil(x) for x in (open_rows[0][0] if open_rows else math.inf, last + HOLD_MS - still if held else math.inf, last + expires if last is not None else math.inf) if x < math.inf]
            state.update((cooling, still, last, held, [x[0] for x in open_rows], [x[1] for x in open_rows]))
            state.setTimeoutTimestamp(max(min(marks), mark + 1))
        yield pd.DataFrame([(key[0], at) for at in fired + more], columns=["session_id", "fired_ms"]).astype({"fired_ms": float})

    kept = "cooling boolean, still double, last double, held boolean, ms array<double>, scores array<double>"
    events = events.where("ms is not null and score is not null").withWatermark("ts", delay)
    return events.groupBy("session_id").applyInPandasWithState(run, TIMED, kept, "append", GroupStateTimeout.EventTimeTimeout)


RELAY = "session_id long, frame_seq long, frame_value double, published long, viewers long, online boolean, phase_seq long, off_seq long, messages array<long>"


def relay_step(state: tuple, rows: pd.DataFrame, most: int) -> tuple:
    """Advance a session's relay state (the fields of RELAY after the first) over rows in any order: newest by seq, counts, and a ring of the last messages."""
    frame_seq, frame_value, published, viewers, online, online_seq, phase_seq, off_seq, ring = state
    newer = lambda own, old: old is None or own > old
    ring = list(ring)
    for seq, kind, value in zip(rows.seq.tolist(), rows.kind.tolist(), rows.value.tolist()):
        value = None if value is None or value != value else float(value)
        if kind == "frame":
            published += 1
            if newer(seq, frame_seq):
                frame_seq, frame_value = seq, value
        elif kind == "presence":
            viewers += 1
            if newer(seq, online_seq):
                online, online_seq = value is not None and value > 50, seq
            if value is not None and value <= 50 and newer(seq, off_seq):
                off_seq = seq
        elif kind == "phase":
            phase_seq = seq if newer(seq, phase_seq) else phase_seq
        elif kind == "message":
            ring.append(seq)
    return frame_seq, frame_value, published, viewers, online, online_seq, phase_seq, off_seq, sorted(ring)[-most:]


def relay_updates(steps: DataFrame, most: int = 64) -> DataFrame:
    """Stateful stream of a relay, in update mode: for each session of a batch what a late joiner needs (newest frame, counts, whether online,
    last phase, last time offline, the last messages in order). Batches in any order give the same; a session's state is of fixed size."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (None, None, 0, 0, False, None, None, None, [])
        known = tuple(None if x is None or (isinstance(x, float) and x != x) else x for x in known)
        for pdf in parts:
            known = relay_step(known, pdf, most)
        state.update(known)
        frame_seq, frame_value, published, viewers, online, _, phase_seq, off_seq, ring = known
        whole, real = (lambda x, kind=kind: pd.array([x], dtype=kind) for kind in ("Int64", "Float64"))
        yield pd.DataFrame({"session_id": [key[0]], "frame_seq": whole(frame_seq), "frame_value": real(frame_value), "published": [published], "viewers": [viewers], "online": [online], "phase_seq": whole(phase_seq), "off_seq": whole(off_seq), "messages": [ring]})

    kept = "frame_seq long, frame_value double, published long, viewers long, online boolean, online_seq long, phase_seq long, off_seq long, messages array<long>"
    own = steps.where("seq is not null").select("session_id", "seq", "kind", "value")
    return own.groupBy("session_id").applyInPandasWithState(run, RELAY, kept, "update", GroupStateTimeout.NoTimeout)


def relay_stream(steps: DataFrame, out: str, checkpoint: str, most: int = 64):
    """Keep the newest snapshot of each session in the commit log at ``out``; a batch that is tried again counts once."""
    log = CommitLog(steps.sparkSession, out)

    def put(batch: DataFrame, number: int) -> None:
        log.upsert(written(batch, "batch"), "session_id", writer="relay", number=number)

    return relay_updates(steps, most).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relayed_frames(snapshots: DataFrame) -> DataFrame:
    """``latest_frames`` of snapshots."""
    return snapshots.where("frame_seq is not null").select("session_id", F.col("frame_seq").alias("seq"), F.col("frame_value").alias("value"), (F.col("published") - 1).alias("dropped"))


def relayed_messages(snapshots: DataFrame) -> DataFrame:
    """``last_messages`` of snapshots."""
    return snapshots.select("session_id", F.posexplode("messages").alias("place", "seq")).select("session_id", "seq", (F.col("place") + 1).cast("long").alias("place"))


def relayed_stats(snapshots: DataFrame) -> DataFrame:
    """``session_stats`` of snapshots."""
    return snapshots.select("session_id", "published", F.greatest(F.col("published") - 1, F.lit(0)).alias("dropped"), "viewers", "online")


def relayed_status(snapshots: DataFrame) -> DataFrame:
    """``last_status`` of snapshots."""
    return snapshots.select("session_id", "phase_seq", F.when(F.col("frame_seq") > F.coalesce("off_seq", F.lit(-1)), F.col("frame_seq")).alias("frame_seq"))


def latest_frames(steps: DataFrame) -> DataFrame:
    """Newest frame of each session and how many it overwrote."""
    return steps.where("kind = 'frame'").groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), (F.count("*") - 1).alias("dropped"))


def last_messages(steps: DataFrame, most: int = 64) -> DataFrame:
    """The last messages of each session, in order."""
    w = Window.partitionBy("session_id")
    own = steps.where("kind = 'message'").withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("back") <= most)
    return own.withColumn("place", F.row_number().over(w.orderBy("seq")).cast("long")).select("session_id", "seq", "place")


def session_stats(steps: DataFrame) -> DataFrame:
    frame = F.col("kind") == "frame"
    return steps.groupBy("session_id").agg(F.count_if(frame).alias("published"), F.greatest(F.count_if(frame) - 1, F.lit(0)).alias("dropped"), F.count_if(F.col("kind") == "presence").alias("viewers"), F.coalesce(F.max_by(F.col("value") > 50, F.when(F.col("kind") == "presence", F.col("seq"))), F.lit(False)).alias("online"))


def last_status(steps: DataFrame) -> DataFrame:
    """Last phase and last frame of each session; a frame from before the last time it went offline is cleared."""
    seq = lambda cond: F.max(F.when(cond, F.col("seq")))
    kind = F.col("kind")
    out = steps.groupBy("session_id").agg(seq(kind == "phase").alias("phase_seq"), seq(kind == "frame").alias("frame_seq"), seq((kind == "presence") & (F.col("value") <= 50)).alias("off"))
    return out.withColumn("frame_seq", F.when(F.col("frame_seq") > F.coalesce("off", F.lit(-1)), F.col("frame_seq"))).drop("off")


def current_phase(steps: DataFrame, phases: dict[str, str]) -> DataFrame:
    phase = F.create_map(*(F.lit(x) for kv in phases.items() for x in kv))[F.col("event_type")]
    return steps.withColumn("phase", phase).where("phase is not null").groupBy("session_id").agg(F.max_by("phase", "seq").alias("phase"))


def frame_rate(steps: DataFrame, width: str = "1 second") -> DataFrame:
    return steps.where("kind = 'frame'").groupBy("session_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("frames")).select("session_id", F.col("w.start").alias("start"), "frames")


def step_latency(steps: DataFrame, by: str = "session_id") -> DataFrame:
    """Milliseconds to the step before; null for the first."""
    before = F.lag("ts").over(Window.partitionBy(by).orderBy("ts", "seq"))
    ms = lambda c: F.unix_micros(c) / 1000
    return steps.withColumn("latency_ms", F.bround(ms("ts") - ms(before)).cast("long"))


def incremental_trends(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily defect counts kept current as findings arrive, for update mode: a day's rows and state go when the watermark has passed the day's end, and rows that come later are dropped here (``trend_stream`` keeps them)."""
    day = findings.where(~F.col("verdict").eqNullSafe("unroutable")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "asset_class")
    return day.agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "defect").alias("defects")).select(C.utc_day(F.col("w.start")).alias("day"), "asset_class", "total", "defects")


def trend_stream(findings: DataFrame, out: str, late_out: str, checkpoint: str, late: str = "1 hour"):
    """Two queries over a stream of findings: daily counts, upserted by (day, class), and the rows that came after their day was closed.

    The second one keeps the highest time of the batches before in its commit log and follows the rule of the first one's
    watermark: over the same batches, each finding that has a verdict is either counted or in the late table. Every batch is
    committed once. Metrics of each batch are observed under the name ``findings``."""
    spark = findings.sparkSession
    findings = findings.observe("findings", F.count("*").alias("rows"), F.max("ts").alias("highest"))
    counts, rest = CommitLog(spark, out), CommitLog(spark, late_out)

    def put(batch: DataFrame, number: int) -> None:
        counts.upsert(written(batch, "batch"), "day", "asset_class", writer="trends", number=number)

    def keep(batch: DataFrame, number: int) -> None:
        base = rest.version()
        seen = base.facts.get("highest") if base else None
        known = written(batch.where(~F.col("verdict").eqNullSafe("unroutable")), "batch")
        closes = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
        mark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {late}")
        own = known.where(closes <= mark) if seen is not None else known.limit(0)
        highest = known.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("highest")).first()[0]
        rest.append(own, writer="late", number=number, facts={"highest": max(filter(None, (seen, highest)), default=None)})

    one_mark = "spark.sql.streaming.statefulOperator.allowMultiple"  # off: a batch's late rows are told by the newest watermark
    before = spark.conf.get(one_mark)
    spark.conf.set(one_mark, "false")
    start = lambda df, f, at, mode: df.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", f"{checkpoint}/{at}").trigger(availableNow=True).start()
    try:
        return start(incremental_trends(findings, late), put, "counts", "update"), start(findings, keep, "late", "append")
    finally:
        spark.conf.set(one_mark, before)


def inspected(frames: DataFrame, models: DataFrame, bank: DataFrame, patches_of, floor: float = 0.82) -> DataFrame:
    """Findings of frames: routed, decided, and what was routed scored against its model's bank. Models: name, asset_class, gate, vec, image_threshold."""
    from ..operators.routing import decide, route
    from ..operators.scoring import image_scores, patch_distances, verdict

    decided = written(decide(route(frames, models, floor=floor)).drop("candidates"), "decided")
    routed = decided.where("decision = 'route'").select("frame_id", F.col("best_class").alias("asset_class"))
    scored = image_scores(patch_distances(patches_of(frames).join(routed.hint("merge"), "frame_id"), bank)).select("frame_id", "raw_score")
    thresholds = models.select(F.col("name").alias("best_name"), "image_threshold")
    out = decided.join(scored.hint("merge"), "frame_id", "left").join(thresholds.hint("merge"), "best_name", "left")
    known = F.when(F.col("decision") == "route", verdict("raw_score", "image_threshold")).otherwise("unroutable")
    severity = F.when(F.col("decision") == "route", C.clip01(F.col("raw_score") - F.col("image_threshold") + 0.5)).otherwise(0.0)
    return out.withColumn("verdict", known).withColumn("severity", C.half_even(severity)).withColumn("asset_class", F.when(F.col("decision") == "route", F.col("best_class")))


def inspect_stream(frames: DataFrame, read_models, read_bank, patches_of, out: str, checkpoint: str, floor: float = 0.82):
    """Each micro-batch of frames is routed against the registry as it is then, decided, scored, and appended to the commit log at
    ``out`` as findings. A batch that is tried again after a failure is in the log once; ``CommitLog(spark, out).read()`` sees whole batches only."""
    log = CommitLog(frames.sparkSession, out)

    def one(batch: DataFrame, number: int) -> None:
        own = written(batch, "batch")
        log.append(inspected(own, read_models(), read_bank(), patches_of, floor).withColumn("batch", F.lit(number).cast("long")), writer="inspection", number=number)

    return frames.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
