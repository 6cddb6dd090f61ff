"""Session events: batch forms; streaming ones run over the same tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.commits import CommitLog
from ..sources.tables import scratch
from ..streaming import sessions as O
from .adapters import FINDINGS, FRAMES, STEPS, findings, frames, patches_of, sql, steps, table
from .registry import query


def streamed(spark, df, build, mode: str):
    """Write rows, read them as a stream, and return what the stream wrote when all were there."""
    at = scratch(spark, "stream")
    df.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{at}/in")
    out = build(stream)

    def put(batch, number):
        batch.write.mode("append" if mode != "complete" else "overwrite").parquet(f"{at}/out")

    out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("st1_motion_score", sql(FRAMES, "l AS (SELECT label AS session_id, frame_id AS seq, list_transform(vec, lambda x: floor(abs(x)*255)::INT) AS luma FROM frames), p AS (SELECT *, lag(luma) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM l)", "SELECT session_id::BIGINT AS session_id, seq, round_even(CASE WHEN before IS NULL THEN 1.0 ELSE list_sum(list_transform(range(1,65), lambda i: abs(luma[i]-before[i])))/64/255 END::DOUBLE,6) AS score FROM p"))
def st1(spark, d):
    f = frames(spark, d).select(F.col("label").cast("long").alias("session_id"), F.col("frame_id").alias("ts"), F.col("frame_id").alias("seq"), F.transform("vec", lambda x: F.floor(F.abs(x) * 255).cast("int")).alias("luma"))
    return O.motion_scores(f).select("session_id", "seq", C.half_even("score", 6).alias("score"))


def hold_events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), (F.unix_micros("ts") / 1000).alias("ms"), (F.col("value") / 5000).alias("score"))


@query("st2_hold_still")
def st2(spark, d):
    return O.hold_still(hold_events(spark, d))


@query("st2_hold_still_stream")
def st2_stream(spark, d):
    return streamed(spark, hold_events(spark, d), O.hold_still_stream, "append")


def timed_events(spark, d):
    """Events in thousandths of their time, so that frames follow each other closely enough for holds."""
    e = table(spark, d, "events").withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / 1000)))
    return e.select(F.col("user_id").alias("session_id"), "ts", (F.unix_micros("ts") / 1000).alias("ms"), (F.col("value") / 5000).alias("score"))


def last_mark(events, delay_ms: int = 10_000):
    """The watermark that a stream over all of the events ends with."""
    return (events.agg(F.floor(F.max(F.unix_micros("ts")) / 1000).alias("top")).first().top or 0) - delay_ms


@query("st2_timed_holds")
def st2_timed(spark, d):
    events = timed_events(spark, d)
    return O.timed_holds(events, last_mark(events))


@query("st2_timed_holds_stream")
def st2_timed_stream(spark, d):
    return streamed(spark, timed_events(spark, d), O.timed_holds_stream, "append")


def relayed(spark, d, batches: int = 3):
    """Snapshots of the relay after a stream of all steps, in micro-batches that mix early and late ones."""
    at, own = scratch(spark, "relay"), steps(spark, d).select("session_id", "seq", "kind", "value")
    own.repartition(batches, "seq").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    O.relay_stream(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return CommitLog(spark, f"{at}/out").read()


ST3 = sql(STEPS, "SELECT session_id, max(seq) AS seq, arg_max(value,seq) AS value, count(*)-1 AS dropped FROM steps WHERE kind='frame' GROUP BY 1")


@query("st3_latest_frames", ST3)
def st3(spark, d):
    return O.latest_frames(steps(spark, d))


@query("st3_latest_frames_stream", ST3)
def st3_stream(spark, d):
    return O.relayed_frames(relayed(spark, d))


ST4 = sql(STEPS, "SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM (SELECT * FROM steps WHERE kind='message' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)<=64)")


@query("st4_last_messages", ST4)
def st4(spark, d):
    return O.last_messages(steps(spark, d))


@query("st4_last_messages_stream", ST4)
def st4_stream(spark, d):
    return O.relayed_messages(relayed(spark, d))


ST5 = sql(STEPS, "SELECT session_id, count(*) FILTER (kind='frame') AS published, greatest(count(*) FILTER (kind='frame')-1,0) AS dropped, count(*) FILTER (kind='presence') AS viewers, coalesce(arg_max(value>50,seq) FILTER (kind='presence'),false) AS online FROM steps GROUP BY 1")


@query("st5_session_stats", ST5)
def st5(spark, d):
    return O.session_stats(steps(spark, d))


@query("st5_session_stats_stream", ST5)
def st5_stream(spark, d):
    return O.relayed_stats(relayed(spark, d))


ST6 = sql(STEPS, "s AS (SELECT session_id, max(seq) FILTER (kind='phase') AS phase_seq, max(seq) FILTER (kind='frame') AS f, max(seq) FILTER (kind='presence' AND value<=50) AS o FROM steps GROUP BY 1)", "SELECT session_id, phase_seq, CASE WHEN f>coalesce(o,-1) THEN f END AS frame_seq FROM s")


@query("st6_last_status", ST6)
def st6(spark, d):
    return O.last_status(steps(spark, d))


@query("st6_last_status_stream", ST6)
def st6_stream(spark, d):
    return O.relayed_status(relayed(spark, d))


@query("st7_phase", sql(STEPS, "SELECT session_id, arg_max(CASE event_type WHEN 'signup' THEN 'routing' WHEN 'purchase' THEN 'done' ELSE 'failed' END, seq) AS phase FROM steps WHERE event_type IN ('signup','purchase','error') GROUP BY 1"))
def st7(spark, d):
    return O.current_phase(steps(spark, d), {"signup": "routing", "purchase": "done", "error": "failed"})


@query("st8_frame_rate", sql(STEPS, "SELECT session_id, strftime(time_bucket(INTERVAL '1 hour', ts),'%Y-%m-%d %H') AS hour, count(*) AS frames FROM steps WHERE kind='frame' GROUP BY ALL"))
def st8(spark, d):
    return O.frame_rate(steps(spark, d), "1 hour").select("session_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "frames")


def inspection_parts(spark, d):
    """Models with a threshold, and the banks of registered classes."""
    from .registry_queries import registry
    from .scoring_queries import banked

    return registry(spark, d).withColumn("image_threshold", F.lit(0.3)), banked(spark, d)[0].where("asset_class <> 'class_9'")


@query("st9_stream_inspection")
def st9(spark, d):
    f, at = frames(spark, d).select("frame_id", "vec"), scratch(spark, "stream")
    models, bank = inspection_parts(spark, d)
    for df, name in ((f, "in"), (models, "models"), (bank, "bank")):
        df.write.parquet(f"{at}/{name}")
    stream = spark.readStream.schema(f.schema).parquet(f"{at}/in")
    read = lambda name: lambda: spark.read.parquet(f"{at}/{name}")
    O.inspect_stream(stream, read("models"), read("bank"), patches_of, f"{at}/out", f"{at}/state", floor=0.0).awaitTermination()
    return CommitLog(spark, f"{at}/out").read().select("frame_id", "decision", "best_name", "asset_class", "verdict", "severity", C.half_even("raw_score", 6).alias("raw_score"))


@query("st10_incremental_trends", sql(FINDINGS, "SELECT strftime(ts,'%Y-%m-%d') AS day, asset_class, count(*) AS total, count(*) FILTER (verdict='defect') AS defects FROM findings WHERE verdict IS DISTINCT FROM 'unroutable' GROUP BY ALL"))
def st10(spark, d):
    return trends(spark, [findings(spark, d)], "counts")


LATE = "known AS (SELECT finding_id, ts, asset_class, verdict, backfilled FROM findings WHERE verdict IS DISTINCT FROM 'unroutable'), mark AS (SELECT max(ts)-INTERVAL 1 HOUR AS closed FROM known WHERE NOT backfilled)"


@query("st10_late_findings", sql(FINDINGS, LATE, "SELECT finding_id, ts, asset_class, verdict FROM known, mark WHERE backfilled AND date_trunc('day',ts)+INTERVAL 1 DAY<=closed"))
def st10_late(spark, d):
    """Backfilled findings arrive after the others, with the streams started anew in between: those of closed days are in the late table."""
    own = findings(spark, d)
    return trends(spark, [own.where("not backfilled"), own.where("backfilled")], "late").select("finding_id", "ts", "asset_class", "verdict")


def trends(spark, parts, name):
    at = scratch(spark, "trends")
    for own in parts:
        own.select("finding_id", "ts", "asset_class", "verdict").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("finding_id string, ts timestamp, asset_class string, verdict string").parquet(f"{at}/in")
        for q in O.trend_stream(stream, f"{at}/counts", f"{at}/late", f"{at}/state"):
            q.awaitTermination()
    return CommitLog(spark, f"{at}/{name}").read()


@query("st11_step_latency", sql(STEPS, "SELECT seq, round_even((epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, seq))/1000,0)::BIGINT AS latency_ms FROM steps"))
def st11(spark, d):
    return O.step_latency(steps(spark, d)).select("seq", "latency_ms")
