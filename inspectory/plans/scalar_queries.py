"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from .adapters import FINDINGS, FRAMES, findings, frames, sql, table
from .registry import query

SLUG = "trim(regexp_replace(lower({}),'[^a-z0-9]+','-','g'),'-')"


@query("str1_slug", f"SELECT p_partkey, {SLUG.format('p_brand')} AS slug FROM part")
def str1(spark, d):
    return table(spark, d, "part").select("p_partkey", C.slug("p_brand").alias("slug"))


@query("str2_model_name", f"SELECT p_partkey, {SLUG.format('''coalesce(CASE WHEN p_size>25 THEN p_name END,'unknown-asset')''')}||'-patchcore-coldstart-v1' AS model_name FROM part")
def str2(spark, d):
    return table(spark, d, "part").select("p_partkey", C.model_name(F.when(F.col("p_size") > 25, F.col("p_name")), F.lit("patchcore")).alias("model_name"))


@query("str3_class_name", f"SELECT p_partkey, replace({SLUG.format('p_brand')},'-','_') AS class_name FROM part")
def str3(spark, d):
    return table(spark, d, "part").select("p_partkey", C.class_name("p_brand").alias("class_name"))


@query("str4_default_name", "SELECT DISTINCT p_type||'-patchcore-v1' AS name FROM part")
def str4(spark, d):
    return table(spark, d, "part").select(C.default_name("p_type").alias("name")).distinct()


@query("str5_truncation", "SELECT doc_id, left(text,400) AS narrative, length(left(text,600)) AS spoken FROM documents")
def str5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 400).alias("narrative"), F.length(F.substring("text", 1, 600)).cast("long").alias("spoken"))


@query("dt1_iso_parse", "SELECT event_id, epoch(try_cast(strftime(ts,'%Y-%m-%dT%H:%M:%S') AS TIMESTAMP))::BIGINT AS at FROM events")
def dt1(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.try_to_timestamp(C.iso("ts"))).alias("at"))


@query("dt2_utc_day", "SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def dt2(spark, d):
    return table(spark, d, "events").groupBy(C.utc_day("ts").alias("day")).agg(F.count("*").alias("n"))


@query("dt3_relative_window", "SELECT count(*) FILTER (ts>=TIMESTAMP '2024-01-30'-INTERVAL 7 DAY) AS inside, count(*) FILTER (ts>=TIMESTAMP '2024-01-30'-INTERVAL 84 HOUR) AS recent FROM events")
def dt3(spark, d):
    now = F.lit("2024-01-30").cast("timestamp")
    return table(spark, d, "events").agg(F.count_if(F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")).alias("inside"), F.count_if(F.col("ts") >= now - F.expr("INTERVAL 84 HOURS")).alias("recent"))


@query("dt4_iso_output", "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def dt4(spark, d):
    return table(spark, d, "events").select("event_id", C.iso("ts").alias("iso"))


@query("arr1_normalise", sql(FRAMES, "SELECT frame_id, round_even(sqrt(list_dot_product(vec,vec)),6) AS norm, round_even(vec[1]/(sqrt(list_dot_product(vec,vec))+1e-12),6) AS first FROM frames"))
def arr1(spark, d):
    return frames(spark, d).select("frame_id", C.half_even(C.l2_norm("vec"), 6).alias("norm"), C.half_even(F.get(C.normalised("vec"), 0), 6).alias("first"))


@query("arr2_unit_score", sql(FRAMES, "SELECT a.frame_id, round_even((1+list_dot_product(a.vec,b.vec))/2,6) AS score FROM frames a JOIN frames b ON b.frame_id=a.frame_id+1"))
def arr2(spark, d):
    f = frames(spark, d)
    nxt = f.select((F.col("frame_id") - 1).alias("frame_id"), F.col("vec").alias("nvec"))
    return f.join(nxt, "frame_id").select("frame_id", C.half_even(C.unit_score(C.dot("vec", "nvec")), 6).alias("score"))


@query("arr3_vector_check", sql(FRAMES, "SELECT count(*) AS total, count(*) FILTER (len(vec)<>64 OR abs(sqrt(list_dot_product(vec,vec))-1)>1e-3) AS failures FROM frames"))
def arr3(spark, d):
    bad = (F.size("vec") != 64) | (F.abs(C.l2_norm("vec") - 1) > 1e-3)
    return frames(spark, d).agg(F.count("*").alias("total"), F.count_if(bad).alias("failures"))


@query("arr4_long_form", sql(FRAMES, "SELECT frame_id, (i-1)::INT AS i, round_even(vec[i],6) AS v FROM frames, (SELECT unnest(range(1,65)) AS i)"))
def arr4(spark, d):
    return frames(spark, d).select("frame_id", F.posexplode("vec").alias("i", "v")).withColumn("v", C.half_even("v", 6))


@query("mth1_clip", sql(FINDINGS, "SELECT finding_id, least(1.0,greatest(0.0,severity-0.3))::DOUBLE AS clipped FROM findings"))
def mth1(spark, d):
    return findings(spark, d).select("finding_id", C.clip01(F.col("severity") - 0.3).alias("clipped"))


@query("mth2_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity/32,4) AS r FROM lineitem")
def mth2(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.half_even(F.col("l_quantity") / 32).alias("r"))


@query("jsn1_step_payload", "SELECT event_id, (props->>'$.k')::INT AS k, event_type||':'||(props->>'$.k') AS line FROM events")
def jsn1(spark, d):
    k = F.get_json_object("props", "$.k")
    parsed = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.concat_ws(":", "event_type", k).alias("line"))


@query("udf1_named_dispatch", sql(FINDINGS, "SELECT finding_id FROM findings WHERE verdict='defect' AND asset_class='LARGE'"))
def udf1(spark, d):
    from ..operators.findings import find
    from .registry import called

    return called(find, {"df": findings(spark, d), "verdict": "defect", "asset_class": "LARGE", "since": None, "unknown": 1}).select("finding_id")
