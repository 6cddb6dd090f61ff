"""Trends, filters, projections and listings over findings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import drift as D
from ..operators import findings as O
from .adapters import DAYS, FINDINGS, FRAMES, NOW, findings, frames, sql, table
from .registry import query

START, MID = (str(x) for x in O.window_of(datetime.fromisoformat(NOW), DAYS))
S, M = f"TIMESTAMP '{START}'", f"TIMESTAMP '{MID}'"
NOT_UNROUTABLE = "verdict IS DISTINCT FROM 'unroutable'"
RATE = "round_even(defects/greatest(total,1), 4)"
BY_CLASS = f"""by_class AS (SELECT *, round_even(defects/greatest(inspections,1),4) AS defect_rate, round_even(recent_defects/greatest(recent,1),4) AS recent_rate FROM (
 SELECT asset_class, count(*) AS inspections, count(*) FILTER (verdict='defect') AS defects, round_even(coalesce(avg(severity),0),4) AS mean_severity, round_even(max(severity),4) AS max_severity,
 count(*) FILTER (ts>={M}) AS recent, count(*) FILTER (ts>={M} AND verdict='defect') AS recent_defects FROM findings WHERE ts>={S} AND {NOT_UNROUTABLE} GROUP BY ALL))"""
FASTEST = "fastest AS (SELECT *, round_even(recent_rate-defect_rate,4) AS acceleration FROM by_class)"
MODELS = "models AS (SELECT 'class_'||label AS asset_class, 'class_'||label||'-patchcore-v1' AS name, CASE WHEN label<7 THEN 'seed' ELSE 'agent-coldstart' END AS created_by, count(*) AS training_samples, label FROM embeddings WHERE label<9 GROUP BY label)"


def models(spark, d):
    f = frames(spark, d).where("label < 9").groupBy("asset_class", "label").agg(F.count("*").alias("training_samples"))
    return f.withColumn("name", C.default_name("asset_class")).withColumn("created_by", F.when(F.col("label") < 7, "seed").otherwise("agent-coldstart"))


def recent_findings(spark, d):
    return findings(spark, d).where(F.col("ts") >= F.lit(START).cast("timestamp"))


@query("tr1_defect_rate_over_time", sql(FINDINGS, f"SELECT *, {RATE} AS defect_rate FROM (SELECT strftime(ts,'%Y-%m-%d') AS day, asset_class, count(*) AS total, count(*) FILTER (verdict='defect') AS defects, round_even(coalesce(avg(severity),0),4) AS mean_severity FROM findings WHERE ts>={S} AND {NOT_UNROUTABLE} GROUP BY ALL)"))
def tr1(spark, d):
    return O.defect_rate_over_time(findings(spark, d), F.lit(START).cast("timestamp"))


@query("tr2_by_asset_class", sql(FINDINGS, BY_CLASS, "SELECT * FROM by_class"))
def tr2(spark, d):
    return O.by_asset_class(findings(spark, d), F.lit(START).cast("timestamp"), F.lit(MID).cast("timestamp"))


@query("tr3_severity_distribution", sql(FINDINGS, f"SELECT CASE WHEN severity<0.2 THEN '0.0-0.2' WHEN severity<0.4 THEN '0.2-0.4' WHEN severity<0.6 THEN '0.4-0.6' WHEN severity<0.8 THEN '0.6-0.8' WHEN severity<1.01 THEN '0.8-1.0' ELSE 'other' END AS bucket, count(*) AS n FROM findings WHERE severity>0 AND ts>={S} GROUP BY 1"))
def tr3(spark, d):
    return O.severity_distribution(findings(spark, d), F.lit(START).cast("timestamp"))


@query("tr4_verdict_counts", sql(FINDINGS, f"SELECT verdict, count(*) AS n FROM findings WHERE ts>={S} GROUP BY 1"))
def tr4(spark, d):
    return O.verdict_counts(findings(spark, d), F.lit(START).cast("timestamp"))


COVERAGE = "coverage AS (SELECT created_by, count(*) AS models, array_to_string(list_sort(list(DISTINCT asset_class)),',') AS classes, (SELECT count(*) FROM models) AS total_models, (SELECT array_to_string(list_sort(list(DISTINCT asset_class)),',') FROM models) AS asset_classes, (SELECT count(*) FROM findings) AS total_inspections FROM models GROUP BY 1)"


@query("tr5_registry_coverage", sql(FINDINGS, MODELS, COVERAGE, "SELECT * FROM coverage"))
def tr5(spark, d):
    return O.registry_coverage(models(spark, d), findings(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("classes", "asset_classes")})


@query("tr6_failing_fastest", sql(FINDINGS, BY_CLASS, FASTEST, "SELECT * FROM fastest"))
def tr6(spark, d):
    return O.failing_fastest(tr2(spark, d))


BACKFILL = f"backfill AS (SELECT *, round_even(shifted/greatest(total,1),4) AS fraction FROM (SELECT count(*) FILTER (backfilled) AS shifted, count(*) AS total FROM findings WHERE ts>={S}))"


@query("tr7_backfill_disclosure", sql(FINDINGS, BACKFILL, "SELECT * FROM backfill"))
def tr7(spark, d):
    return O.backfill_disclosure(findings(spark, d), F.lit(START).cast("timestamp"))


#: What each part of the trends says, as (part, key, value).
TREND_VALUES = {
    "by_asset_class": ("asset_class", "defect_rate"), "failing_fastest": ("asset_class", "acceleration"), "defect_rate_over_time": ("concat_ws(' ', day, asset_class)", "mean_severity"), "severity_distribution": ("bucket", "n"),
    "verdict_counts": ("verdict", "n"), "registry_coverage": ("created_by", "models + 1000 * total_models + total_inspections"), "backfill_disclosure": ("'all'", "fraction"),
}
TR8_SQL = " UNION ALL ".join(
    f"SELECT '{part}' AS part, {key} AS key, ({value})::DOUBLE AS value FROM ({source})"
    for (part, (key, value)), source in zip(
        TREND_VALUES.items(),
        (
            "SELECT * FROM by_class", "SELECT * FROM fastest", f"SELECT strftime(ts,'%Y-%m-%d') AS day, asset_class, round_even(coalesce(avg(severity),0),4) AS mean_severity FROM findings WHERE ts>={S} AND {NOT_UNROUTABLE} GROUP BY ALL",
            f"SELECT CASE WHEN severity<0.2 THEN '0.0-0.2' WHEN severity<0.4 THEN '0.2-0.4' WHEN severity<0.6 THEN '0.4-0.6' WHEN severity<0.8 THEN '0.6-0.8' WHEN severity<1.01 THEN '0.8-1.0' ELSE 'other' END AS bucket, count(*) AS n FROM findings WHERE severity>0 AND ts>={S} GROUP BY 1",
            f"SELECT verdict, count(*) AS n FROM findings WHERE ts>={S} GROUP BY 1", "SELECT * FROM coverage", "SELECT * FROM backfill",
        ),
    )
)


@query("tr8_compute_trends", sql(FINDINGS, BY_CLASS, FASTEST, MODELS, COVERAGE, BACKFILL, TR8_SQL))
def tr8(spark, d):
    parts = O.compute_trends(findings(spark, d), models(spark, d), DAYS, datetime.fromisoformat(NOW))
    out = None
    for part, (key, value) in TREND_VALUES.items():
        own = parts[part].select(F.lit(part).alias("part"), F.expr(key).alias("key"), F.expr(value).cast("double").alias("value"))
        out = own if out is None else out.unionAll(own)
    return out


@query("tr9_query_trends", sql(FINDINGS, BY_CLASS, FASTEST, "SELECT asset_class, inspections, defects, defect_rate, recent_rate, acceleration FROM fastest"))
def tr9(spark, d):
    return O.query_trends(findings(spark, d), DAYS, datetime.fromisoformat(NOW))


@query("tr9_unknown_class", sql(FINDINGS, BY_CLASS, "SELECT 'ABSENT' AS asset_class, 0::BIGINT AS inspections, 0::BIGINT AS defects, 0.0::DOUBLE AS defect_rate, 0.0::DOUBLE AS recent_rate, 0.0::DOUBLE AS acceleration, array_to_string(list_sort(list(asset_class)),',') AS known FROM by_class"))
def tr9_unknown(spark, d):
    return O.query_trends(findings(spark, d), DAYS, datetime.fromisoformat(NOW), "ABSENT").withColumn("known", F.array_join("known", ","))


@query("tr10_cold_started", sql(MODELS, "SELECT count(*) FILTER (created_by='agent-coldstart') AS cold_started FROM models"))
def tr10(spark, d):
    return models(spark, d).agg(F.count_if(F.col("created_by") == "agent-coldstart").alias("cold_started"))


@query("prj11_trend_direction", sql(FINDINGS, BY_CLASS, FASTEST, "SELECT asset_class, CASE WHEN acceleration>0.01 THEN 'rising' WHEN acceleration<-0.01 THEN 'falling' ELSE 'flat' END AS direction, round_even(abs(acceleration)*100,2) AS points FROM fastest"))
def prj11(spark, d):
    return tr6(spark, d).select("asset_class", O.direction().alias("direction"), C.half_even(F.abs("acceleration") * 100, 2).alias("points"))


@query("prj12_daily_series", sql(FINDINGS, f"own AS (SELECT strftime(ts,'%Y-%m-%d') AS day, asset_class, count(*) AS n, count(*) FILTER (verdict='defect') AS defects FROM findings WHERE ts>={S} GROUP BY ALL)", "SELECT day, row_number() OVER (ORDER BY day) AS place, string_agg(asset_class||'='||defects||'/'||n, ';' ORDER BY asset_class) AS series FROM own GROUP BY 1"))
def prj12(spark, d):
    """Sorted days with the points of all classes; a class without inspections on a day has none there."""
    point = lambda p: F.concat(p["asset_class"], F.lit("="), p["defects"].cast("string"), F.lit("/"), p["n"].cast("string"))
    return O.daily_series(recent_findings(spark, d)).select("day", F.col("place").cast("long").alias("place"), F.array_join(F.transform("points", point), ";").alias("series"))


@query("fs1_search_findings", sql(FINDINGS, f"SELECT finding_id, severity, verdict, (SELECT count(*) FROM findings WHERE verdict='defect' AND asset_class='PROMO' AND ts>={S}) AS matched FROM findings WHERE verdict='defect' AND asset_class='PROMO' AND ts>={S} ORDER BY ts DESC, finding_id LIMIT 25"))
def fs1(spark, d):
    return O.search_findings(findings(spark, d), 25, verdict="defect", asset_class="PROMO", since=F.lit(START).cast("timestamp")).select("finding_id", "severity", "verdict", "matched")


@query("fs2_page", sql(FINDINGS, "SELECT finding_id, verdict FROM findings ORDER BY ts DESC, finding_id LIMIT 100 OFFSET 200"))
def fs2(spark, d):
    return O.page(findings(spark, d), 3, 100).select("finding_id", "verdict")


@query("fs2_page_count", sql(FINDINGS, "SELECT count(*) AS total, greatest(1, ceil(count(*)/100))::BIGINT AS pages FROM findings"))
def fs2_count(spark, d):
    return O.page_count(findings(spark, d), 100)


@query("fs6_registry_status", sql(FINDINGS, MODELS, "SELECT name, asset_class, created_by, training_samples, 0.82::DOUBLE AS floor, (SELECT count(*) FROM models) AS models, (SELECT string_agg(asset_class, ',' ORDER BY asset_class) FROM (SELECT DISTINCT asset_class FROM models)) AS asset_classes, (SELECT count(*) FROM findings) AS total_findings FROM models"))
def fs6(spark, d):
    return O.registry_status(models(spark, d), findings(spark, d), 0.82).select("name", "asset_class", "created_by", "training_samples", "floor", "models", F.array_join("asset_classes", ",").alias("asset_classes"), "total_findings")


@query("fs7_model_listing", sql(MODELS, "SELECT row_number() OVER (ORDER BY label) AS place, name, '/image/'||name AS reference_url FROM models"))
def fs7(spark, d):
    m = models(spark, d)
    before = m.select(F.col("label").alias("other"))
    place = m.join(F.broadcast(before.agg(F.sort_array(F.collect_list("other")).alias("all"))))  # one row of one label a model
    return place.select(F.array_position("all", F.col("label")).alias("place"), "name", C.image_url("name").alias("reference_url"))


@query("fs8_health_counts", sql(FINDINGS, MODELS, "SELECT (SELECT count(*) FROM models) AS models, (SELECT count(*) FROM findings) AS findings"))
def fs8(spark, d):
    return models(spark, d).agg(F.count("*").alias("models")).join(F.broadcast(findings(spark, d).agg(F.count("*").alias("findings"))))  # one row each


@query("fs9_catalogue", "SELECT source AS dataset_id, max(n_chars) AS downloads, array_to_string(list_sort(list(DISTINCT lang)),',') AS terms, CASE WHEN source IN ('src1','src2') THEN 'selected' ELSE 'rejected' END AS status FROM documents GROUP BY source ORDER BY downloads DESC, dataset_id LIMIT 60")
def fs9(spark, d):
    hits = table(spark, d, "documents").select(F.col("source").alias("dataset_id"), F.col("n_chars").alias("downloads"), F.col("lang").alias("term"))
    chosen = spark.createDataFrame([("src1", "good"), ("src2", "good")], "dataset_id string, reason string")
    return O.merged_catalogue(hits, chosen).withColumn("terms", F.array_join("terms", ","))


@query("flt1_findings_filter", sql(FINDINGS, f"SELECT finding_id FROM findings WHERE asset_class='SMALL' AND verdict='nominal' AND ts>={S} AND ts<={M}"))
def flt1(spark, d):
    return O.find(findings(spark, d), "SMALL", "nominal", F.lit(START).cast("timestamp"), F.lit(MID).cast("timestamp")).select("finding_id")


REQUESTS = "requests AS (SELECT CASE WHEN l_linenumber=7 THEN 'maybe' ELSE verdict END AS verdict, l_suppkey*40 AS days, l_linenumber*5 AS lim FROM findings)"


@query("flt2_argument_guards", sql(FINDINGS, REQUESTS, "SELECT CASE WHEN verdict NOT IN ('nominal','defect','unroutable') THEN 'verdict' WHEN days NOT BETWEEN 1 AND 365 THEN 'days' WHEN lim NOT BETWEEN 1 AND 25 THEN 'limit' ELSE 'none' END AS refused_for, count(*) AS n FROM requests GROUP BY 1"))
def flt2(spark, d):
    verdict = F.when(F.col("l_linenumber") == 7, "maybe").otherwise(F.col("verdict"))
    asked = findings(spark, d).select(verdict.alias("verdict"), (F.col("l_suppkey") * 40).alias("days"), (F.col("l_linenumber") * 5).alias("limit"))
    return asked.groupBy(F.coalesce(F.split(O.refusal(), " ")[0], F.lit("none")).alias("refused_for")).agg(F.count("*").alias("n"))


@query("flt3_scope_filter", sql(FINDINGS, "SELECT asset_class, count(*) AS n FROM findings WHERE asset_class IN ('PROMO') OR contains(lower(asset_class),'eco') GROUP BY 1"))
def flt3(spark, d):
    return findings(spark, d).where(F.col("asset_class").isin("PROMO") | F.lower("asset_class").contains("eco")).groupBy("asset_class").agg(F.count("*").alias("n"))


@query("flt5_searchable", "SELECT count(*) AS searchable FROM embeddings WHERE len(embedding)>0")
def flt5(spark, d):
    return table(spark, d, "embeddings").where(C.searchable("embedding")).agg(F.count("*").alias("searchable"))


@query("flt6_image_bearing", "SELECT doc_id FROM (SELECT doc_id, [coalesce(lang,''), CASE WHEN n_chars>1000 THEN 'many-images' ELSE 'text' END] AS tags FROM documents) WHERE len(list_filter(tags, lambda t: contains(t,'image')))>0")
def flt6(spark, d):
    tags = F.array(F.coalesce("lang", F.lit("")), F.when(F.col("n_chars") > 1000, "many-images").otherwise("text"))
    return O.tagged(table(spark, d, "documents").select("doc_id", tags.alias("tags"))).select("doc_id")


@query("prj3_serialise", "SELECT vec_id AS id, len(embedding)::INT AS embedding_dim, strftime(TIMESTAMP '2024-01-01'+to_hours(vec_id::INT),'%Y-%m-%dT%H:%M:%S') AS timestamp FROM embeddings")
def prj3(spark, d):
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("vec_id").cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("embedding_dim"), C.iso(ts).alias("timestamp"))


@query("prj4_speech_row", sql(FINDINGS, "SELECT finding_id, round_even(coalesce(severity,0.0),3) AS severity, round_even(1-l_tax,4) AS routing_score, left('Finding '||finding_id||' is '||verdict,400) AS narrative FROM findings"))
def prj4(spark, d):
    text = F.concat(F.lit("Finding "), F.col("finding_id"), F.lit(" is "), F.col("verdict"))
    return findings(spark, d).select("finding_id", C.half_even(F.coalesce("severity", F.lit(0.0)), 3).alias("severity"), C.half_even(1 - F.col("l_tax")).alias("routing_score"), F.substring(text, 1, 400).alias("narrative"))


@query("prj5_result_payload", sql(FINDINGS, "SELECT finding_id, verdict, CASE WHEN verdict='unroutable' THEN NULL ELSE '/image/'||l_orderkey END AS heatmap_url, severity FROM findings"))
def prj5(spark, d):
    heat = F.when(F.col("verdict") != "unroutable", F.col("l_orderkey").cast("string"))
    payload = F.struct("finding_id", "verdict", C.image_url(heat).alias("heatmap_url"), "severity").alias("p")
    return findings(spark, d).select(payload).select("p.*")


@query("prj6_image_url", "SELECT page_id, '/image/'||nullif(page_id%3,0) AS image_url FROM pages")
def prj6(spark, d):
    return table(spark, d, "pages").select("page_id", C.image_url(F.nullif(F.col("page_id") % 3, F.lit(0)).cast("string")).alias("image_url"))


@query("prj8_licence_label", "SELECT doc_id, CASE WHEN starts_with(source,'src1') THEN 'NC' WHEN starts_with(source,'src2') THEN 'BY' ELSE 'unspecified' END AS licence FROM documents")
def prj8(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.when(s.startswith("src1"), "NC").when(s.startswith("src2"), "BY").otherwise("unspecified").alias("licence"))


@query("prj9_severity_band", sql(FINDINGS, "SELECT CASE WHEN severity>=0.75 THEN 'high' WHEN severity>=0.5 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM findings GROUP BY 1"))
def prj9(spark, d):
    return findings(spark, d).groupBy(C.severity_band("severity").alias("band")).agg(F.count("*").alias("n"))


@query("prj10_map_radius", sql(FINDINGS, "SELECT finding_id, round_even(least(greatest((1-(1-l_tax*3))/(1-0.7)*100,10),100),4) AS radius, (1-l_tax*3)>=0.9 AS inside FROM findings"))
def prj10(spark, d):
    score = 1 - F.col("l_tax") * 3
    return findings(spark, d).select("finding_id", C.half_even(F.least(F.greatest((1 - score) / F.lit(1 - 0.7) * 100, F.lit(10.0)), F.lit(100.0))).alias("radius"), (score >= 0.9).alias("inside"))


@query("jn2_finding_lookup", sql(FINDINGS, "SELECT finding_id, verdict FROM findings WHERE finding_id IN (SELECT min(finding_id) FROM findings GROUP BY asset_class)"))
def jn2(spark, d):
    f = findings(spark, d)
    return f.join(f.groupBy("asset_class").agg(F.min("finding_id").alias("finding_id")).select("finding_id"), "finding_id", "left_semi").select("finding_id", "verdict")


@query("jn11_purge", sql(FINDINGS, "SELECT 'findings' AS part, count(*) AS n FROM findings WHERE asset_class NOT IN ('SMALL') AND (verdict='unroutable' OR l_suppkey%5<>0) UNION ALL SELECT 'models', count(*) FROM (SELECT DISTINCT asset_class, l_suppkey%5 AS m FROM findings WHERE asset_class<>'SMALL' AND l_suppkey%5<>0) UNION ALL SELECT 'datasets', count(DISTINCT asset_class) FROM findings WHERE asset_class<>'SMALL'"))
def jn11(spark, d):
    f = findings(spark, d).withColumn("m", F.col("l_suppkey") % 5).withColumn("routed_model_id", F.when(F.col("verdict") != "unroutable", F.concat_ws("/", "asset_class", "m")))
    m = f.select("asset_class", "m", F.concat_ws("/", "asset_class", "m").alias("model_id")).distinct()
    small = m.where("asset_class = 'SMALL' or m <> 0")  # a class goes only if one of its models does for scope
    parts = O.purge(small, f, f.select("asset_class").distinct(), F.col("asset_class") != "SMALL")
    count = lambda k: parts[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"))
    return count("findings").unionAll(count("models")).unionAll(count("datasets"))


@query("snk4_findings_append", sql(FINDINGS, "SELECT finding_id, verdict, severity, strftime(ts,'%Y-%m-%d') AS day FROM findings"))
def snk4(spark, d):
    from ..sources.tables import append_findings, scratch

    rows, at = findings(spark, d), scratch(spark, "findings")
    for new in (rows.where(~F.col("backfilled")), rows.where("backfilled")):
        append_findings(new, at)
    schema = rows.withColumn("day", C.utc_day("ts")).schema
    return spark.read.schema(schema).parquet(at).select("finding_id", "verdict", "severity", "day")


@query("snk6_embedding_backfill", "SELECT count(*) FILTER (l.vec_id IS NOT NULL) AS done, count(*) FILTER (l.vec_id IS NULL) AS failed FROM (SELECT event_id FROM events WHERE event_type='error') e LEFT JOIN embeddings l ON l.vec_id=e.event_id")
def snk6(spark, d):
    from ..sources.tables import backfill_embeddings

    own = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("finding_id"), F.col("event_id").alias("image_id"), F.lit(None).cast("array<float>").alias("embedding"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vec"))
    out = backfill_embeddings(own, vectors)
    return out.agg(F.count_if(C.searchable("embedding")).alias("done"), F.count_if(~C.searchable("embedding")).alias("failed"))


@query("snk7_timestamp_shift", sql(FINDINGS, "SELECT finding_id, CASE WHEN backfilled THEN strftime(ts - to_days(('0x'||substr(md5('1234:'||finding_id),1,2))::INT % 30),'%Y-%m-%d') ELSE strftime(ts,'%Y-%m-%d') END AS day, strftime(ts,'%Y-%m-%d') AS observed_at FROM findings"))
def snk7(spark, d):
    from ..sources.tables import shifted

    return shifted(findings(spark, d), 30).select("finding_id", C.utc_day("ts").alias("day"), C.utc_day("observed_at").alias("observed_at"))


@query("rt11_explain_refusal", sql(FINDINGS, "one AS (SELECT * FROM findings WHERE verdict='unroutable' ORDER BY ts DESC, finding_id LIMIT 1), c AS (SELECT finding_id, 0 AS position, 'a' AS name, round_even(0.9-l_tax,4) AS score, 0.88::DOUBLE AS gate FROM one UNION ALL SELECT finding_id, 1, 'b', round_even(0.8-l_tax,4), 0.75::DOUBLE FROM one)", "SELECT *, round_even(gate-score,4) AS shortfall, score>=gate AS cleared_gate, NULL::VARCHAR AS note FROM c"))
def rt11(spark, d):
    c = lambda n, base, gate: F.struct(F.lit(n).alias("name"), C.half_even(base - F.col("l_tax")).alias("score"), F.lit(gate).alias("gate"))
    return O.explain_refusal(findings(spark, d).withColumn("candidates", F.array(c("a", 0.9, 0.88), c("b", 0.8, 0.75))))


SKETCH = """sketch AS (SELECT split_part(asset_class,' ',1) AS model, strftime(ts,'%Y-%m') AS period, floor(severity::DOUBLE/0.05)::BIGINT AS bin, count(*) AS n FROM findings
 WHERE verdict IS DISTINCT FROM 'unroutable' GROUP BY ALL)"""
DRIFT = (
    FINDINGS, SKETCH, "ranked AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY period) AS turn FROM sketch)",
    "base AS (SELECT model, bin, sum(n) AS m FROM ranked WHERE turn<=6 GROUP BY ALL), later AS (SELECT * FROM ranked WHERE turn>6)",
    "places AS (SELECT * FROM (SELECT DISTINCT model, period FROM later) JOIN (SELECT DISTINCT model, bin FROM ranked) USING (model))",
    "filled AS (SELECT model, period, bin, coalesce(n,0) AS n, coalesce(m,0) AS m FROM places LEFT JOIN later USING (model, period, bin) LEFT JOIN base USING (model, bin))",
    "gaps AS (SELECT *, abs((sum(n) OVER b)::DOUBLE/(sum(n) OVER a)::DOUBLE-(sum(m) OVER b)::DOUBLE/(sum(m) OVER a)::DOUBLE) AS gap FROM filled WINDOW a AS (PARTITION BY model, period), b AS (PARTITION BY model, period ORDER BY bin))",
    "far AS (SELECT model, period, sum(n)::DOUBLE AS n, sum(m)::DOUBLE AS m, max(gap) AS distance FROM gaps GROUP BY ALL), z AS (SELECT *, distance*sqrt(n*m/(n+m)) AS z FROM far)",
    "sums AS (SELECT *, sum(z-1.36) OVER (PARTITION BY model ORDER BY period) AS c FROM z), ex AS (SELECT *, c-least(0.0, min(c) OVER (PARTITION BY model ORDER BY period)) AS excess FROM sums)",
    "drifted AS (SELECT *, max((excess>2.0)::INT) OVER (PARTITION BY model ORDER BY period)=1 AS stale FROM ex)",
)


def drifted(spark, d):
    """Scores of the findings of a family of models by month."""
    own = findings(spark, d).where(~F.col("verdict").eqNullSafe("unroutable"))
    return D.drift(D.score_sketch(own.select(F.split_part("asset_class", F.lit(" "), F.lit(1)).alias("model"), F.date_format("ts", "yyyy-MM").alias("period"), F.col("severity").cast("double").alias("score"))))


@query("v2d_drift_by_period", sql(*DRIFT, "SELECT model, period, n::BIGINT AS n, round_even(distance,6) AS distance, round_even(excess,4) AS excess, stale FROM drifted"))
def v2d_by_period(spark, d):
    return drifted(spark, d).select("model", "period", "n", C.half_even("distance", 6).alias("distance"), C.half_even("excess", 4).alias("excess"), "stale")


@query("v2d_stale_models", sql(*DRIFT, "SELECT model, count(*) AS periods, min(period) FILTER (stale) AS since FROM drifted GROUP BY 1"))
def v2d_stale(spark, d):
    return D.stale_models(drifted(spark, d))
