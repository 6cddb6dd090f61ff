"""Findings analytics: trends, filters, recall and explanations over (finding_id, ts, asset_class, verdict, severity)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Verdicts, and the bounds of the severity buckets.
VERDICTS = ("nominal", "defect", "unroutable")
BUCKETS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.01)


def window_of(now: datetime, days: int) -> tuple[datetime, datetime]:
    """Start and midpoint; odd numbers of days have a half-day midpoint."""
    checked(days=days)
    return now - timedelta(days=days), now - timedelta(hours=12 * days)


def parse_time(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def checked(verdict: str | None = None, days: int | None = None, limit: int | None = None, k: int | None = None) -> None:
    """Raise before anything is planned."""
    if verdict is not None and verdict not in VERDICTS:
        raise ValueError(f"verdict must be one of {VERDICTS}")
    for name, value, most in (("days", days, 365), ("limit", limit, 25), ("k", k, 25)):
        if value is not None and not 1 <= value <= most:
            raise ValueError(f"{name} must be 1 to {most}")


def refusal(verdict="verdict", days="days", limit="limit") -> F.Column:
    """The same guards for a table of requests: why one is refused, null if it is not."""
    ranges = [F.when(~C.col(c).between(1, most), F.lit(f"{name} must be 1 to {most}")) for name, c, most in (("days", days, 365), ("limit", limit, 25))]
    return F.coalesce(F.when(~C.col(verdict).isin(*VERDICTS), F.lit(f"verdict must be one of {VERDICTS}")), *ranges)


def tagged(df: DataFrame, term: str = "image", tags: str = "tags") -> DataFrame:
    """Rows of which any tag contains the term."""
    return df.where(F.exists(tags, lambda t: t.contains(term)))


def find(df: DataFrame, asset_class=None, verdict=None, since=None, until=None) -> DataFrame:
    checked(verdict=verdict)
    for value, test in ((asset_class, F.col("asset_class") == asset_class), (verdict, F.col("verdict") == verdict), (since, F.col("ts") >= F.lit(since)), (until, F.col("ts") <= F.lit(until))):
        if value is not None:
            df = df.where(test)
    return df


def routable(df: DataFrame) -> DataFrame:
    """All but unroutable; a missing verdict stays."""
    return df.where(~F.col("verdict").eqNullSafe("unroutable"))


def defects() -> F.Column:
    return F.count_if(F.col("verdict") == "defect")


def defect_rate_over_time(df: DataFrame, start) -> DataFrame:
    by = routable(df.where(F.col("ts") >= F.lit(start))).groupBy(C.utc_day("ts").alias("day"), "asset_class")
    out = by.agg(F.count("*").alias("total"), defects().alias("defects"), C.half_even(F.coalesce(F.avg("severity"), F.lit(0.0))).alias("mean_severity"))
    return out.withColumn("defect_rate", C.rate("defects", "total"))


def by_asset_class(df: DataFrame, start, midpoint) -> DataFrame:
    late = F.col("ts") >= F.lit(midpoint)
    out = routable(df.where(F.col("ts") >= F.lit(start))).groupBy("asset_class").agg(
        F.count("*").alias("inspections"), defects().alias("defects"), C.half_even(F.coalesce(F.avg("severity"), F.lit(0.0))).alias("mean_severity"), C.half_even(F.max("severity")).alias("max_severity"),
        F.count_if(late).alias("recent"), F.count_if(late & (F.col("verdict") == "defect")).alias("recent_defects"),
    )
    return out.withColumn("defect_rate", C.rate("defects", "inspections")).withColumn("recent_rate", C.rate("recent_defects", "recent"))


def severity_distribution(df: DataFrame, start=None) -> DataFrame:
    s, label = F.col("severity"), F.lit("other")
    for lo, hi in zip(BUCKETS[-2::-1], BUCKETS[:0:-1]):
        label = F.when((s >= lo) & (s < hi), f"{lo:.1f}-{min(hi, 1.0):.1f}").otherwise(label)
    df = df if start is None else df.where(F.col("ts") >= F.lit(start))
    return df.where(s > 0).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def verdict_counts(df: DataFrame, start=None) -> DataFrame:
    return (df if start is None else df.where(F.col("ts") >= F.lit(start))).groupBy("verdict").agg(F.count("*").alias("n"))


def registry_coverage(models: DataFrame, findings: DataFrame) -> DataFrame:
    """Models and classes of each origin, beside the totals: models, distinct classes, inspections."""
    origins = models.groupBy("created_by").agg(F.count("*").alias("models"), F.sort_array(F.collect_set("asset_class")).alias("classes"))
    registry = models.agg(F.count("*").alias("total_models"), F.sort_array(F.collect_set("asset_class")).alias("asset_classes"))
    return origins.join(F.broadcast(registry)).join(F.broadcast(findings.agg(F.count("*").alias("total_inspections"))))  # one row each


def failing_fastest(by_class: DataFrame) -> DataFrame:
    return by_class.withColumn("acceleration", C.half_even(F.col("recent_rate") - F.col("defect_rate"))).orderBy(F.desc("acceleration"), F.desc("defect_rate"), "asset_class")


def direction(accel="acceleration") -> F.Column:
    return F.when(F.col(accel) > 0.01, "rising").when(F.col(accel) < -0.01, "falling").otherwise("flat")


def backfill_disclosure(df: DataFrame, start) -> DataFrame:
    own = df.where(F.col("ts") >= F.lit(start))
    return own.agg(F.count_if("backfilled").alias("shifted"), F.count("*").alias("total")).withColumn("fraction", C.rate("shifted", "total"))


def compute_trends(df: DataFrame, models: DataFrame, days: int, now: datetime) -> dict[str, DataFrame]:
    """All trend tables over one filtered scan; the caller may cache df."""
    start, midpoint = window_of(now, days)
    by_class = by_asset_class(df, start, midpoint)
    return {
        "defect_rate_over_time": defect_rate_over_time(df, start), "by_asset_class": by_class, "severity_distribution": severity_distribution(df, start),
        "verdict_counts": verdict_counts(df, start), "registry_coverage": registry_coverage(models, df), "failing_fastest": failing_fastest(by_class), "backfill_disclosure": backfill_disclosure(df, start),
    }


def query_trends(df: DataFrame, days: int, now: datetime, asset_class: str | None = None, most: int = 25) -> DataFrame:
    """Rates by class after computing; an unknown class gives a zero row with the known classes."""
    start, midpoint = window_of(now, min(max(days, 1), 365))
    rows = failing_fastest(by_asset_class(df, start, midpoint)).select("asset_class", "inspections", "defects", "defect_rate", "recent_rate", "acceleration")
    if asset_class is None:
        return rows.limit(most)
    known = rows.agg(F.sort_array(F.collect_set("asset_class")).alias("known"))
    own = rows.where(F.col("asset_class") == asset_class)
    zero = known.select(F.lit(asset_class).alias("asset_class"), F.lit(0).cast("long").alias("inspections"), F.lit(0).cast("long").alias("defects"), *(F.lit(0.0).alias(c) for c in ("defect_rate", "recent_rate", "acceleration")), "known")
    return own.withColumn("known", F.lit(None).cast("array<string>")).unionByName(zero.where(~F.array_contains("known", asset_class)))


def search_findings(df: DataFrame, limit: int = 25, **conditions) -> DataFrame:
    """Newest first, with how many matched."""
    checked(limit=limit)
    own = find(df, **conditions)
    matched = own.agg(F.count("*").alias("matched"))
    return own.orderBy(F.desc("ts"), "finding_id").limit(limit).join(F.broadcast(matched))  # one row


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first."""
    checked()
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page_size must be 1 to 100 and page 1 or more")
    return df.orderBy(F.desc("ts"), "finding_id").offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def recurrence(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id").agg(F.count("*").alias("matches"), defects().alias("defects"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def explain_refusal(df: DataFrame, finding_id=None) -> DataFrame:
    """Stored candidates of one finding, or of the latest unroutable one, with what each lacked."""
    one = df.where(F.col("finding_id") == finding_id) if finding_id is not None else df.where("verdict = 'unroutable'").orderBy(F.desc("ts"), "finding_id").limit(1)
    each = one.select("finding_id", F.posexplode_outer("candidates").alias("position", "c")).select("finding_id", "position", "c.name", "c.score", "c.gate")
    return each.withColumn("shortfall", C.half_even(F.col("gate") - F.col("score"))).withColumn("cleared_gate", F.col("score") >= F.col("gate")).withColumn("note", F.when(F.col("position").isNull(), "no candidates were recorded"))


def merged_catalogue(hits: DataFrame, chosen: DataFrame, most: int = 60) -> DataFrame:
    """Hits of several search terms merged by dataset, ranked by downloads, with what was chosen."""
    merged = hits.groupBy("dataset_id").agg(F.max("downloads").alias("downloads"), F.sort_array(F.collect_set("term")).alias("terms"))
    top = merged.orderBy(F.desc("downloads"), "dataset_id").limit(most)
    return top.join(chosen, "dataset_id", "left").withColumn("status", F.when(F.col("reason").isNotNull(), "selected").otherwise("rejected")).drop("reason")


def purge(models: DataFrame, findings: DataFrame, datasets: DataFrame, keep: F.Column) -> dict[str, DataFrame]:
    """What stays. A finding goes if its class goes, or if its routed model is known and goes."""
    kept = models.where(keep)
    lost = models.where(~keep).select("asset_class").distinct()
    f = findings.join(lost, "asset_class", "left_anti")
    orphan = f.where("routed_model_id is not null").join(kept.select(F.col("model_id").alias("routed_model_id")), "routed_model_id", "left_anti").select("finding_id")
    return {"models": kept, "findings": f.join(orphan, "finding_id", "left_anti"), "datasets": datasets.join(lost, "asset_class", "left_anti")}


def newest(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), "finding_id"))).where("rn = 1").drop("rn")


def registry_status(models: DataFrame, findings: DataFrame, floor: float) -> DataFrame:
    """Every model with the registry's totals: models, distinct classes in order, findings, and the routing floor."""
    totals = models.agg(F.count("*").alias("models"), F.sort_array(F.collect_set("asset_class")).alias("asset_classes"))
    seen = findings.agg(F.count("*").alias("total_findings"))
    return models.join(F.broadcast(totals)).join(F.broadcast(seen)).withColumn("floor", F.lit(floor))  # one row each


#: What a search of models and of findings returns beside its score; vectors are never among them.
MODEL_FIELDS = ("model_id", "name", "asset_class", "backbone", "training_samples", "image_threshold", "routing_threshold", "metrics", "created_by", "reference_image_id")
FINDING_FIELDS = ("finding_id", "timestamp", "asset_class", "verdict", "severity", "anomaly_score", "raw_anomaly_score", "routed_model_name", "routing_score", "agent_narrative", "uploaded_image_id", "heatmap_id")


def projected(found: DataFrame, rows: DataFrame, fields: tuple[str, ...], key: str, *keep: str) -> DataFrame:
    """Search results with the stated fields of what they found, and their score. A field that rows lack is null; a result whose row is gone is left out."""
    known = rows.select(*(F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))
    return found.join(known.hint("merge"), key).select(*keep, *fields, "score")


def daily_series(findings: DataFrame) -> DataFrame:
    """day, place (from 1 in order) and points: class, defects and inspections of each class that has any that day, by class.

    Counts are made before days are gathered, so a day's row holds one point a class. Findings without a time or class have no point."""
    own = findings.where(F.col("ts").isNotNull() & F.col("asset_class").isNotNull()).groupBy(C.utc_day("ts").alias("day"), "asset_class")
    own = own.agg(F.count_if(F.col("verdict") == "defect").alias("defects"), F.count("*").alias("n"))
    days = own.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("asset_class", "defects", "n"))).alias("points"))
    return days.withColumn("place", F.row_number().over(Window.orderBy("day")))  # one row a day
