"""The given tables as frames, findings, boxes, patches and maps, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

NOW, DAYS = "2001-11-05 00:00:00", 365


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"}) if "timestamp_ntz" in dict(df.dtypes).values() else df


def frames(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    df = e.select(F.col("vec_id").alias("frame_id"), C.as_doubles("embedding").alias("vec"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("asset_class"), F.col("label"))
    return df.withColumn("ord", C.stable_order("frame_id"))


FRAMES = "frames AS (SELECT vec_id AS frame_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, 'class_'||label AS asset_class, label, md5('1234:'||vec_id) AS ord FROM embeddings)"


def findings(spark, d) -> DataFrame:
    li, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_type")
    df = li.join(part, li.l_partkey == part.p_partkey)
    verdict = F.when(F.col("l_returnflag") == "R", "defect").when(F.col("l_returnflag") == "N", "nominal").otherwise("unroutable")
    fid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_timestamp("l_shipdate"))
    return df.select(
        fid.alias("finding_id"), F.col("l_shipdate").alias("ts"), F.col("p_type").alias("asset_class"), verdict.alias("verdict"),
        F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_discount") * 10).alias("severity"), (F.col("l_linenumber") % 4 == 0).alias("backfilled"),
        "l_orderkey", "l_linenumber", "l_tax", "l_suppkey",
    )


FINDINGS = """findings AS (SELECT l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||epoch(l_shipdate)::BIGINT AS finding_id, l_shipdate AS ts, p_type AS asset_class,
 CASE l_returnflag WHEN 'R' THEN 'defect' WHEN 'N' THEN 'nominal' ELSE 'unroutable' END AS verdict, CASE WHEN l_returnflag='A' THEN 0.0 ELSE l_discount*10 END AS severity,
 l_linenumber%4=0 AS backfilled, l_orderkey, l_linenumber, l_tax, l_suppkey FROM lineitem JOIN part ON l_partkey=p_partkey)"""

LABELS = ["tower", "cable", "broken", "vegetation"]


def boxes(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    x0, y0 = (F.col("l_partkey") * 37 % 560).cast("double"), (F.col("l_suppkey") * 53 % 560).cast("double")
    return li.select(
        F.col("l_orderkey").alias("frame_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("box_id"), label.alias("label"), x0.alias("x0"), y0.alias("y0"),
        F.least(x0 + 20 + 4 * F.col("l_quantity"), F.lit(640.0)).alias("x1"), F.least(y0 + 20 + F.col("l_partkey") % 100, F.lit(640.0)).alias("y1"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS frame_id, l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||l_quantity::INT AS box_id,
 ['tower','cable','broken','vegetation'][l_linenumber%4+1] AS label, x0, y0, least(x0+20+4*l_quantity, 640.0)::DOUBLE AS x1, least(y0+20+l_partkey%100, 640.0)::DOUBLE AS y1
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_partkey*37%560)::DOUBLE AS x0, (l_suppkey*53%560)::DOUBLE AS y0 FROM lineitem))"""


def patches_of(f: DataFrame, *columns: str) -> DataFrame:
    """Eight patches of each frame's vector."""
    return f.select("frame_id", *columns, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vec", i * 8 + 1, 8))).alias("patch_id", "pvec"))


def patches(spark, d) -> DataFrame:
    return patches_of(frames(spark, d), "asset_class", "ord")


PATCHES = "patches AS (SELECT frame_id, asset_class, ord, i AS patch_id, vec[i*8+1:i*8+8] AS pvec FROM frames, (SELECT unnest(range(8)) AS i))"


def map_cells(spark, d) -> DataFrame:
    f = frames(spark, d).select("frame_id", "asset_class", F.posexplode("vec").alias("i", "e"))
    return f.select("frame_id", "asset_class", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.abs("e").alias("v"))


CELLS = "cells AS (SELECT frame_id, asset_class, ((i-1)//8)::INT AS y, ((i-1)%8)::INT AS x, abs(vec[i]) AS v FROM frames, (SELECT unnest(range(1,65)) AS i))"


def corpus_rows(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels.select("doc_id", "toxic"), "doc_id").select(F.col("doc_id").alias("row_id"), F.col("source").alias("asset_class"), F.col("toxic").alias("label"), F.coalesce("lang", F.lit("")).alias("defect"), F.sha2("text", 256).alias("sha"), "n_chars", C.stable_order("doc_id").alias("ord"))


CORPUS = "corpus AS (SELECT doc_id AS row_id, source AS asset_class, toxic AS label, coalesce(lang,'') AS defect, sha256(text) AS sha, n_chars, md5('1234:'||doc_id) AS ord FROM documents JOIN labels USING (doc_id))"


def steps(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "frame").when(F.col("event_type") == "error", "message").when(F.col("event_type") == "signup", "phase").otherwise("presence")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), "value", "event_type")


STEPS = "steps AS (SELECT user_id AS session_id, event_id AS seq, ts, CASE WHEN event_type IN ('click','view') THEN 'frame' WHEN event_type='error' THEN 'message' WHEN event_type='signup' THEN 'phase' ELSE 'presence' END AS kind, value, event_type FROM events)"


def sql(*parts: str) -> str:
    """WITH of all but the last part, then the last."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
