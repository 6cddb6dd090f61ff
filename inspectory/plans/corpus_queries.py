"""Corpus curation and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import corpus as O
from ..operators.ranks import numbered
from ..sources import tables as S
from .adapters import BOXES, CORPUS, boxes, corpus_rows, sql, table
from .registry import query

SCHEMA = S.CorpusSchema(image="text", label="toxic", defect="lang", category="source")


def labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("src1_label_scan", "SELECT doc_id, toxic=0 AS normal, toxic=1 AS anomalous, coalesce(lang,'') AS defect FROM documents JOIN labels USING (doc_id) WHERE source='src1'")
def src1(spark, d):
    return S.scan_labels(labelled(spark, d), SCHEMA, "src1", "doc_id")


@query("src2_schema_mapping", "SELECT doc_id, toxic=1 AS normal, toxic=0 AS anomalous, coalesce(lang,'') AS defect FROM documents JOIN labels USING (doc_id)")
def src2(spark, d):
    inverted = S.CorpusSchema(image="text", label="toxic", defect="lang", category="source", normal_label=1, anomaly_label=0)
    return S.scan_labels(labelled(spark, d), inverted, None, "doc_id")


@query("src3_materialise", sql(CORPUS, "chosen AS (SELECT row_id, row_number() OVER (PARTITION BY asset_class ORDER BY ord) AS place FROM corpus QUALIFY place<=5)", "SELECT row_id, place, length(text) AS n FROM chosen JOIN documents ON doc_id=row_id"))
def src3(spark, d):
    from pyspark.sql import Window

    chosen = corpus_rows(spark, d).select("row_id", F.row_number().over(Window.partitionBy("asset_class").orderBy("ord")).alias("place")).where("place <= 5")
    text = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return S.materialise(chosen, text).select("row_id", "place", F.length("text").cast("long").alias("n"))


@query("src4_split_files", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def src4(spark, d):
    return S.split_files(spark, f"{d}", "documents", "{split}.parquet").groupBy("lang").agg(F.count("*").alias("n"))


@query("src5_folder_layout", "SELECT page_id, regexp_extract(url,'com/([^/?]*)',1) AS part, regexp_extract(url,'https?://([^/]*)',1) AS host FROM pages")
def src5(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "com/([^/?]*)", 1).alias("part"), F.regexp_extract("url", "https?://([^/]*)", 1).alias("host"))


CAPTURED = "captured AS (SELECT doc_id, source||'/'||lpad(doc_id::VARCHAR,12,'0')||['.png','.JPG','.txt','.tiff','.webp.part'][n_chars%5+1] AS path FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL)"


@query("src6_capture_scan", sql(CAPTURED, "held AS (SELECT min(string_split(path,'/')[2]) AS name FROM captured GROUP BY string_split(path,'/')[1])", "SELECT path, string_split(path,'/')[2] AS name, CASE WHEN string_split(path,'/')[2] IN (SELECT name FROM held) THEN 'held_out' ELSE 'train_good' END AS split FROM captured WHERE regexp_matches(lower(path),'\\.(png|jpg|jpeg|bmp|tif|tiff|webp)$')"))
def src6(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".txt", ".tiff", ".webp.part"))), (F.col("n_chars") % 5 + 1).cast("int"))
    paths = table(spark, d, "documents").where("source is not null and n_chars is not null").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), end).alias("path"))
    name = F.split("path", "/")[1]
    held = paths.groupBy(F.split("path", "/")[0]).agg(F.min(name).alias("name"))  # one withheld file of each folder
    return S.scan_capture_dir(paths, held.select("name"))


@query("src7_annotated_boxes", sql(BOXES, "SELECT frame_id, label, x0, y0, x1, y1 FROM boxes"))
def src7(spark, d):
    number = {"tower": 0, "cable": 1, "broken": 2, "vegetation": 3}
    code = F.create_map(*(F.lit(x) for kv in number.items() for x in kv))[F.col("label")]
    grouped = boxes(spark, d).groupBy("frame_id").agg(F.collect_list(F.struct(code.alias("c"), F.array("x0", "y0", "x1", "y1").alias("b"))).alias("z"))
    arrays = grouped.select("frame_id", F.transform("z", lambda s: s["c"]).alias("labels"), F.transform("z", lambda s: s["b"]).alias("bboxes"))
    return S.flat_boxes(arrays, {v: k for k, v in number.items()})


@query("cu1_pool_split", sql(CORPUS, "SELECT asset_class, count(*) FILTER (label=0) AS normal, count(*) FILTER (label=1) AS anomalous FROM corpus GROUP BY 1"))
def cu1(spark, d):
    return corpus_rows(spark, d).groupBy("asset_class").agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("anomalous"))


INTER = "turns AS (SELECT *, row_number() OVER (PARTITION BY asset_class, defect ORDER BY ord) AS turn FROM corpus), inter AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY turn, defect) AS place FROM turns)"


@query("cu2_interleave", sql(CORPUS, INTER, "SELECT asset_class, place, row_id, defect FROM inter"))
def cu2(spark, d):
    return O.interleave(corpus_rows(spark, d)).select("asset_class", F.col("place").cast("long").alias("place"), "row_id", "defect")


@query("cu3_seeded_shuffle", sql(CORPUS, "SELECT row_id, row_number() OVER (PARTITION BY asset_class ORDER BY ord) AS place FROM corpus WHERE label=0"))
def cu3(spark, d):
    return numbered(corpus_rows(spark, d).where("label = 0").select("row_id", "asset_class", "ord"), ["asset_class"], ["ord", "row_id"], "place").select("row_id", F.col("place").cast("long").alias("place"))


@query("cu4_prefix_then_cap", sql(CORPUS, "pre AS (SELECT * FROM corpus WHERE label=0 QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY ord)<=20), ded AS (SELECT * FROM pre QUALIFY row_number() OVER (PARTITION BY asset_class, sha ORDER BY ord)=1)", "SELECT asset_class, row_id FROM ded QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY ord)<=10"))
def cu4(spark, d):
    pre = O.capped(corpus_rows(spark, d).where("label = 0"), ["asset_class"], ["ord"], 20)
    return O.capped(O.first_of_each(pre, ["asset_class", "sha"], ["ord"]), ["asset_class"], ["ord"], 10).select("asset_class", "row_id")


@query("cu5_exact_dedupe", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id)=1")
def cu5(spark, d):
    return O.first_of_each(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), ["sha"], ["doc_id"]).select("doc_id")


@query("cu6_perceptual_dedupe_d0", "SELECT doc_id AS place FROM documents QUALIFY row_number() OVER (PARTITION BY substr(md5(text),1,15) ORDER BY doc_id)=1")
def cu6_zero(spark, d):
    fp = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    return O.perceptual_dedupe(table(spark, d, "documents").select(F.col("doc_id").alias("place"), fp.alias("fp")), 0).select("place")


def fingerprints(spark, d):
    """64-bit simhash of distinct three-word shingles: each text's shingles are hashed, and their bits added up in one array pass."""
    split = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))  # a column of its own: inside the lambda it would be split again for each word
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))

    @F.pandas_udf("long")
    def folded(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            ones = sum(np.unpackbits(np.ascontiguousarray(h[at : at + 4096]).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for at in range(0, len(h), 4096))
            out.append(int(np.packbits(2 * ones > len(h)).view(np.int64)[0]))
        return pd.Series(out)

    return split.select(F.col("doc_id").alias("place"), folded(F.array_distinct(grams)).alias("fp"))


@query("cu6_perceptual_dedupe_d4")
def cu6_four(spark, d):
    return O.perceptual_dedupe(fingerprints(spark, d), 4).select("place")


SPLIT_ALL = "pools AS (SELECT *, CASE WHEN label=1 THEN 2 WHEN n_chars%5=0 THEN 1 ELSE 0 END AS prio FROM corpus)"


@query("cu7_cross_split_guard", sql(CORPUS, SPLIT_ALL, "SELECT row_id, prio FROM pools QUALIFY row_number() OVER (PARTITION BY asset_class, sha ORDER BY prio, ord)=1"))
def cu7(spark, d):
    pools = corpus_rows(spark, d).withColumn("prio", F.when(F.col("label") == 1, 2).when(F.col("n_chars") % 5 == 0, 1).otherwise(0))
    return O.first_of_each(pools, ["asset_class", "sha"], ["prio", "ord"]).select("row_id", "prio")


FRACTION = "frac AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY ord) AS rn, least(120, greatest(1, floor(0.8*count(*) OVER (PARTITION BY asset_class)))) AS n_train FROM corpus), splits AS (SELECT *, CASE WHEN rn<=n_train THEN 'train_good' ELSE 'test_good' END AS split FROM frac WHERE rn<=n_train+30)"


@query("cu8_fraction_split", sql(CORPUS, FRACTION, "SELECT row_id, split FROM splits"))
def cu8(spark, d):
    return O.fraction_split(corpus_rows(spark, d)).select("row_id", "split")


NAMED = "named AS (SELECT *, CASE WHEN row_id%7=0 THEN 'held_out' WHEN label=1 THEN 'test_defect' WHEN row_id%3=0 THEN 'test_good' ELSE 'train_good' END AS split FROM corpus)"
COUNTS = "counts AS (SELECT asset_class, count(*) FILTER (split='train_good') AS train_good, count(*) FILTER (split='test_good') AS test_good, count(*) FILTER (split='test_defect') AS test_defect, count(*) FILTER (split='held_out') AS held_out FROM named GROUP BY 1)"


def named(spark, d):
    r = F.col("row_id")
    return corpus_rows(spark, d).withColumn("split", F.when(r % 7 == 0, "held_out").when(F.col("label") == 1, "test_defect").when(r % 3 == 0, "test_good").otherwise("train_good"))


def named_rows(spark, d):
    return corpus_rows(spark, d).withColumn("name", F.concat(F.lit("frame-"), F.col("row_id").cast("string"), F.lit(".png")))


@query("cu9_named_holdout", sql(CORPUS, "SELECT row_id, CASE WHEN row_id%7=0 THEN 'held_out' ELSE 'train_good' END AS split FROM corpus"))
def cu9(spark, d):
    rows = named_rows(spark, d)
    return O.named_holdout(rows, rows.where("row_id % 7 = 0")).select("row_id", "split")


@query("cu9_holdout_errors", sql(CORPUS, "SELECT min(asset_class) AS asset_class, 'every frame is held out' AS error FROM corpus UNION ALL SELECT DISTINCT asset_class, 'not present: frame-0.tif' FROM corpus"))
def cu9_errors(spark, d):
    """A list that withholds all of the first class, and names a file that no class has."""
    rows = named_rows(spark, d)
    first = rows.join(F.broadcast(rows.agg(F.min("asset_class").alias("asset_class"))), "asset_class")  # one row
    wrong = rows.select("asset_class").distinct().withColumn("name", F.lit("frame-0.tif"))
    return O.holdout_errors(rows, first.select("asset_class", "name").unionAll(wrong))


@query("cu10_class_counts", sql(CORPUS, NAMED, COUNTS, "SELECT * FROM counts"))
def cu10(spark, d):
    return O.class_counts(named(spark, d))


@query("cu10_minima", sql(CORPUS, NAMED, COUNTS, "SELECT asset_class, why FROM (SELECT *, concat_ws('; ', CASE WHEN test_defect>0 AND train_good<20 THEN 'fewer than 20 train_good' END, CASE WHEN test_defect>0 AND test_defect<5 THEN 'fewer than 5 test_defect' END, CASE WHEN test_defect=0 AND train_good<8 THEN 'fewer than 8 train_good' END, CASE WHEN test_defect=0 AND held_out<1 THEN 'no held_out' END) AS why FROM counts) WHERE why<>''"))
def cu10_minima(spark, d):
    return O.minima_failures(O.class_counts(named(spark, d))).select("asset_class", "why")


@query("cu11_provenance", sql(CORPUS, "SELECT asset_class, count(*) AS raw_candidates, count(DISTINCT sha) AS after_dedupe, array_to_string(list_sort(list(DISTINCT defect)),',') AS defect_types FROM corpus GROUP BY 1"))
def cu11(spark, d):
    return corpus_rows(spark, d).groupBy("asset_class").agg(F.count("*").alias("raw_candidates"), F.countDistinct("sha").alias("after_dedupe"), F.array_join(F.sort_array(F.collect_set("defect")), ",").alias("defect_types"))


@query("cu12_split_names", sql(CORPUS, NAMED, "SELECT asset_class, coalesce(array_to_string(list_sort(list(row_id) FILTER (split='held_out')),','),'') AS held, coalesce(array_to_string(list_sort(list(row_id) FILTER (split='train_good')),','),'') AS kept FROM named GROUP BY 1"))
def cu12(spark, d):
    names = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("row_id")))).cast("array<string>"), ",")
    return named(spark, d).groupBy("asset_class").agg(names("held_out").alias("held"), names("train_good").alias("kept"))


@query("cu13_resize", "SELECT doc_id, greatest(1,floor(n_chars*least(1.0,512.0::DOUBLE/greatest(n_chars,1000))))::BIGINT AS w, greatest(1,floor(1000*least(1.0,512.0::DOUBLE/greatest(n_chars,1000))))::BIGINT AS h FROM documents")
def cu13(spark, d):
    df = table(spark, d, "documents").withColumn("hh", F.lit(1000))
    w, h = O.resized("n_chars", "hh")
    return df.select("doc_id", w.alias("w"), h.alias("h"))


CROP = "crop AS (SELECT *, floor(least(greatest(x1-x0,y1-y0)*1.15, 640)) AS side FROM boxes WHERE greatest(x1-x0,y1-y0)>4)"


@query("cu14_square_crop", sql(BOXES, CROP, "SELECT box_id, side::BIGINT AS side, floor(greatest(0,least((x0+x1)/2-side/2,640-side)))::BIGINT AS left, floor(greatest(0,least((y0+y1)/2-side/2,640-side)))::BIGINT AS top, side<160 AS upscale FROM crop"))
def cu14(spark, d):
    return O.square_crop(boxes(spark, d)).select("box_id", *(F.col(c).cast("long").alias(c) for c in ("side", "left", "top")), "upscale")


def by_label(spark, d, label):
    return boxes(spark, d).where(F.col("label") == label)


INSIDE = "(b.x0+b.x1)/2 BETWEEN a.x0 AND a.x1 AND (b.y0+b.y1)/2 BETWEEN a.y0 AND a.y1"
MEETS = "least(a.x1,b.x1)>greatest(a.x0,b.x0) AND least(a.y1,b.y1)>greatest(a.y0,b.y0)"
INTERSECTION = "(greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0))"
AREA = "((x.x1-x.x0)*(x.y1-x.y0))"
AA, AB = AREA.replace("x.", "a."), AREA.replace("x.", "b.")
GAP = "sqrt(pow(greatest(a.x0-b.x1,b.x0-a.x1,0),2)+pow(greatest(a.y0-b.y1,b.y0-a.y1,0),2))"


def pair_from(a, b):
    return f"FROM boxes a JOIN boxes b USING (frame_id) WHERE a.label='{a}' AND b.label='{b}'"


@query("jn5_containment", sql(BOXES, f"SELECT a.box_id AS a_box_id, b.box_id AS b_box_id {pair_from('tower', 'broken')} AND {INSIDE}"))
def jn5(spark, d):
    return O.near_pairs(by_label(spark, d, "tower"), by_label(spark, d, "broken")).where(C.centre_inside("b_", "a_")).select("a_box_id", "b_box_id")


@query("jn6_intersection", sql(BOXES, f"SELECT a.box_id AS a_box_id, b.box_id AS b_box_id {pair_from('vegetation', 'cable')} AND {MEETS}"))
def jn6(spark, d):
    return O.encroachments(by_label(spark, d, "vegetation"), by_label(spark, d, "cable"), "intersect").select("a_box_id", "b_box_id")


@query("jn7_encroachment", sql(BOXES, f"SELECT 'iou' AS metric, count(*) AS n {pair_from('vegetation', 'cable')} AND {INTERSECTION}/greatest({AA}+{AB}-{INTERSECTION},1e-6)>=0.1 UNION ALL SELECT 'overlap_smaller', count(*) {pair_from('vegetation', 'cable')} AND {INTERSECTION}/greatest(least({AA},{AB}),1e-6)>=0.2 UNION ALL SELECT 'gap', count(*) {pair_from('vegetation', 'cable')} AND {GAP}<=50"))
def jn7(spark, d):
    veg, cable, out = by_label(spark, d, "vegetation"), by_label(spark, d, "cable"), None
    for metric, t in (("iou", 0.1), ("overlap_smaller", 0.2), ("gap", 50.0)):
        one = O.encroachments(veg, cable, metric, t).agg(F.lit(metric).alias("metric"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("jn8_best_partner", sql(BOXES, f"SELECT a.box_id AS a_box_id, max({INTERSECTION}) AS area {pair_from('vegetation', 'cable')} AND {MEETS} GROUP BY 1"))
def jn8(spark, d):
    pairs = O.encroachments(by_label(spark, d, "vegetation"), by_label(spark, d, "cable"), "intersect").withColumn("area", C.overlap("a_", "b_"))
    best = pairs.groupBy("a_box_id").agg(F.max_by(F.struct("b_box_id", "area"), F.struct("area", "b_box_id")).alias("b"))
    return best.select("a_box_id", "b.area")


@query("jn9_clear_gap", sql(BOXES, f"gaps AS (SELECT a.box_id, min(CASE WHEN b.box_id IS NOT NULL THEN {GAP} END) AS g FROM boxes a LEFT JOIN boxes b ON a.frame_id=b.frame_id AND b.label='cable' WHERE a.label='vegetation' GROUP BY 1)", "SELECT box_id AS a_box_id FROM gaps WHERE g IS NULL OR g>=100"))
def jn9(spark, d):
    veg = by_label(spark, d, "vegetation")
    close = O.near_pairs(veg, by_label(spark, d, "cable"), 100.0).where(C.gap("a_", "b_") < 100).select("a_box_id")
    return O.prefixed(veg, "a_").join(close.hint("merge"), "a_box_id", "left_anti").select("a_box_id")


@query("jn10_anchored_pool", sql(BOXES, f"SELECT box_id AS a_box_id FROM boxes a WHERE label='cable' AND greatest(x1-x0,y1-y0)<=200 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.frame_id=a.frame_id AND b.label='vegetation' AND {MEETS})"))
def jn10(spark, d):
    a = by_label(spark, d, "cable").where(C.box_side() <= 200)
    hit = O.encroachments(a, by_label(spark, d, "vegetation"), "intersect").select("a_box_id")
    return O.prefixed(a, "a_").join(hit.hint("merge"), "a_box_id", "left_anti").select("a_box_id")


@query("cu15_component_pools", sql(BOXES, f"SELECT CASE label WHEN 'cable' THEN 'good' ELSE 'broken' END AS pool, box_id FROM boxes a WHERE (label='cable' AND greatest(x1-x0,y1-y0)<=160 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.frame_id=a.frame_id AND b.label='broken' AND {INSIDE})) OR (label='broken' AND greatest(x1-x0,y1-y0)<=200)"))
def cu15(spark, d):
    good, broken = by_label(spark, d, "cable").where(C.box_side() <= 160), by_label(spark, d, "broken")
    hit = O.near_pairs(good, broken).where(C.centre_inside("b_", "a_")).select(F.col("a_box_id").alias("box_id"))
    pool = lambda df, n: df.select(F.lit(n).alias("pool"), "box_id")
    return pool(good.join(hit.hint("merge"), "box_id", "left_anti"), "good").unionAll(pool(broken.where(C.box_side() <= 200), "broken"))


@query("cu16_structure_pools", sql(BOXES, f"SELECT box_id, EXISTS (SELECT 1 FROM boxes b WHERE b.frame_id=a.frame_id AND b.label='broken' AND {INSIDE}) AS is_defect FROM boxes a WHERE label='tower' AND greatest(x1-x0,y1-y0)>=180"))
def cu16(spark, d):
    tower = by_label(spark, d, "tower").where(C.box_side() >= 180)
    hit = O.near_pairs(tower, by_label(spark, d, "broken")).where(C.centre_inside("b_", "a_")).select(F.col("a_box_id").alias("box_id")).distinct().withColumn("hit", F.lit(True))
    return tower.join(hit.hint("merge"), "box_id", "left").select("box_id", F.coalesce("hit", F.lit(False)).alias("is_defect"))


VARIANTS = (("intersect", 0.0), ("iou", 0.05), ("overlap_smaller", 0.1), ("gap", 30.0))


def variant_pools(spark, d):
    found = O.encroached(by_label(spark, d, "vegetation"), by_label(spark, d, "cable"), VARIANTS)
    return found.select("variant", "box_id", F.when(F.col("hit"), "defect").otherwise("good").alias("pool"))


def variant_sql():
    tests = {"intersect": MEETS, "iou": f"{INTERSECTION}/greatest({AA}+{AB}-{INTERSECTION},1e-6)>=0.05", "overlap_smaller": f"{INTERSECTION}/greatest(least({AA},{AB}),1e-6)>=0.1", "gap": f"{GAP}<=30"}
    return " UNION ALL ".join(f"SELECT '{m}' AS variant, box_id, CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.frame_id=a.frame_id AND b.label='cable' AND {t}) THEN 'defect' ELSE 'good' END AS pool FROM boxes a WHERE label='vegetation'" for m, t in tests.items())


@query("cu17_encroachment_pools", sql(BOXES, variant_sql()))
def cu17(spark, d):
    return variant_pools(spark, d)


@query("cu18_variant_report", sql(BOXES, f"v AS ({variant_sql()})", "SELECT *, concat_ws('; ', CASE WHEN good<25 THEN 'few good' END, CASE WHEN defect<5 THEN 'few defects' END) AS note FROM (SELECT variant, count(*) FILTER (pool='good') AS good, count(*) FILTER (pool='defect') AS defect FROM v GROUP BY 1)"))
def cu18(spark, d):
    out = variant_pools(spark, d).groupBy("variant").agg(F.count_if(F.col("pool") == "good").alias("good"), F.count_if(F.col("pool") == "defect").alias("defect"))
    return out.withColumn("note", F.concat_ws("; ", F.when(F.col("good") < 25, "few good"), F.when(F.col("defect") < 5, "few defects")))


@query("cu19_idempotent_skip", sql(CORPUS, "SELECT DISTINCT asset_class FROM corpus WHERE asset_class NOT IN (SELECT source FROM documents WHERE source<'src2')"))
def cu19(spark, d):
    recorded = table(spark, d, "documents").where("source < 'src2'").select(F.col("source").alias("asset_class")).distinct()
    return corpus_rows(spark, d).select("asset_class").distinct().join(recorded, "asset_class", "left_anti")


@query("cu20_trainable", sql(CORPUS, NAMED, "SELECT DISTINCT asset_class FROM named WHERE split='train_good'"))
def cu20(spark, d):
    return named(spark, d).where("split = 'train_good'").select("asset_class").distinct()


@query("cu21_capability_flags", sql(CORPUS, NAMED, "SELECT asset_class, bool_or(split='test_defect') AS has_defect_set, bool_or(split='test_defect' AND n_chars>2000) AS has_masks FROM named GROUP BY 1"))
def cu21(spark, d):
    defect = F.col("split") == "test_defect"
    return named(spark, d).groupBy("asset_class").agg(F.bool_or(defect).alias("has_defect_set"), F.bool_or(defect & (F.col("n_chars") > 2000)).alias("has_masks"))


@query("jn3_mask_pairing", sql(CORPUS, "SELECT c.row_id FROM corpus c LEFT JOIN (SELECT item_id, length(text) AS fg FROM benchmark) m ON m.item_id=c.row_id%60 WHERE c.label=1 AND m.fg>0"))
def jn3(spark, d):
    masks = table(spark, d, "benchmark").select(F.col("item_id").alias("mask_id"), F.length("text").alias("fg"))
    return corpus_rows(spark, d).where("label = 1").withColumn("mask_id", F.col("row_id") % 60).join(masks, "mask_id", "left").where("fg > 0").select("row_id")


@query("jn4_mask_counts", sql(CORPUS, "d AS (SELECT asset_class, count(*) AS defects FROM corpus WHERE label=1 GROUP BY 1), m AS (SELECT asset_class, count(*) AS masks FROM corpus WHERE label=1 AND n_chars>1000 GROUP BY 1)", "SELECT coalesce(d.asset_class,m.asset_class) AS asset_class, coalesce(defects,0) AS defects, coalesce(masks,0) AS masks, coalesce(defects,0)=coalesce(masks,0) AS ok FROM d FULL JOIN m ON d.asset_class=m.asset_class"))
def jn4(spark, d):
    c = corpus_rows(spark, d).where("label = 1")
    n = lambda df, name: df.groupBy("asset_class").agg(F.count("*").alias(name))
    out = n(c, "defects").join(n(c.where("n_chars > 1000"), "masks"), "asset_class", "full").fillna(0, ["defects", "masks"])
    return out.withColumn("ok", F.col("defects") == F.col("masks"))


@query("jn13_leakage", sql(CORPUS, NAMED, "SELECT count(*) AS shared FROM (SELECT DISTINCT sha FROM named WHERE split='train_good') JOIN (SELECT DISTINCT sha FROM named WHERE split='held_out') USING (sha)"))
def jn13(spark, d):
    own = lambda s: named(spark, d).where(F.col("split") == s).select("sha").distinct()
    return own("train_good").join(own("held_out"), "sha").agg(F.count("*").alias("shared"))


PAIR = pair_from("tower", "vegetation")


@query("geo1_box_side", sql(BOXES, "SELECT box_id, greatest(x1-x0,y1-y0) AS side FROM boxes"))
def geo1(spark, d):
    return boxes(spark, d).select("box_id", C.box_side().alias("side"))


@query("geo2_to_6_pair_metrics", sql(BOXES, f"SELECT a.box_id AS a_box_id, b.box_id AS b_box_id, {INTERSECTION} AS area, round_even({INTERSECTION}/greatest({AA}+{AB}-{INTERSECTION},1e-6),6) AS iou, round_even({INTERSECTION}/greatest(least({AA},{AB}),1e-6),6) AS smaller, round_even({GAP},6) AS gap, least(a.x0,b.x0) AS ux0, greatest(a.y1,b.y1) AS uy1 {PAIR}"))
def geo(spark, d):
    p = O.pairs_in_frame(by_label(spark, d, "tower"), by_label(spark, d, "vegetation"))
    r6 = lambda c: C.half_even(c, 6)
    u = C.union_box("a_", "b_")
    return p.select("a_box_id", "b_box_id", C.overlap("a_", "b_").alias("area"), r6(C.iou("a_", "b_")).alias("iou"), r6(C.overlap_of_smaller("a_", "b_")).alias("smaller"), r6(C.gap("a_", "b_")).alias("gap"), u["x0"].alias("ux0"), u["y1"].alias("uy1"))
