"""Memory banks, thresholds, metrics, verdicts and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bank_tree as B
from ..operators import scoring as O
from ..operators import tiles as T
from ..operators.ranks import numbered, small, with_group_size
from ..sources.tables import written
from .adapters import BOXES, CELLS, FINDINGS, FRAMES, PATCHES, boxes, findings, frames, map_cells, patches, patches_of, sql, table
from .registry import query

SCORED = "scored AS (SELECT finding_id, asset_class, severity+l_tax AS score, verdict='defect' AS label FROM findings)"


def scored(spark, d):
    return findings(spark, d).select("finding_id", "asset_class", (F.col("severity") + F.col("l_tax")).alias("score"), (F.col("verdict") == "defect").alias("label"), "verdict", "severity", "l_tax")


def split_patches(spark, d):
    """Patches of training frames (the first four fifths of a class by stable order) and of the rest."""
    every = frames(spark, d)
    f = with_group_size(numbered(every.select("frame_id", "asset_class", "ord"), ["asset_class"], ["ord", "frame_id"], "place"), ["asset_class"], "n")
    marked = every.join(f.select("frame_id", (F.col("place") <= F.floor(0.8 * F.col("n"))).alias("train")).hint("merge"), "frame_id")
    marked = written(marked, "split")  # frames meet their part before they become patches
    return tuple(patches_of(marked.where(side), "asset_class", "ord") for side in ("train", "not train"))


BANK = "tr AS (SELECT frame_id, row_number() OVER (PARTITION BY asset_class ORDER BY ord) <= floor(0.8*count(*) OVER (PARTITION BY asset_class)) AS train FROM frames), bank AS (SELECT p.* FROM patches p JOIN tr USING (frame_id) WHERE train), probe AS (SELECT p.* FROM patches p JOIN tr USING (frame_id) WHERE NOT train)"
DIST = "dist AS (SELECT p.frame_id, p.asset_class, p.patch_id, min(list_distance(p.pvec,b.pvec)) AS distance FROM probe p JOIN bank b USING (asset_class) GROUP BY ALL)"


banked = split_patches


@query("bnk1_coreset")
def bnk1(spark, d):
    return O.coreset(patches(spark, d), 0.1).select("frame_id", "asset_class", "patch_id")


@query("bnk2_patch_distance", sql(FRAMES, PATCHES, BANK, DIST, "SELECT frame_id, asset_class, patch_id::INT AS patch_id, round_even(distance,6) AS distance FROM dist"))
def bnk2(spark, d):
    bank, odd = banked(spark, d)
    return O.patch_distances(odd, bank).withColumn("distance", C.half_even("distance", 6))


@query("bnk3_image_score", sql(FRAMES, PATCHES, BANK, DIST, "SELECT frame_id, asset_class, round_even(max(distance),6) AS raw_score FROM dist GROUP BY ALL"))
def bnk3(spark, d):
    bank, odd = banked(spark, d)
    return O.image_scores(O.patch_distances(odd, bank)).select("frame_id", "asset_class", C.half_even("raw_score", 6).alias("raw_score"))


@query("bnk3_reweighted")
def bnk3_reweighted(spark, d):
    bank, odd = banked(spark, d)
    return O.image_scores(O.patch_distances(odd, bank), bank, odd)


@query("bnk4_backbone_choice", "SELECT source, lang, count(*) AS n, CASE WHEN count(*)<4 THEN 'gaussian' ELSE 'coreset' END AS backbone FROM documents GROUP BY ALL")
def bnk4(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("backbone", O.backbone("n"))


@query("bnk5_gaussian")
def bnk5(spark, d):
    even, odd = split_patches(spark, d)
    return O.gaussian_scores(even, odd)


@query("thr1_fold_scores")
def thr1(spark, d):
    return O.fold_scores(patches(spark, d), 2, 0.25)


@query("thr2_normal_envelope", sql(FINDINGS, "ins AS (SELECT asset_class, severity+l_tax AS s FROM findings WHERE verdict='nominal'), oos AS (SELECT asset_class, max(severity+2*l_tax) AS m FROM findings WHERE verdict='defect' AND asset_class<>'PROMO' GROUP BY 1)", "SELECT i.asset_class, round_even(max(s),6) AS in_max, round_even(min(s),6) AS in_min, round_even(avg(s),4) AS mean, round_even(stddev_pop(s),4) AS std, round_even(quantile_cont(s,0.995),6) AS p995, round_even(coalesce(max(m),max(s)),6) AS image_threshold, max(m) IS NULL AS in_sample_only FROM ins i LEFT JOIN oos o ON i.asset_class=o.asset_class GROUP BY 1"))
def thr2(spark, d):
    s = scored(spark, d)
    ins = s.where("verdict = 'nominal'").select("asset_class", F.col("score").alias("raw_score"))
    oos = s.where("verdict = 'defect' and asset_class <> 'PROMO'").select("asset_class", (F.col("severity") + 2 * F.col("l_tax")).alias("raw_score"))
    out = O.envelope(ins, oos).drop("oos_max")
    return out.withColumns({c: C.half_even(c, 6) for c in ("in_max", "in_min", "p995", "image_threshold")} | {c: C.half_even(c) for c in ("mean", "std")})


@query("thr3_pixel_stats", sql(FRAMES, CELLS, "SELECT asset_class, round_even(quantile_cont(v,0.995),6) AS pixel_threshold, round_even(min(v),6) AS pixel_min, round_even(max(v),6) AS pixel_max FROM cells GROUP BY 1"))
def thr3(spark, d):
    return O.pixel_stats(map_cells(spark, d)).withColumns({c: C.half_even(c, 6) for c in ("pixel_threshold", "pixel_min", "pixel_max")})


@query("thr4_leave_out_audit")
def thr4(spark, d):
    p = patches(spark, d)
    unseen = O.fold_scores(p, 5, 0.25)
    ins = O.image_scores(O.patch_distances(p, O.coreset(p, 0.25))).groupBy("asset_class").agg(F.max("raw_score").alias("in_max"))
    ratio = F.col("raw_score") / F.greatest("in_max", F.lit(1e-12))
    return unseen.join(small(written(ins, "in-sample")), "asset_class").withColumn("ratio", ratio).groupBy("asset_class").agg(F.count("*").alias("frames"), F.count_if(F.col("raw_score") > F.col("in_max")).alias("would_flag"), F.min("ratio").alias("min_ratio"), F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("max_ratio"))


@query("thr5_best_f1", sql(FINDINGS, SCORED, "h AS (SELECT asset_class, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM scored GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY asset_class) AS ap FROM h WINDOW w AS (PARTITION BY asset_class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, round_even((2*tp/(tp+fp+ap))::DOUBLE,9) AS f1 FROM c)", "SELECT asset_class, score AS threshold, round_even(f1,4) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY asset_class ORDER BY f1 DESC, score)=1"))
def thr5(spark, d):
    return O.best_f1(scored(spark, d))


AUC = "h AS (SELECT asset_class, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM {src} GROUP BY ALL), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY asset_class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM h)"
AUC_OUT = "SELECT asset_class, round_even(CASE WHEN sum(pos)*sum(neg)>0 THEN (sum(pos*(below+neg/2))/(sum(pos)*sum(neg)))::DOUBLE END,4) AS auroc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM b GROUP BY 1"


@query("met1_image_auroc", sql(FINDINGS, SCORED, AUC.format(src="scored"), AUC_OUT))
def met1(spark, d):
    return O.auroc(scored(spark, d))


@query("met2_pixel_auroc", sql(FRAMES, CELLS, "px AS (SELECT asset_class, v AS score, (x+y)%3=0 AS label FROM cells)", AUC.format(src="px"), AUC_OUT))
def met2(spark, d):
    return O.auroc(map_cells(spark, d).select("asset_class", F.col("v").alias("score"), ((F.col("x") + F.col("y")) % 3 == 0).alias("label")))


@query("met3_supervised_ceiling")
def met3(spark, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    f = frames(spark, d).withColumn("features", array_to_vector("vec")).withColumn("label", (F.col("label") < 3).cast("double")).withColumn("fold", F.pmod(F.xxhash64("ord"), F.lit(5)))
    out = None
    for k in range(5):
        p = LogisticRegression(maxIter=20).fit(f.where(F.col("fold") != k)).transform(f.where(F.col("fold") == k))
        p = p.select(F.lit("all").alias("asset_class"), F.bround(vector_to_array("probability")[1], 9).alias("score"), (F.col("label") == 1).alias("label"))
        out = p if out is None else out.unionAll(p)
    return O.auroc(out)


MASK = "mask AS (SELECT DISTINCT frame_id, cx*16.0+8 AS px, cy*16.0+8 AS py FROM (SELECT frame_id, y0, y1, unnest(range(ceil((x0-8)/16)::BIGINT, floor((x1-8)/16)::BIGINT+1)) AS cx FROM boxes WHERE label='broken'), LATERAL (SELECT unnest(range(ceil((y0-8)/16)::BIGINT, floor((y1-8)/16)::BIGINT+1)) AS cy))"
HIT = "hit AS (SELECT b.frame_id, b.box_id, count(px) > 0 AS hit FROM boxes b LEFT JOIN mask m ON m.frame_id=b.frame_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 WHERE b.label='tower' GROUP BY ALL)"


@query("met4_region_precision", sql(BOXES, MASK, HIT, "SELECT count(*) AS n_boxes, count(*) FILTER (hit) AS boxes_hit, round_even(avg(hit::INT),4) AS box_precision, (SELECT count(DISTINCT frame_id) FROM mask) AS masked_frames, count(DISTINCT CASE WHEN hit THEN frame_id END) AS frames_hit, round_even(count(DISTINCT CASE WHEN hit THEN frame_id END)/(SELECT count(DISTINCT frame_id) FROM mask),4) AS frame_recall FROM hit"))
def met4(spark, d):
    """Reported boxes (towers) against mask cells, 16 pixels wide, whose centres lie in broken parts."""
    b = boxes(spark, d)
    return O.region_precision(b.where("label = 'tower'"), b.where("label = 'broken'")).withColumns({c: C.half_even(c) for c in ("box_precision", "frame_recall")})


@query("met5_false_alarms", sql(FINDINGS, "SELECT asset_class, count(*) AS good, count(*) FILTER (severity>=0.5) AS flagged FROM findings WHERE verdict='nominal' GROUP BY 1"))
def met5(spark, d):
    return findings(spark, d).where("verdict = 'nominal'").groupBy("asset_class").agg(F.count("*").alias("good"), F.count_if(F.col("severity") >= 0.5).alias("flagged"))


@query("met6_reload_parity")
def met6(spark, d):
    bank, odd = banked(spark, d)
    a, b = O.image_scores(O.patch_distances(odd, bank)), O.image_scores(O.patch_distances(odd, written(bank, "reloaded")))
    return a.join(b.select("frame_id", F.col("raw_score").alias("again")).hint("merge"), "frame_id").agg(F.max(F.abs(F.col("raw_score") - F.col("again"))).alias("delta")).withColumn("match", F.col("delta") < 1e-5)


STATS = "st AS (SELECT asset_class, quantile_cont(v,0.9) AS thr, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1), nc AS (SELECT frame_id, c.asset_class, y, x, v, least(1.0,greatest(0.0,(v-thr)/(hi-lo)+0.5))::DOUBLE AS norm FROM cells c JOIN st USING (asset_class))"


def norm_cells(spark, d, share=0.9):
    cells = map_cells(spark, d)
    st = O.pixel_stats(cells, share=share).withColumnsRenamed({"pixel_threshold": "thr", "pixel_min": "lo", "pixel_max": "hi"})
    return cells.join(small(written(st, "pixel-stats")), "asset_class").select("frame_id", "asset_class", "y", "x", "v", O.min_max("v", "thr", "lo", "hi").alias("norm"))


@query("sc1_min_max", sql(FRAMES, CELLS, STATS, "SELECT frame_id, y, x, round_even(norm,6) AS norm FROM nc"))
def sc1(spark, d):
    return norm_cells(spark, d).select("frame_id", "y", "x", C.half_even("norm", 6).alias("norm"))


@query("sc2_threshold_fallback", sql(FRAMES, CELLS, "SELECT frame_id, round_even(CASE WHEN frame_id%4=0 THEN quantile_cont(v,0.99) ELSE 0.25 END,6) AS threshold, frame_id%4=0 AS approximate FROM cells GROUP BY frame_id"))
def sc2(spark, d):
    per = map_cells(spark, d).groupBy("frame_id").agg(F.percentile("v", 0.99).alias("p99")).withColumn("stored", F.when(F.col("frame_id") % 4 == 0, F.lit(float("nan"))).otherwise(0.25))
    thr, approximate = O.pixel_threshold("stored", "p99")
    return per.select("frame_id", C.half_even(thr, 6).alias("threshold"), approximate.alias("approximate"))


SAT = "sat AS (SELECT *, least(1.0, norm+CASE WHEN frame_id%3=0 THEN 0.6 ELSE 0 END)::DOUBLE AS n2 FROM nc), pf AS (SELECT frame_id, avg((n2>=0.999)::INT) AS share, quantile_cont(v,0.97) AS p97, max(v) AS vmax FROM sat GROUP BY 1)"


@query("sc3_saturation", sql(FRAMES, CELLS, STATS, SAT, "SELECT frame_id, y, x, round_even(CASE WHEN share>=0.5 THEN least(1.0,greatest(0.0,(v-p97)/greatest(1e-6,vmax-p97)*0.5+0.5)) ELSE n2 END::DOUBLE,6) AS norm, share>=0.5 AS saturated FROM sat JOIN pf USING (frame_id)"))
def sc3(spark, d):
    c = norm_cells(spark, d).withColumn("norm", F.least(F.lit(1.0), F.col("norm") + F.when(F.col("frame_id") % 3 == 0, 0.6).otherwise(0.0)))
    return O.desaturated(c).select("frame_id", "y", "x", C.half_even("norm", 6).alias("norm"), "saturated")


@query("sc4_verdict", sql(FINDINGS, "SELECT finding_id, CASE WHEN severity+l_tax>=0.5 THEN 'defect' ELSE 'nominal' END AS verdict, round_even(least(1.0,greatest(0.0,severity))::DOUBLE,4) AS severity, round_even(severity+l_tax,5) AS raw FROM findings"))
def sc4(spark, d):
    s = scored(spark, d).withColumn("thr", F.lit(0.5))
    return s.select("finding_id", O.verdict("score", "thr").alias("verdict"), C.half_even(C.clip01("severity")).alias("severity"), C.half_even("score", 5).alias("raw"))


def found(spark, d):
    """Regions of maps of which the hotter four fifths count, so that some outlive the opening on 8 x 8 cells."""
    return O.regions(norm_cells(spark, d, 0.2), 0.5)


@query("sc5_regions")
def sc5(spark, d):
    return found(spark, d)


@query("sc5_tiled_regions")
def sc5_tiled(spark, d):
    """The regions of sc5 by tiles; the given maps are of 8 by 8 cells, so each is one tile here. tests/test_tiles.py has maps of many."""
    return T.tiled_regions(norm_cells(spark, d, 0.2))


@query("sc6_region_filters")
def sc6(spark, d):
    return O.kept_regions(found(spark, d), (640, 480))


HOT = "hot AS (SELECT frame_id, y, x, v FROM cells QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x)=1)"


def hottest(spark, d):
    return map_cells(spark, d).groupBy("frame_id").agg(F.max_by(F.struct("y", "x", "v"), F.struct("v", -F.col("y"), -F.col("x"))).alias("r")).select("frame_id", "r.*")


@query("sc7_region_suppression", sql(FRAMES, CELLS, "SELECT frame_id, y, x FROM (SELECT *, max(v) OVER (PARTITION BY frame_id) AS m FROM cells) WHERE v>=0.25 AND m>=0.35"))
def sc7(spark, d):
    regions = map_cells(spark, d).where("v >= 0.25").select("frame_id", "y", "x")
    return O.suppressed(regions, hottest(spark, d).select("frame_id", O.verdict("v", F.lit(0.35)).alias("verdict")))


@query("sc8_hottest_region", sql(FRAMES, CELLS, HOT, "SELECT frame_id, y, x FROM hot"))
def sc8(spark, d):
    return hottest(spark, d).select("frame_id", "y", "x")


def crop_sql(a, n, most):
    half = f"(greatest({n}*1.4,96.0)/2)"
    lo = f"least(greatest(floor({a}+{n}/2-{half}),0),{most}-1)"
    return lo, f"greatest(least(ceil({a}+{n}/2+{half}),{most}),{lo}+1)"


CX, CY = crop_sql("x0", "(x1-x0)", "640"), crop_sql("y0", "(y1-y0)", "640")


@query("sc9_padded_crop", sql(BOXES, f"SELECT box_id, ({CX[0]})::INT AS left, ({CY[0]})::INT AS top, ({CX[1]})::INT AS right, ({CY[1]})::INT AS bottom FROM boxes"))
def sc9(spark, d):
    b = boxes(spark, d).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "fw": F.lit(640.0), "fh": F.lit(640.0)})
    return b.select("box_id", O.padded_crop("x0", "y0", "w", "h", "fw", "fh").alias("c")).select("box_id", "c.*")


@query("sc10_reference_crop", sql(BOXES, "SELECT box_id, least(round_even(x0*0.5,0),319)::INT AS left, least(round_even(y0*0.25,0),159)::INT AS top FROM boxes"))
def sc10(spark, d):
    return boxes(spark, d).select("box_id", F.least(F.bround(F.col("x0") * (320 / 640)), F.lit(319)).cast("int").alias("left"), F.least(F.bround(F.col("y0") * (160 / 640)), F.lit(159)).cast("int").alias("top"))


@query("sc11_heat_ramp", sql(FINDINGS, "SELECT finding_id, round_even(least(1.0,greatest(0.0,(severity-0.5)/0.5))*0.78*255,3) AS alpha FROM findings"))
def sc11(spark, d):
    return findings(spark, d).select("finding_id", C.half_even(O.heat_ramp("severity") * 0.78 * 255, 3).alias("alpha"))


@query("sc12_narrative", sql(FINDINGS, "SELECT finding_id, CASE verdict WHEN 'unroutable' THEN 'No model may inspect this frame; the best gate is 0.820.' WHEN 'defect' THEN 'Defect on '||asset_class||' with severity '||printf('%.2f',severity)||'.' ELSE asset_class||' looks nominal (severity '||printf('%.2f',severity)||').' END AS narrative FROM findings"))
def sc12(spark, d):
    return findings(spark, d).select("finding_id", O.narrative().alias("narrative"))


@query("sc13_narrative_source", sql(FINDINGS, "SELECT CASE WHEN verdict='defect' AND l_suppkey%3=0 THEN 'description' WHEN verdict='defect' THEN 'fallback' ELSE 'structured' END AS source, count(*) AS n FROM findings GROUP BY 1"))
def sc13(spark, d):
    f = findings(spark, d)
    told = f.where("l_suppkey % 3 = 0").select("l_suppkey").distinct().withColumn("description", F.lit("told"))
    df = f.join(told, "l_suppkey", "left")
    source = F.when((F.col("verdict") == "defect") & F.col("description").isNotNull(), "description").when(F.col("verdict") == "defect", "fallback").otherwise("structured")
    return df.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query("sc14_descriptions", "SELECT event_id, CASE WHEN event_id%4=0 THEN '' ELSE event_type END AS description, CASE WHEN event_id%2=0 THEN 'c'||(event_id%7) END AS component, event_id%5<>0 OR event_id%2=1 AS visible, event_id%4=0 AS rejected FROM events")
def sc14(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type"))
    record = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("component"), (F.col("event_id") % 5 != 0).alias("difference_visible"), text.alias("description")))
    e = e.withColumn("payload", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), record, F.lit("\n```"))).otherwise(text))
    return O.normalised_descriptions(e).select("event_id", "description", "component", "visible", "rejected")


@query("v2b_extended_bank", sql(FRAMES, PATCHES, BANK, DIST, "far AS (SELECT frame_id, asset_class, max(distance) AS s FROM dist GROUP BY ALL), good AS (SELECT asset_class, count(*) AS added FROM far WHERE s<0.35 GROUP BY 1), seen AS (SELECT asset_class, count(*) AS n FROM bank GROUP BY 1)", "SELECT asset_class, coalesce(added,0) AS added, (n+8*coalesce(added,0))::BIGINT AS patches_seen FROM seen LEFT JOIN good USING (asset_class)"))
def v2b(spark, d):
    """The bank's tree, extended by the patches of frames that score low: frames added, and patches that the tree stands for."""
    bank, odd = banked(spark, d)
    tree = B.extended(None, bank, 32, 256)
    good = written(O.image_scores(O.patch_distances(odd, bank)).where("raw_score < 0.35").select("frame_id", "asset_class"), "confident")
    tree = B.extended(tree, odd.join(good.select("frame_id").hint("merge"), "frame_id", "left_semi"), 32, 256)
    seen = tree.groupBy("asset_class").agg(F.sum("weight").alias("patches_seen"))
    added = good.groupBy("asset_class").agg(F.count("*").alias("added"))
    return seen.join(added.hint("merge"), "asset_class", "left").select("asset_class", F.coalesce("added", F.lit(0)).alias("added"), "patches_seen")
