"""Vector search, registry building and upkeep, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import findings as O
from ..operators import routing as R
from ..operators import scoring
from ..operators import vector_index as I
from ..sources import tables as S
from ..sources.commits import CommitLog
from .adapters import CELLS, CORPUS, FRAMES, PATCHES, corpus_rows, frames, map_cells, sql, table
from .findings_queries import MODELS, models as model_rows
from .registry import query
from .scoring_queries import BANK, DIST, split_patches

TRAIN = "cls AS (SELECT *, count(*) OVER (PARTITION BY asset_class) AS n, row_number() OVER (PARTITION BY asset_class ORDER BY ord, frame_id) AS place FROM frames), tr AS (SELECT *, n-least(n-1, greatest(8, floor(0.2*n))) AS n_fit FROM cls)"
SIM = "(1+list_dot_product({a},{b})/((sqrt(list_dot_product({a},{a}))+1e-12)*(sqrt(list_dot_product({b},{b}))+1e-12)))/2"


def cent(name: str, source: str, where: str = "TRUE") -> str:
    return (
        f"{name}_l AS (SELECT asset_class, i, avg(vec[i]) AS m FROM {source}, (SELECT unnest(range(1,65)) AS i) WHERE {where} GROUP BY ALL), {name}_m AS (SELECT asset_class, list(m ORDER BY i) AS mean FROM {name}_l GROUP BY 1), "
        f"{name} AS (SELECT asset_class, list_transform(mean, lambda x: x/sqrt(list_dot_product(mean,mean))) AS vec FROM {name}_m)"
    )


GATES = f"gates AS (SELECT t.asset_class, least(quantile_cont(s,0.05), quantile_cont(s,0.5)-0.012) AS gate, count(*) AS n_held FROM (SELECT t.asset_class, {SIM.format(a='t.vec', b='c.vec')} AS s FROM tr t JOIN fitc c ON t.asset_class=c.asset_class WHERE t.n_fit<2 OR t.place>t.n_fit) t GROUP BY 1)"
REGISTERED = "reg AS (SELECT asset_class||'-patchcore-v1' AS name, c.asset_class, c.vec, gate FROM allc c JOIN gates USING (asset_class) WHERE c.asset_class<>'class_9')"
BUILD = [FRAMES, TRAIN, cent("fitc", "tr", "n_fit<2 OR place<=n_fit"), cent("allc", "frames"), GATES, REGISTERED]
TOPS = f"tops AS (SELECT f.frame_id, f.asset_class AS truth, r.name, r.asset_class, r.gate, {SIM.format(a='f.vec', b='r.vec')} AS raw, row_number() OVER (PARTITION BY f.frame_id ORDER BY {SIM.format(a='f.vec', b='r.vec')} DESC, r.name) AS rank FROM frames f, reg r QUALIFY rank<=5)"
DECIDED = "decided AS (SELECT *, CASE WHEN s>=g THEN 'route' WHEN s>=round_even(g-0.02,6) THEN 'ambiguous' ELSE 'unroutable' END AS decision FROM (SELECT frame_id, truth, name, asset_class, round_even(raw,4) AS s, round_even(greatest(0.0,gate),4) AS g FROM tops WHERE rank=1))"
REFUSING_FLOOR = 0.66
WITH = [*BUILD, TOPS, DECIDED]


def registry(spark, d):
    f = frames(spark, d)
    m = R.centroids(f).join(R.seed_gates(f).hint("merge"), "asset_class").withColumn("name", C.default_name("asset_class"))
    return m.where("asset_class <> 'class_9'")


def decided(spark, d, floor: float = 0.0):
    return R.decide(R.route(frames(spark, d), registry(spark, d), floor=floor))


def r4(c):
    return C.half_even(c, 4)


@query("agg1_centroid", sql(FRAMES, cent("c", "frames"), "SELECT asset_class, (i-1)::INT AS i, round_even(vec[i],6) AS v FROM c, (SELECT unnest(range(1,65)) AS i)"))
def agg1(spark, d):
    return R.centroids(frames(spark, d)).select("asset_class", F.posexplode("vec").alias("i", "v")).withColumn("v", C.half_even("v", 6))


@query("agg2_holdout_split", sql(FRAMES, TRAIN, "SELECT frame_id, n_fit<2 OR place>n_fit AS held FROM tr"))
def agg2(spark, d):
    return R.split_holdout(frames(spark, d)).select("frame_id", "held")


@query("agg3_seed_gate", sql(*BUILD[:-1], "SELECT asset_class, round_even(gate,6) AS gate, n_held FROM gates"))
def agg3(spark, d):
    return R.seed_gates(frames(spark, d)).withColumn("gate", C.half_even("gate", 6))


@query("agg4_coldstart_gate", sql(FRAMES, cent("c", "frames"), f"SELECT asset_class, round_even(quantile_cont(s,0.05),6) AS gate FROM (SELECT f.asset_class, {SIM.format(a='f.vec', b='c.vec')} AS s FROM frames f JOIN c ON f.asset_class=c.asset_class) GROUP BY 1"))
def agg4(spark, d):
    return R.coldstart_gates(frames(spark, d)).withColumn("gate", C.half_even("gate", 6))


@query("agg5_exemplar", sql(FRAMES, cent("c", "frames"), f"SELECT f.asset_class, f.frame_id AS reference_frame_id FROM frames f JOIN c ON f.asset_class=c.asset_class QUALIFY row_number() OVER (PARTITION BY f.asset_class ORDER BY round_even({SIM.format(a='f.vec', b='c.vec')},9) DESC, f.frame_id)=1"))
def agg5(spark, d):
    return R.exemplars(frames(spark, d)).select("asset_class", "reference_frame_id")


@query("agg6_register", sql(*BUILD, "SELECT name, round_even(gate,6) AS gate, (SELECT count(*) FROM frames f WHERE f.asset_class=r.asset_class) AS training_samples, 64::INT AS dims FROM reg r"))
def agg6(spark, d):
    return R.register_models(frames(spark, d)).where("asset_class <> 'class_9'").select("name", C.half_even("gate", 6).alias("gate"), "training_samples", F.size("vec").alias("dims"))


NEAREST = f"SELECT q.frame_id AS query_id, f.frame_id AS item_id, {SIM.format(a='q.vec', b='f.vec')} AS score, row_number() OVER (PARTITION BY q.frame_id ORDER BY {SIM.format(a='q.vec', b='f.vec')} DESC, f.frame_id) AS rank FROM frames q, frames f WHERE q.frame_id%20=0 AND q.frame_id<>f.frame_id"


def queries_of(f):
    return f.where("frame_id % 20 = 0")


@query("knn1_exact", sql(FRAMES, f"SELECT query_id, item_id, round_even(score,6) AS score, rank FROM ({NEAREST}) WHERE rank<=5"))
def knn1(spark, d):
    f = frames(spark, d)
    return R.recall(queries_of(f), f, 5).withColumn("score", C.half_even("score", 6)).withColumn("rank", F.col("rank").cast("long"))


def index_of(spark, f):
    """An index of all frames, and how many lists a query has to probe."""
    index = I.indexed(f, S.scratch(spark, "index"))
    return index, index.probes_for(f, 5, 0.99)


@query("knn2_approximate")
def knn2(spark, d):
    f = frames(spark, d).drop("ord")
    index, probes = index_of(spark, f)
    return index.search(queries_of(f), f, 5, probes)


@query("knn2_sign_codes")
def knn2_codes(spark, d):
    f = frames(spark, d)
    return R.approximate_recall(queries_of(f), f, 5)


@query("knn2_rows_read")
def knn2_rows_read(spark, d):
    """What the index costs here: lists, lists probed, and the share of rows in them."""
    f = frames(spark, d).drop("ord")
    index, probes = index_of(spark, f)
    share = index.share_read(queries_of(f), probes)
    return index.rows().agg(F.count("*").alias("n_rows"), F.count_distinct("list").alias("n_lists"), F.lit(probes).alias("probes"), F.lit(share).alias("share_read"))


@query("knn3_exclude_self", sql(FRAMES, f"SELECT query_id, count(*) FILTER (query_id=item_id) AS selves FROM ({NEAREST}) WHERE rank<=5 GROUP BY 1"))
def knn3(spark, d):
    f = frames(spark, d)
    return R.recall(queries_of(f), f, 5).groupBy("query_id").agg(F.count_if(F.col("query_id") == F.col("item_id")).alias("selves"))


@query("knn4_agreement")
def knn4(spark, d):
    f = frames(spark, d)
    q = queries_of(f)
    index, probes = index_of(spark, f)
    return R.agreement(R.recall(q, f, 5), index.search(q, f, 5, probes))


@query("flt4_filtered_recall", sql(FRAMES, f"SELECT query_id, item_id, round_even(score,6) AS score FROM ({NEAREST} AND f.asset_class='class_1') WHERE rank<=3"))
def flt4(spark, d):
    f = frames(spark, d)
    return R.recall(queries_of(f), f.where("asset_class = 'class_1'"), 3).select("query_id", "item_id", C.half_even("score", 6).alias("score"))


VERD = "CASE frame_id%3 WHEN 0 THEN 'defect' WHEN 1 THEN 'nominal' ELSE 'unroutable' END"


def matches(spark, d):
    f = frames(spark, d)
    v = F.when(F.col("frame_id") % 3 == 0, "defect").when(F.col("frame_id") % 3 == 1, "nominal").otherwise("unroutable")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("frame_id").cast("int"))
    return R.recall(queries_of(f), f, 10).join(f.select(F.col("frame_id").alias("item_id"), v.alias("verdict"), ts.alias("ts")).hint("merge"), "item_id")


@query("fs3_recall", sql(FRAMES, f"SELECT query_id, item_id, round_even(score,4) AS similarity FROM ({NEAREST}) WHERE rank<=10"))
def fs3(spark, d):
    return matches(spark, d).select("query_id", "item_id", r4("score").alias("similarity"))


@query("fs4_recall_similar", sql(FRAMES, f"SELECT item_id, round_even(score,4) AS similarity FROM ({NEAREST}) WHERE rank<=10 AND query_id=40"))
def fs4(spark, d):
    f = frames(spark, d)
    return R.recall(f.where("frame_id = 40"), f, 10).select("item_id", r4("score").alias("similarity"))


@query("fs5_recurrence", sql(FRAMES, f"m AS (SELECT query_id, item_id AS frame_id FROM ({NEAREST}) WHERE rank<=10)", f"SELECT query_id, count(*) AS matches, count(*) FILTER ({VERD}='defect') AS defects, min(TIMESTAMP '2024-01-01'+to_hours(frame_id::INT)) AS first_seen, max(TIMESTAMP '2024-01-01'+to_hours(frame_id::INT)) AS last_seen FROM m GROUP BY 1"))
def fs5(spark, d):
    from ..operators.findings import recurrence

    return recurrence(matches(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("prj7_effective_gate", sql(*BUILD, "SELECT name, round_even(greatest(0.3,coalesce(gate,0)),4) AS gate FROM reg"))
def prj7(spark, d):
    return registry(spark, d).select("name", R.effective_gate("gate", 0.3).alias("gate"))


@query("rt1_route", sql(*WITH[:-1], "SELECT frame_id, rank::INT AS rank, name, round_even(raw,4) AS score, round_even(greatest(0.0,gate),4) AS gate FROM tops"))
def rt1(spark, d):
    return R.route(frames(spark, d), registry(spark, d), floor=0.0).select("frame_id", F.explode("candidates").alias("c")).select("frame_id", "c.rank", "c.name", "c.score", "c.gate")


@query("rt2_decide", sql(*WITH, "SELECT frame_id, name AS best_name, s AS routing_score, g AS best_gate, decision FROM decided"))
def rt2(spark, d):
    return decided(spark, d).select("frame_id", "best_name", "routing_score", "best_gate", "decision")


@query("rt3_ambiguous", sql(*WITH, "SELECT frame_id, CASE WHEN decision='route' THEN name WHEN decision='ambiguous' AND frame_id%2=0 THEN name END AS model_name, CASE WHEN decision='ambiguous' THEN CASE WHEN frame_id%2=0 THEN 'adjudicated' ELSE 'fallback' END ELSE 'threshold' END AS decision_source FROM decided"))
def rt3(spark, d):
    dec = decided(spark, d)
    given = dec.where("frame_id % 2 = 0").select("frame_id", F.col("best_name").alias("chosen_model_name"))
    return R.resolve_ambiguous(dec, given).select("frame_id", "model_name", "decision_source")


@query("rt4_next_step", sql(*WITH, "SELECT CASE WHEN decision='route' THEN 'infer' WHEN frame_id%3=0 THEN 'cold_start' ELSE 'narrate' END AS step, count(*) AS n FROM decided GROUP BY 1"))
def rt4(spark, d):
    df = R.resolve_ambiguous(decided(spark, d)).withColumn("has_references", F.col("frame_id") % 3 == 0)
    return df.groupBy(R.next_step().alias("step")).agg(F.count("*").alias("n"))


@query("rt5_reason", sql(*WITH, "SELECT frame_id, CASE WHEN s>=g THEN printf('score %.4f clears gate %.4f',s,g) ELSE printf('score %.4f is below gate %.4f',s,g) END AS decision_reason FROM decided"))
def rt5(spark, d):
    return decided(spark, d).select("frame_id", "decision_reason")


@query("rt6_compare_rules", sql(*WITH, "SELECT rule, count(*) FILTER (s>=c AND truth<>'class_9') AS accepted, count(*) FILTER (s<c AND truth='class_9') AS refused FROM (SELECT truth, s, unnest([{'rule':'global_0.55','c':0.55},{'rule':'global_0.6','c':0.6},{'rule':'per_model_gate','c':g}], recursive:=true) FROM decided) GROUP BY 1"))
def rt6(spark, d):
    tops = decided(spark, d).join(frames(spark, d).select("frame_id", "asset_class").hint("merge"), "frame_id").select(F.col("routing_score").alias("score"), F.col("best_gate").alias("gate"), (F.col("asset_class") != "class_9").alias("registered"))
    return R.compare_rules(tops, (0.55, 0.6))


def probes(spark, d):
    return frames(spark, d).select("frame_id", "asset_class", (F.col("asset_class") == "class_9").alias("withheld"))


RT7 = "p AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY truth ORDER BY frame_id)<=25)"


@query("rt7_routing_report", sql(*WITH, RT7, "SELECT CASE WHEN grouping(truth)=1 THEN '(all)' ELSE truth END AS asset_class, count(*) AS probes, count(*) FILTER (asset_class=truth) AS top1, count(*) FILTER (decision='route') AS routed, count(*) FILTER (decision='unroutable') AS refused, round_even(avg(s),4) AS mean_top, max(s) AS max_top, bool_or(truth='class_9') AND grouping(truth)=0 AS withheld FROM p GROUP BY ROLLUP (truth)"))
def rt7(spark, d):
    return R.routing_report(decided(spark, d), probes(spark, d))


@query("rt8_similarity_matrix", sql(*BUILD, f"SELECT a.name, b.name AS other, round_even({SIM.format(a='a.vec', b='b.vec')},6) AS score FROM reg a, reg b"))
def rt8(spark, d):
    m = registry(spark, d)
    other = m.select(F.col("name").alias("other"), F.col("vec").alias("ovec"))
    return R.nearest_targets(m, other, k=m.count(), row_id="name", target_id="other", target_vec="ovec").select("name", "other", C.half_even("score", 6).alias("score"))


SEP = "cand AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn, count(*) OVER () AS nn FROM frames WHERE asset_class='class_3'), parts AS (SELECT *, rn<=floor(0.7*nn) AS fit FROM cand)"


@query("rt9_separability", sql(*BUILD, SEP, cent("cc", "parts", "fit"), "others AS (SELECT asset_class, vec FROM reg WHERE asset_class<>'class_3' UNION ALL SELECT * FROM cc)", f"best AS (SELECT p.frame_id, o.asset_class AS top, {SIM.format(a='p.vec', b='o.vec')} AS s FROM parts p, others o WHERE NOT p.fit QUALIFY row_number() OVER (PARTITION BY p.frame_id ORDER BY s DESC, top)=1)", "SELECT count(*) AS probes, round_even(avg((top='class_3')::INT),4) AS top1_share, round_even(avg(s),4) AS mean_top FROM best"))
def rt9(spark, d):
    from pyspark.sql import Window

    cand = frames(spark, d).where("asset_class = 'class_3'")  # one class: its size bounds the window
    w = Window.partitionBy("asset_class")
    cand = cand.withColumn("fit", F.row_number().over(w.orderBy("ord")) <= F.floor(0.7 * F.count("*").over(w)))
    others = registry(spark, d).where("asset_class <> 'class_3'").select("asset_class", "vec").unionByName(R.centroids(cand.where("fit"))).withColumnRenamed("asset_class", "top")
    best = R.nearest_targets(cand.where("not fit"), others, 1, target_id="top")
    return best.agg(F.count("*").alias("probes"), r4(F.avg((F.col("top") == "class_3").cast("int"))).alias("top1_share"), r4(F.avg("score")).alias("mean_top"))


@query("rt10_holdout_acceptance", sql(*BUILD, f"SELECT asset_class, round_even(avg((s>=gate)::INT),4) AS accepted, round_even(avg((s>=0.6)::INT),4) AS accepted_global FROM (SELECT t.asset_class, {SIM.format(a='t.vec', b='r.vec')} AS s, r.gate FROM tr t JOIN reg r ON t.asset_class=r.asset_class WHERE t.n_fit<2 OR t.place>t.n_fit) GROUP BY 1"))
def rt10(spark, d):
    m = registry(spark, d)
    s = R.own_scores(R.split_holdout(frames(spark, d)).where("held"), m).join(m.select("asset_class", "gate").hint("merge"), "asset_class")
    share = lambda c: r4(F.avg(c.cast("int")))
    return s.groupBy("asset_class").agg(share(F.col("score") >= F.col("gate")).alias("accepted"), share(F.col("score") >= 0.6).alias("accepted_global"))


@query("rt12_layout")
def rt12(spark, d):
    return R.layout(registry(spark, d))


@query("jn1_routed_model", sql(*WITH, "SELECT d.frame_id, r.gate IS NULL AS missing FROM decided d LEFT JOIN (SELECT * FROM reg WHERE asset_class<>'class_0') r USING (name)"))
def jn1(spark, d):
    m = registry(spark, d).where("asset_class <> 'class_0'").select(F.col("name").alias("best_name"), "gate")
    return decided(spark, d).join(m.hint("merge"), "best_name", "left").select("frame_id", F.col("gate").isNull().alias("missing"))


@query("jn12_withheld", sql(MODELS, "SELECT DISTINCT 'class_'||label AS asset_class FROM embeddings WHERE 'class_'||label NOT IN (SELECT asset_class FROM models)"))
def jn12(spark, d):
    return frames(spark, d).select("asset_class").distinct().join(model_rows(spark, d), "asset_class", "left_anti")


LEDGER = "ledger AS (SELECT DISTINCT 'thread-'||(label%2) AS thread_id, asset_class, CASE WHEN label=7 THEN 'excluded' ELSE 'completed' END AS status FROM frames WHERE label<4 OR label=7), asked AS (SELECT DISTINCT 'thread-'||t AS thread_id, asset_class FROM frames, (SELECT unnest([0,1]) AS t))"


@query("jn14_resume", sql(FRAMES, LEDGER, "SELECT thread_id, asset_class FROM asked WHERE (thread_id, asset_class) NOT IN (SELECT (thread_id, asset_class) FROM ledger)"))
def jn14(spark, d):
    """Each of two threads resumes from the fit ledger: what it completed or left out is not asked again."""
    f = frames(spark, d).select("asset_class", "label").distinct()
    ledger = CommitLog(spark, S.scratch(spark, "ledger"))
    done = f.select(F.concat(F.lit("thread-"), (F.col("label") % 2).cast("string")).alias("thread_id"), "asset_class", "label")
    ledger.append(done.where("label < 4").select("thread_id", "asset_class", F.lit("completed").alias("status")), writer="fit", number=0)
    ledger.append(done.where("label = 7").select("thread_id", "asset_class", F.lit("excluded").alias("status")), writer="fit", number=1)
    asked = f.select(F.explode(F.array(F.lit("thread-0"), F.lit("thread-1"))).alias("thread_id"), "asset_class")
    return R.pending(asked, ledger.read())


EX = f"ex AS (SELECT f.asset_class, f.frame_id AS reference_image_id FROM frames f JOIN allc c ON f.asset_class=c.asset_class QUALIFY row_number() OVER (PARTITION BY f.asset_class ORDER BY round_even({SIM.format(a='f.vec', b='c.vec')},9) DESC, f.frame_id)=1), size AS (SELECT asset_class, count(*) AS training_samples FROM frames GROUP BY 1)"


@query("prj1_model_search_projection", sql(*BUILD, TOPS, EX, "SELECT frame_id, md5(name) AS model_id, name, asset_class, 'patchcore' AS backbone, training_samples, 0.3::DOUBLE AS image_threshold, round_even(t.gate,6) AS routing_threshold, 'n_held='||n_held AS metrics, 'seed' AS created_by, reference_image_id, round_even(raw,4) AS score FROM tops t JOIN size USING (asset_class) JOIN ex USING (asset_class) JOIN (SELECT asset_class, n_held FROM gates) USING (asset_class)"))
def prj1(spark, d):
    """The five nearest models of every frame, with all fields of a model but its vector."""
    f = frames(spark, d)
    m = registry(spark, d).join(R.exemplars(f).hint("merge"), "asset_class").join(f.groupBy("asset_class").agg(F.count("*").alias("training_samples")).hint("merge"), "asset_class")
    rows = m.select(F.md5("name").alias("model_id"), "name", "asset_class", F.split("name", "-")[1].alias("backbone"), "training_samples", F.lit(0.3).alias("image_threshold"), C.half_even("gate", 6).alias("routing_threshold"), F.concat(F.lit("n_held="), F.col("n_held").cast("string")).alias("metrics"), F.lit("seed").alias("created_by"), F.col("reference_frame_id").alias("reference_image_id"))
    found = R.nearest_targets(f, m, 5, target_id="name").withColumn("score", r4("score"))
    return O.projected(found, rows, O.MODEL_FIELDS, "name", "frame_id")


@query("prj2_finding_search_projection", sql(*WITH, f"m AS (SELECT query_id, item_id, score FROM ({NEAREST}) WHERE rank<=10)", f"SELECT query_id, 'finding-'||item_id AS finding_id, strftime(TIMESTAMP '2024-01-01'+to_hours(item_id::INT),'%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN decision='route' THEN asset_class END AS asset_class, {VERD.replace('frame_id', 'item_id')} AS verdict, round_even((item_id%100)/100,4) AS severity, round_even((item_id%50)/50,4) AS anomaly_score, (item_id%50)::DOUBLE AS raw_anomaly_score, CASE WHEN decision='route' THEN name END AS routed_model_name, s AS routing_score, decision||' at '||item_id AS agent_narrative, 'image-'||item_id AS uploaded_image_id, CASE WHEN decision='route' THEN 'heatmap-'||item_id END AS heatmap_id, round_even(score,4) AS score FROM m JOIN decided d ON d.frame_id=m.item_id"))
def prj2(spark, d):
    """The ten past findings most like each asked one, with all fields of a finding but its vector."""
    i = F.col("frame_id")
    routed = F.col("decision") == "route"
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=i.cast("int"))
    verdict = F.when(i % 3 == 0, "defect").when(i % 3 == 1, "nominal").otherwise("unroutable")
    name = lambda kind: F.concat(F.lit(kind), i.cast("string"))
    rows = decided(spark, d).select(
        name("finding-").alias("finding_id"), C.iso(ts).alias("timestamp"), F.when(routed, F.col("best_class")).alias("asset_class"), verdict.alias("verdict"), r4(i % 100 / 100).alias("severity"),
        r4(i % 50 / 50).alias("anomaly_score"), (i % 50).cast("double").alias("raw_anomaly_score"), F.when(routed, F.col("best_name")).alias("routed_model_name"), "routing_score",
        F.concat("decision", name(" at ")).alias("agent_narrative"), name("image-").alias("uploaded_image_id"), F.when(routed, name("heatmap-")).alias("heatmap_id"),
    )
    f = frames(spark, d)
    found = R.recall(queries_of(f), f, 10).select("query_id", F.concat(F.lit("finding-"), F.col("item_id").cast("string")).alias("finding_id"), r4("score").alias("score"))
    return O.projected(found, rows, O.FINDING_FIELDS, "finding_id", "query_id")


def versions(spark, d):
    m = model_rows(spark, d).select("name", "created_by", "training_samples")
    return m.where("name < 'class_6'"), m.where("name >= 'class_4'").withColumn("training_samples", F.col("training_samples") + 1000)


def committed(spark, d) -> CommitLog:
    """A registry of two commits: models, then newer rows of some and others beside them."""
    old, new = versions(spark, d)
    log = CommitLog(spark, S.scratch(spark, "registry"))
    log.append(old)
    log.upsert(new, "name")
    return log


V = "old AS (SELECT name, created_by, training_samples FROM models WHERE name<'class_6'), new AS (SELECT name, created_by, training_samples+1000 AS training_samples FROM models WHERE name>='class_4')"


@query("snk1_upsert", sql(MODELS, V, "SELECT * FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT * FROM new"))
def snk1(spark, d):
    return committed(spark, d).read()


@query("snk2_insert_suffixed", sql(MODELS, V, "SELECT CASE WHEN name IN (SELECT name FROM old) THEN name||'-1700000000' ELSE name END AS name, created_by, training_samples FROM new"))
def snk2(spark, d):
    return S.insert_suffixed(*versions(spark, d), "1700000000")


@query("snk3_provenance_upsert", "SELECT source AS asset_class, count(*) AS n FROM documents WHERE doc_id%2=0 GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id%2=0) GROUP BY 1")
def snk3(spark, d):
    docs = table(spark, d, "documents")
    n = lambda df: df.groupBy(F.col("source").alias("asset_class")).agg(F.count("*").alias("n"))
    log = CommitLog(spark, S.scratch(spark, "provenance"))
    log.append(n(docs))
    log.upsert(n(docs.where("doc_id % 2 = 0")), "asset_class")
    return log.read()


@query("snk1_earlier_version", sql(MODELS, V, "SELECT * FROM old"))
def snk1_earlier(spark, d):
    """A snapshot read: the registry as it was before the upsert."""
    return committed(spark, d).read(0)


@query("snk5_partial_update", sql(MODELS, V, "SELECT o.name, o.created_by, coalesce(n.training_samples,o.training_samples) AS training_samples FROM old o LEFT JOIN new n USING (name)"))
def snk5(spark, d):
    old, new = versions(spark, d)
    log = CommitLog(spark, S.scratch(spark, "registry"))
    log.append(old)
    log.update(new, "name", ["training_samples"])
    return log.read()


@query("snk8_superseded", sql(MODELS, V, "SELECT o.name, o.training_samples FROM old o JOIN new n USING (name) WHERE o.training_samples IS DISTINCT FROM n.training_samples"))
def snk8(spark, d):
    return committed(spark, d).superseded("name", "training_samples")


def ranked_area(name: str, source: str) -> str:
    return (
        f"{name}_h AS (SELECT asset_class, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM {source} GROUP BY ALL), {name}_b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY asset_class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM {name}_h), "
        f"{name} AS (SELECT asset_class, round_even(CASE WHEN sum(pos)*sum(neg)>0 THEN (sum(pos*(below+neg/2))/(sum(pos)*sum(neg)))::DOUBLE END,4) AS auroc FROM {name}_b GROUP BY 1)"
    )


FLEET = [
    PATCHES, BANK.replace("tr AS", "bank_tr AS").replace("JOIN tr", "JOIN bank_tr"), DIST, CELLS,
    "img AS (SELECT frame_id, asset_class, round_even(max(distance),9) AS score, frame_id%3=0 AS label FROM dist GROUP BY ALL)", "px AS (SELECT asset_class, v AS score, (x+y)%3=0 AS label FROM cells)",
    ranked_area("image_auc", "img"), ranked_area("pixel_auc", "px"), "held AS (SELECT asset_class, count(*) AS bank_rows FROM bank GROUP BY 1), size AS (SELECT asset_class, count(*) AS samples FROM frames GROUP BY 1)",
]


@query("fs10_fleet_report", sql(*BUILD, *FLEET, "SELECT name, asset_class, samples, 64::INT AS dims, bank_rows, bank_rows*64 AS bank_bytes, round_even(gate,4) AS gate, i.auroc AS image_auroc, p.auroc AS pixel_auroc, 0.0::DOUBLE AS parity, TRUE AS parity_match, asset_class IN ('class_1','class_2') AS resumed FROM reg JOIN size USING (asset_class) JOIN held USING (asset_class) JOIN image_auc i USING (asset_class) JOIN pixel_auc p USING (asset_class)"))
def fs10(spark, d):
    """One row a model: size, dimensions, samples, both AUROCs, and the greatest change of a score once the bank is read again."""
    f = frames(spark, d)
    ledger = f.where("label in (1, 2)").select("asset_class").distinct().withColumn("resumed", F.lit(True))
    bank, odd = split_patches(spark, d)
    again = S.written(bank, "reloaded")
    scores = S.written(scoring.image_scores(scoring.patch_distances(odd, bank)).select("frame_id", "asset_class", "raw_score"), "fleet-scores")
    image = scores.select("asset_class", C.half_even("raw_score", 9).alias("score"), (F.col("frame_id") % 3 == 0).alias("label"))
    pixel = map_cells(spark, d).select("asset_class", F.col("v").alias("score"), ((F.col("x") + F.col("y")) % 3 == 0).alias("label"))
    area = lambda df, name: scoring.auroc(df).select("asset_class", F.col("auroc").alias(name))
    parity = scoring.reload_parity(scores, scoring.image_scores(scoring.patch_distances(odd, again)))
    held = again.groupBy("asset_class").agg(F.count("*").alias("bank_rows"), F.sum(8 * F.size("pvec")).alias("bank_bytes"))
    samples = f.groupBy("asset_class").agg(F.count("*").alias("samples"))
    rows = R.fleet_report(registry(spark, d), samples, held, area(image, "image_auroc"), area(pixel, "pixel_auroc"), parity, ledger)
    return rows.select("name", "asset_class", "samples", F.size("vec").alias("dims"), "bank_rows", "bank_bytes", r4("gate").alias("gate"), "image_auroc", "pixel_auroc", C.half_even("parity", 6).alias("parity"), "parity_match", F.coalesce("resumed", F.lit(False)).alias("resumed"))


PROVENANCE = "prov AS (SELECT asset_class, count(*) AS raw_candidates, count(DISTINCT sha) AS after_dedupe, min(row_id) AS first_row, list_sort(list(DISTINCT defect)) AS defect_types FROM corpus GROUP BY 1)"


@query("fs11_provenance_listing", sql(CORPUS, PROVENANCE, "SELECT asset_class, json_object('asset_class', asset_class, 'raw_candidates', raw_candidates, 'after_dedupe', after_dedupe, 'first_row', first_row, 'defect_types', defect_types)::VARCHAR AS record FROM prov"))
def fs11(spark, d):
    """All provenance rows as their table holds them, serialised; null fields are kept."""
    own = corpus_rows(spark, d).groupBy("asset_class").agg(F.count("*").alias("raw_candidates"), F.countDistinct("sha").alias("after_dedupe"), F.min("row_id").alias("first_row"), F.sort_array(F.collect_set("defect")).alias("defect_types"))
    log = CommitLog(spark, S.scratch(spark, "provenance"))
    log.upsert(own, "asset_class")
    rows = log.read()
    return rows.select("asset_class", F.to_json(F.struct("asset_class", "raw_candidates", "after_dedupe", "first_row", "defect_types"), {"ignoreNullFields": "false"}).alias("record"))


@query("v2a_recall_before_decide", sql(*WITH, f"SELECT d.frame_id, d.decision, m.item_id FROM decided d JOIN (SELECT query_id, item_id FROM ({NEAREST}) WHERE rank<=3) m ON m.query_id=d.frame_id"))
def v2a(spark, d):
    f = frames(spark, d)
    return decided(spark, d).join(R.recall(queries_of(f), f, 3).withColumnRenamed("query_id", "frame_id").hint("merge"), "frame_id").select("frame_id", "decision", "item_id")


@query("v2d_score_drift", sql(*WITH, "SELECT name, round_even(avg(s) FILTER (frame_id%2=1)-avg(s),4) AS drift FROM decided GROUP BY 1"))
def v2d(spark, d):
    late = F.avg(F.when(F.col("frame_id") % 2 == 1, F.col("routing_score")))
    return decided(spark, d).groupBy(F.col("best_name").alias("name")).agg(r4(late - F.avg("routing_score")).alias("drift"))


@query("v2c_refusal_clusters")
def v2c(spark, d):
    return R.refusal_clusters(frames(spark, d), decided(spark, d, REFUSING_FLOOR))
