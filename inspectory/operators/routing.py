"""Vector search, centroids, gates and routing with abstention.

Search never joins all with all on the cluster: one side comes in blocks of bounded size, is sent to the tasks, and the
other side is mapped in Arrow batches with a matrix product; only the best k of each task go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..sources.tables import scratch, written
from .ranks import exact_quantiles, numbered, small, with_group_size

BLOCK, AT_ONCE = 4096, 8
#: Items that are compared with a block of queries at once, and rows with a block of targets: what a task holds does not grow with its batches.
ITEMS, ROWS = 512, 512


class Gathered:
    """Rows of many plans that each hold a broadcast block. After every ``at_once`` of them their rows are written into one folder
    and their blocks are dropped, so neither driver nor plan grows with the number of blocks."""

    def __init__(self, like: DataFrame, schema: str, reduce, at_once: int = AT_ONCE) -> None:
        self.spark, self.schema, self.reduce, self.at_once = like.sparkSession, StructType.fromDDL(schema), reduce, at_once
        self.path, self.flushed, self.parts, self.sent = scratch(self.spark, "gathered"), 0, [], []

    def broadcast(self, value):
        """Sends a block; what the earlier ones gave is written first if there are enough of them."""
        if len(self.parts) >= self.at_once:
            self.union().write.parquet(f"{self.path}/turn={self.flushed}")
            for x in self.sent:
                x.destroy()
            self.flushed, self.parts, self.sent = self.flushed + 1, [], []
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)

    def union(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionAll(part)
        return self.reduce(out).select(*self.schema.names)

    def rows(self) -> DataFrame:
        own = self.union() if self.parts else self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names).unionAll(own) if self.flushed else own


def _blocks(df: DataFrame, id_col: str, vec: str, block: int):
    """Ids and unit vectors, a bounded block at a time; the table is dealt into blocks once."""
    own = df.where(C.searchable(vec)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    number = max(1, -(-own.count() // block))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)))
    if number > 1:
        own = written(own.repartition("block").sortWithinPartitions("block"), "blocks")
    for n in range(number):
        rows = own.where(F.col("block") == n).collect()
        if rows:
            m = np.array([r.v for r in rows])
            yield [r.id for r in rows], m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


class Running:
    """The best (greatest) scores of each query so far, with their items; equal scores are kept a few deep, so that ids can settle them."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.score, self.item = most, np.empty((n, 0)), None

    def add(self, score: np.ndarray, item: np.ndarray) -> None:
        if self.score.shape[1] == self.most and self.item.dtype == item.dtype:
            return self.add_few(score, item)
        score = np.concatenate([self.score, score], 1)
        item = np.broadcast_to(item, (len(score), len(item)))
        item = item if self.item is None else np.concatenate([self.item, item], 1)
        if score.shape[1] >= self.most:
            top = np.argsort(-score, axis=1, kind="stable")[:, : self.most]
            score, item = np.take_along_axis(score, top, 1), np.take_along_axis(item, top, 1)
        self.score, self.item = score, item

    def add_few(self, score: np.ndarray, item: np.ndarray) -> None:
        """Only what exceeds the least score that a query holds can be among its best."""
        r, c = np.divmod(np.flatnonzero(score > self.score[:, -1:]), max(1, len(item)))
        if not len(r):
            return
        hits = np.bincount(r, minlength=len(score))
        who, n = np.flatnonzero(hits), hits[hits > 0]
        row, place = np.cumsum(hits > 0)[r] - 1, np.arange(len(r)) - (np.cumsum(hits) - hits)[r]
        new, new_item = np.full((len(who), n.max()), -np.inf), np.full((len(who), n.max()), item[0], self.item.dtype)
        new[row, place], new_item[row, place] = score[r, c], item[c]
        new, new_item = np.concatenate([self.score[who], new], 1), np.concatenate([self.item[who], new_item], 1)
        top = np.argsort(-new, axis=1, kind="stable")[:, : self.most]
        self.score[who], self.item[who] = np.take_along_axis(new, top, 1), np.take_along_axis(new_item, top, 1)

    def frame(self, ids: np.ndarray, least: float) -> pd.DataFrame:
        n = self.score.shape[1]
        if not n:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        out = pd.DataFrame({"query_id": np.repeat(ids, n), "item_id": self.item.ravel(), "score": self.score.ravel()})
        return out[out.score >= least]


def _best(df: DataFrame, key: str, other: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), other)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_targets(rows: DataFrame, targets: DataFrame, k: int, row_id: str = "frame_id", target_id: str = "name", row_vec: str = "vec", target_vec: str = "vec", block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """The best k targets of every row: (row_id, target_id, score, rank). Targets in blocks, rows in batches, no shuffle but to merge blocks."""
    kinds = dict(rows.dtypes)[row_id], dict(targets.dtypes)[target_id]
    schema = f"{row_id} {kinds[0]}, {target_id} {kinds[1]}, score double"
    found = Gathered(rows, schema, lambda df: _best(df, row_id, target_id, k), at_once)
    source = rows.where(C.searchable(row_vec)).select(row_id, F.col(row_vec).cast("array<double>").alias("v"))
    for ids, m in _blocks(targets, target_id, target_vec, block):
        sent = found.broadcast((np.array(ids, dtype=object), m))

        def run(parts, sent=sent):
            ids, m = sent.value
            for pdf in parts:
                for lo in range(0, len(pdf), ROWS):
                    own = pdf.iloc[lo : lo + ROWS]
                    x = np.stack(own.v.to_numpy())
                    score = (1 + (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)) @ m.T) / 2
                    top = np.argsort(-score, axis=1, kind="stable")[:, : k + 8]  # a few more, so ties are settled by id below
                    yield pd.DataFrame({row_id: np.repeat(own[row_id].to_numpy(), top.shape[1]), target_id: ids[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()})

        found.add(source.mapInPandas(run, schema))
    return _best(found.rows(), row_id, target_id, k)


def _searched(source: DataFrame, columns: tuple[str, str], blocks, scores, most: int, least: float, kind: str, k: int, at_once: int = AT_ONCE) -> DataFrame:
    """(query_id, item_id, score): the ``most`` best of every task, for each block of queries; of blocks that are written early, the best ``k``."""
    schema = f"query_id {kind}, item_id {kind}, score double"
    found = Gathered(source, schema, lambda df: _best(df, "query_id", "item_id", k), at_once)
    for ids, own in blocks:
        sent = found.broadcast((np.array(ids, dtype=object), own))

        def run(parts, sent=sent):
            ids, own = sent.value
            best = Running(len(ids), most)
            for pdf in parts:
                for lo in range(0, len(pdf), ITEMS):
                    part = pdf.iloc[lo : lo + ITEMS]
                    items = part[columns[0]].to_numpy()
                    best.add(scores(ids, own, items, part[columns[1]]), items)
            yield best.frame(ids, least)

        found.add(source.mapInPandas(run, schema))
    return found.rows()


def recall(queries: DataFrame, items: DataFrame, k: int, id_col: str = "frame_id", vec: str = "vec", block: int = BLOCK, exclude_self: bool = True, at_once: int = AT_ONCE) -> DataFrame:
    """The best k items of every query: (query_id, item_id, score, rank). Queries in blocks against all items."""
    source = items.where(C.searchable(vec)).select(id_col, F.col(vec).cast("array<double>").alias("v"))

    def scores(ids, m, own, vectors):
        x = np.stack(vectors.to_numpy())
        score = (1 + m @ (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).T) / 2
        if exclude_self:
            asked = set(ids)
            at = np.flatnonzero([i in asked for i in own.tolist()])  # few of the items are queries of this block
            r, c = np.nonzero(ids[:, None] == own[at])
            score[r, at[c]] = -1
        return score

    found = _searched(source, (id_col, "v"), _blocks(queries, id_col, vec, block), scores, k + 8, 0.0, dict(items.dtypes)[id_col], k, at_once)
    return _best(found, "query_id", "item_id", k)


CODE_BITS, QUERY_SLICE = 512, 64


def bit_codes(df: DataFrame, id_col: str = "frame_id", vec: str = "vec", bits: int = CODE_BITS, seed: int = 3) -> DataFrame:
    """(id, code): signs of random projections, 64 bytes a vector at 512 bits. This is the index: one row for every searchable item."""

    def run(parts):
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf.v.to_numpy())
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits))
                yield pd.DataFrame({"id": pdf["id"], "code": [c.tobytes() for c in np.packbits(x @ planes > 0, 1)]})

    own = df.where(C.searchable(vec)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return own.mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, code binary")


def approximate_recall(queries: DataFrame, items: DataFrame, k: int, id_col: str = "frame_id", vec: str = "vec", bits: int = CODE_BITS, budget: int | None = None, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """The best k of a budget of candidates, max(64, 20 k) by default: those whose bit codes differ least from the query's,
    rescored exactly. The codes, not the vectors, are scanned; every item has one."""
    budget = budget or max(64, 20 * k)
    index = written(bit_codes(items, id_col, vec, bits, seed), "bit-codes")
    asked = bit_codes(queries, id_col, vec, bits, seed)
    number = max(1, -(-asked.count() // block))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number))), "asked")
    unpacked = lambda codes: np.frombuffer(b"".join(map(bytes, codes)), np.uint64).reshape(len(codes), -1)

    def blocks():
        for n in range(number):
            rows = asked.where(F.col("block") == n).collect()  # about ``block`` rows
            if rows:
                yield [r.id for r in rows], unpacked([r.code for r in rows])

    def scores(ids, own, items, codes):
        x, out = unpacked(codes.tolist()), np.empty((len(ids), len(items)))
        for at in range(0, len(own), QUERY_SLICE):
            out[at : at + QUERY_SLICE] = -np.bitwise_count(own[at : at + QUERY_SLICE, None] ^ x[None]).sum(2, dtype=np.int64)
        out[ids[:, None] == items[None, :]] = -bits - 1
        return out

    found = _searched(index, ("id", "code"), blocks(), scores, budget, -bits, dict(items.dtypes)[id_col], budget)
    pairs = written(_best(found, "query_id", "item_id", budget).select("query_id", "item_id"), "candidates")
    v = lambda n: items.select(F.col(id_col).alias(f"{n}_id"), C.as_doubles(vec).alias(f"{n}_v")).hint("merge")
    asked_v = queries.select(F.col(id_col).alias("query_id"), C.as_doubles(vec).alias("query_v")).hint("merge")
    scored = pairs.join(v("item"), "item_id").join(asked_v, "query_id").select("query_id", "item_id", C.similarity("query_v", "item_v").alias("score"))
    return _best(scored, "query_id", "item_id", k)


def agreement(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact neighbours found, and of equal first ones within 0.005."""
    both = exact.join(approximate.select("query_id", "item_id", F.col("score").alias("other")).hint("merge"), ["query_id", "item_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.avg(F.col("other").isNotNull().cast("int")).alias("recall"), F.avg(F.when(F.col("rank") == 1, (F.coalesce(F.abs(F.col("score") - F.col("other")), F.lit(1.0)) < 5e-3).cast("int"))).alias("top1"))


# -- registry building


def centroids(frames: DataFrame, key: str = "asset_class") -> DataFrame:
    """Mean vector of each class, normalised; a class whose mean vanishes has none."""
    means = frames.select(key, F.posexplode(C.as_doubles("vec")).alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    norm = C.l2_norm("mean")
    return whole.where(norm >= 1e-12).select(key, F.transform("mean", lambda x: x / norm).alias("vec"))


def split_holdout(frames: DataFrame, key: str = "asset_class", share: float = 0.2, least: int = 8) -> DataFrame:
    """Adds n, place and held: the last min(n-1, max(least, int(share n))) by stable order; with fewer than two left to fit, both parts are all rows."""
    df = with_group_size(numbered(frames, [key], ["ord", "frame_id"], "place"), [key], "n")
    hold = F.least(F.col("n") - 1, F.greatest(F.lit(least), F.floor(share * F.col("n"))))
    return df.withColumn("n_fit", F.col("n") - hold).withColumn("few", F.col("n_fit") < 2).withColumn("held", F.col("few") | (F.col("place") > F.col("n_fit"))).withColumn("fit", F.col("few") | (F.col("place") <= F.col("n_fit")))


def own_scores(frames: DataFrame, centres: DataFrame, key: str = "asset_class") -> DataFrame:
    """Similarity of each frame to its own class."""
    return frames.join(small(written(centres.select(key, F.col("vec").alias("centre")), "centres")), key).withColumn("score", C.similarity("vec", "centre"))


def seed_gates(frames: DataFrame, key: str = "asset_class", slack: float = 0.012) -> DataFrame:
    """min(5th percentile, median - slack) of held-out scores against a centroid of the rest."""
    parts = split_holdout(frames, key)
    scores = written(own_scores(parts.where("held"), centroids(parts.where("fit"), key), key).select(key, "score"), "held-scores")
    q = exact_quantiles(scores, key, "score", {"low": 0.05, "median": 0.5})
    return q.join(scores.groupBy(key).agg(F.count("*").alias("n_held")).hint("merge"), key).select(key, F.least("low", F.col("median") - slack).alias("gate"), "n_held")


def coldstart_gates(frames: DataFrame, key: str = "asset_class") -> DataFrame:
    """5th percentile of in-sample scores."""
    return exact_quantiles(own_scores(frames, centroids(frames, key), key), key, "score", {"gate": 0.05})


def exemplars(frames: DataFrame, key: str = "asset_class") -> DataFrame:
    scores = own_scores(frames, centroids(frames, key), key)
    return scores.groupBy(key).agg(F.max_by("frame_id", F.struct(F.bround("score", 9), -F.col("frame_id"))).alias("reference_frame_id"), F.max("score").alias("score"))


def register_models(frames: DataFrame, key: str = "asset_class") -> DataFrame:
    """One row for each class: name, centroid, gate, exemplar, sample count."""
    counts = frames.groupBy(key).agg(F.count("*").alias("training_samples"))
    return counts.join(centroids(frames, key).hint("merge"), key).join(seed_gates(frames, key).hint("merge"), key).join(exemplars(frames, key).drop("score").hint("merge"), key).withColumn("name", C.default_name(key))


# -- routing


def effective_gate(gate="gate", floor: float = 0.82):
    return C.half_even(F.greatest(F.lit(floor), F.coalesce(C.col(gate), F.lit(0.0))))


def route(frames: DataFrame, models: DataFrame, k: int = 5, floor: float = 0.82, block: int = BLOCK) -> DataFrame:
    """Candidates, best first, with rounded score and gate; without models, none and score 0."""
    models = written(models.select("name", "asset_class", "gate", "vec"), "models")
    found = nearest_targets(frames, models, k, block=block).join(small(models.select("name", "asset_class", "gate")), "name") if models.take(1) else None
    ids = frames.select("frame_id")
    if found is None:
        return ids.withColumn("candidates", F.array().cast("array<struct<rank:int,name:string,asset_class:string,score:double,gate:double>>")).withColumn("routing_score", F.lit(0.0))
    c = F.struct("rank", "name", "asset_class", C.half_even("score").alias("score"), effective_gate("gate", floor).alias("gate"))
    rows = found.groupBy("frame_id").agg(F.array_sort(F.collect_list(c)).alias("candidates"))
    return ids.join(rows.hint("merge"), "frame_id", "left").withColumn("routing_score", F.coalesce(F.get("candidates", 0)["score"], F.lit(0.0)))


def decide(routed: DataFrame, margin: float = 0.02) -> DataFrame:
    """route, ambiguous or unroutable by the best candidate's rounded score and gate, with the reason."""
    best = F.get("candidates", 0)
    df = routed.withColumns({"best_name": best["name"], "best_class": best["asset_class"], "best_gate": best["gate"]})
    s, g = F.col("routing_score"), F.col("best_gate")
    decision = F.when(g.isNull(), "unroutable").when(s >= g, "route").when(s >= C.half_even(g - margin, 6), "ambiguous").otherwise("unroutable")
    reason = F.when(g.isNull(), "no models are registered").when(s >= g, F.format_string("score %.4f clears gate %.4f", s, g)).otherwise(F.format_string("score %.4f is below gate %.4f", s, g))
    return df.withColumn("decision", decision).withColumn("decision_reason", reason)


def resolve_ambiguous(decided: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """Ambiguous frames take an adjudication that names one of their candidates, else they are refused."""
    if adjudications is None:
        chosen = F.lit(None).cast("string")
        df = decided
    else:
        df = decided.join(adjudications.select("frame_id", "chosen_model_name").hint("merge"), "frame_id", "left")
        chosen = F.when(F.exists("candidates", lambda c: c["name"] == F.col("chosen_model_name")), F.col("chosen_model_name"))
    open_ = F.col("decision") == "ambiguous"
    df = df.withColumn("model_name", F.when(F.col("decision") == "route", F.col("best_name")).when(open_, chosen))
    df = df.withColumn("decision_source", F.when(open_, F.when(F.col("model_name").isNotNull(), "adjudicated").otherwise("fallback")).otherwise("threshold"))
    return df.withColumn("final", F.when(F.col("model_name").isNotNull(), "route").otherwise("unroutable"))


def next_step(final="final", has_references="has_references"):
    return F.when(C.col(final) == "route", "infer").when(C.col(has_references), "cold_start").otherwise("narrate")


def compare_rules(tops: DataFrame, cuts: tuple[float, ...] = (0.82, 0.86, 0.88)) -> DataFrame:
    """Accepted registered and refused withheld frames, for global cuts and for the own gate; tops: score, gate, registered."""
    passes = {f"global_{c}": F.col("score") >= c for c in cuts} | {"per_model_gate": F.col("score") >= F.col("gate")}
    sums = tops.agg(*(x for n, p in passes.items() for x in (F.count_if(p & F.col("registered")).alias(f"{n}:a"), F.count_if(~p & ~F.col("registered")).alias(f"{n}:r"))))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}:a`").alias("accepted"), F.col(f"`{n}:r`").alias("refused")) for n in passes))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def routing_report(decided: DataFrame, probes: DataFrame, most: int = 25) -> DataFrame:
    """For each class and overall: probes (the first by name), right top class, routed, refused, mean and max top score."""
    first = probes.withColumn("rn", F.row_number().over(Window.partitionBy("asset_class").orderBy("frame_id"))).where(F.col("rn") <= most).drop("rn")
    df = decided.join(first.select("frame_id", "asset_class", "withheld").hint("merge"), "frame_id")
    out = df.rollup("asset_class").agg(
        F.count("*").alias("probes"), F.count_if(F.col("best_class") == F.col("asset_class")).alias("top1"), F.count_if(F.col("decision") == "route").alias("routed"), F.count_if(F.col("decision") == "unroutable").alias("refused"),
        C.half_even(F.avg("routing_score")).alias("mean_top"), F.max("routing_score").alias("max_top"), F.max("withheld").alias("withheld"), F.grouping("asset_class").alias("g"),
    )
    return out.withColumn("asset_class", F.when(F.col("g") == 1, "(all)").otherwise(F.col("asset_class"))).withColumn("withheld", F.col("withheld") & (F.col("g") == 0)).drop("g")


def refusal_clusters(frames: DataFrame, decided: DataFrame, k: int = 2, least: int = 2) -> DataFrame:
    """Clusters of refused frames in vector space, with their sizes and mean vectors: each of at least ``least`` frames is a class to propose for a cold start. No refusals, no rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    refused = decided.where("decision = 'unroutable'").select("frame_id")
    refused = written(frames.join(refused.hint("merge"), "frame_id").select("frame_id", "vec"), "refused").withColumn("features", array_to_vector("vec"))
    if refused.isEmpty():
        return frames.sparkSession.createDataFrame([], "cluster int, frames long, first_frame bigint")
    found = KMeans(k=k, seed=1).fit(refused).transform(refused)
    return found.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("frames"), F.min("frame_id").alias("first_frame")).where(F.col("frames") >= least)


def layout(models: DataFrame) -> DataFrame:
    """Angle of each model on a circle: rank of its direction in the plane of the two main components; by name below three models."""
    n = models.count()
    if n < 3:
        ranked = models.withColumn("key", F.lit(0.0))
    else:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector, vector_to_array

        mean = models.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
        x = models.join(F.broadcast(mean)).withColumn("x", array_to_vector(F.zip_with("vec", "mean", lambda a, b: a - b)))  # one row
        p = vector_to_array("p")
        ranked = PCA(k=2, inputCol="x", outputCol="p").fit(x).transform(x).withColumn("key", F.atan2(p[1], p[0]))
    slot = F.row_number().over(Window.orderBy("key", "name")) - 1  # registry rows only
    return ranked.withColumn("slot", slot).withColumn("angle", 2 * np.pi * F.col("slot") / max(n, 1)).select("name", "slot", "angle", "gate")


def pending(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Classes (thread_id, asset_class) that the ledger's thread has neither completed nor excluded."""
    over = ledger.where(F.col("status").isin("completed", "excluded")).select("thread_id", "asset_class").distinct()
    return asked.select("thread_id", "asset_class").distinct().join(over.hint("merge"), ["thread_id", "asset_class"], "left_anti")


def fleet_report(models: DataFrame, *parts: DataFrame, key: str = "asset_class") -> DataFrame:
    """Models with the columns of each part, which has a row a class at most; what a class has no row for is null."""
    for part in parts:
        models = models.join(part.hint("merge"), key, "left")
    return models
