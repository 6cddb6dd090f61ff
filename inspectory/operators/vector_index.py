"""Approximate search over inverted lists of product-quantised residuals.

A quantiser is fitted once, on a bounded sample: coarse centroids (one for each list), and for each part of the residuals
256 codewords. The index is a table with one row for every searchable vector: its list, its id and one byte for each part,
written in folders by list, so a search reads the lists it probes and no others. New rows are coded with the same quantiser and
appended. A query probes the lists whose centroids are nearest, is multiplied with what list and code of each of their rows
stand for, and the best of these candidates are rescored on their full vectors.

Queries and rows of the probed lists are dealt into blocks of bounded size, and each pair of blocks meets in a group of its own:
a slice of the rows meets the queries that probe one of its lists, and only each query's best of the group go on. So neither a
hot list nor the number of lists that a query probes makes what is written grow; nothing is written once a query and list.
How many lists to probe is measured: ``probes_for`` searches a sample of the items exactly and takes the fewest lists that reach
the asked recall there; one scan tells for every number of lists.

Vectors that are null, of length 0 or of no searchable form are neither indexed nor asked. Equal scores are ordered by id.
No items or no queries give no rows. Only the sample of ``fit`` and the centroids pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written
from .ranks import small
from .routing import recall

#: Vectors on which a quantiser is fitted at most, rounds of k-means, and queries of a block at most.
SAMPLE, ROUNDS, CHUNK = 50_000, 8, 8192
#: A block's rows at most, in CHUNKs; queries from which a block is not split further, pairs of blocks wanted a core; queries and rows that are compared at once.
HELD, ASKED, CELLS, SLICE = 32, 512, 3, (256, 2048)
MOST_LISTS, WORDS = 4096, 256
#: Decimals of an approximate score, and how far a product may be from one.
PLACES, SAME = 12, 1e-12
#: Rows that a task yields at once of queries with their lists.
PROBED = 8192


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def nearest(x: np.ndarray, centres: np.ndarray, slice_rows: int = 1024) -> np.ndarray:
    own, size = np.empty(len(x), np.int64), (centres**2).sum(1)
    for lo in range(0, len(x), slice_rows):
        own[lo : lo + slice_rows] = np.argmin(size - 2 * x[lo : lo + slice_rows] @ centres.T, axis=1)
    return own


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """k centres; one that loses all its vectors moves to a random vector."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # lists x dimensions
    words: np.ndarray  # parts x WORDS x dimensions of a part

    @property
    def parts(self) -> int:
        return len(self.words)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code bytes of unit vectors."""
        own = nearest(x, self.centres)
        rest = (x - self.centres[own]).reshape(len(x), self.parts, -1)
        return own, np.stack([nearest(rest[:, p], self.words[p]) for p in range(self.parts)], 1).astype(np.uint8)

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists nearest to each vector, nearest first."""
        far = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def lists_of(self, x: np.ndarray, probes: int, slice_rows: int = 1024) -> np.ndarray:
        """``lists``, of a slice of the vectors at a time."""
        return np.concatenate([self.lists(x[lo : lo + slice_rows], probes).astype(np.int32) for lo in range(0, max(1, len(x)), slice_rows)])

    def vectors(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes stand for: centroids with the codewords added."""
        return self.centres[own] + self.words[np.arange(self.parts), codes].reshape(len(own), -1)

    def best(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray, order: np.ndarray, most: int, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``most`` greatest approximate dot products, in order, with rows of the lists it is a member of
        (of all, without ``member``), and the rows' places; equal ones by ``order``. Rows come sorted by list and code; -inf where there are fewer.

        A slice of each side is compared at a time, and only what reaches the least that a query holds is looked at further.
        Products are taken once for equal neighbours and rounded, so that where a row stands does not change its score."""
        score, at = np.full((len(x), most), -np.inf), np.zeros((len(x), most), np.int64)
        for lo in range(0, len(own), SLICE[1]):
            part, code = own[lo : lo + SLICE[1]], codes[lo : lo + SLICE[1]]
            unlike = np.append(True, (part[1:] != part[:-1]) | (code[1:] != code[:-1]).any(1))
            vectors = self.vectors(part[unlike], code[unlike]).T
            asked = np.arange(len(x)) if member is None else np.flatnonzero(member[:, part[0] : part[-1] + 1].any(1))
            for who in (asked[a : a + SLICE[0]] for a in range(0, len(asked), SLICE[0])):
                dots = x[who] @ vectors
                if not unlike.all():
                    dots = dots[:, np.cumsum(unlike) - 1]
                least, last = score[who, -1], order[at[who, -1]]
                r, c = np.divmod(np.flatnonzero(dots >= least[:, None] - SAME), len(part))
                value = dots[r, c].round(PLACES)
                kept = (value > least[r]) | (value == least[r]) & (order[lo + c] < last[r])
                if member is not None:
                    kept &= member[who[r], part[c]]
                r, c, value = r[kept], c[kept], value[kept]
                if not len(r):
                    continue
                hits = np.bincount(r, minlength=len(who))
                place, n, row = np.arange(len(r)) - (np.cumsum(hits) - hits)[r], hits[hits > 0], np.cumsum(hits > 0)[r] - 1
                new, new_at = np.full((len(n), n.max()), -np.inf), np.zeros((len(n), n.max()), np.int64)
                new[row, place], new_at[row, place] = value, lo + c
                who = who[hits > 0]
                new, new_at = np.concatenate([score[who], new], 1), np.concatenate([at[who], new_at], 1)
                top = np.argsort(-new, axis=1, kind="stable")
                ranked = np.take_along_axis(new, top, 1)
                tied = np.flatnonzero(((ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] > -np.inf)).any(1))
                if len(tied):
                    top[tied] = np.lexsort((order[new_at[tied]], -new[tied]))
                score[who], at[who] = ranked[:, :most], np.take_along_axis(new_at, top[:, :most], 1)
        return score, at


def budget_of(k: int) -> int:
    """Candidates that are rescored for k results."""
    return max(64, 20 * k)


def sampled(df: DataFrame, vec: str, most: int, seed: int) -> np.ndarray:
    """At most about ``most`` unit vectors of a table, by hash of the vector."""
    own = df.where(C.searchable(vec)).select(F.col(vec).cast("array<double>").alias("v"))
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1_000_000)) < int(1e6 * most / n))
    rows = [r.v for r in own.collect()]
    x = np.array(rows) if rows else np.empty((0, 1))
    return unit(x[np.lexsort(x.T)])  # in one order, so that a table gives one quantiser


def fit(items: DataFrame, lists: int | None = None, parts: int | None = None, vec: str = "vec", sample: int = SAMPLE, seed: int = 7) -> Quantiser:
    """A quantiser from a bounded sample. By default the square root of the number of items as lists, and two dimensions a part."""
    x = sampled(items, vec, sample, seed)
    if not len(x):
        raise ValueError("no searchable vector to fit on")
    rng = np.random.default_rng(seed)
    lists = min(lists or max(1, round(items.count() ** 0.5)), MOST_LISTS, len(x))
    size = x.shape[1]
    parts = parts or max(p for p in range(1, size // 2 + 1) if size % p == 0)
    centres = k_means(x, lists, rng)
    rest = (x - centres[nearest(x, centres)]).reshape(len(x), parts, -1)
    return Quantiser(centres, np.stack([k_means(rest[:, p], WORDS, rng) for p in range(parts)]))


def met(quantiser: Quantiser, queries: pa.Table, items: pa.Table, probes: list[int], budget: int) -> pa.Table:
    """(probes, query_id, item_id, about) of a block of queries (query_id, v) and one of index rows: each query's best, ``budget`` or one more."""
    names, lists = ["probes", "query_id", "item_id", "about"], len(quantiser.centres)
    out = [pa.Table.from_arrays([pa.array([], pa.int32()), queries["query_id"].slice(0, 0), items["id"].slice(0, 0), pa.array([], pa.float64())], names)]
    if not len(queries) or not len(items):
        return out[0]
    items = items.sort_by([("list", "ascending"), ("code", "ascending"), ("id", "ascending")])
    own, codes = items["list"].to_numpy(), np.frombuffer(b"".join(items["code"].to_pylist()), np.uint8).reshape(len(items), -1)
    # rows of one list and code have one score: of each the first by id are enough, one more than asked, as the query may be among them
    unlike = np.append(True, (own[1:] != own[:-1]) | (codes[1:] != codes[:-1]).any(1))
    few = np.arange(len(own)) - np.flatnonzero(unlike)[np.cumsum(unlike) - 1] <= budget
    own, codes, items = own[few], codes[few], items.filter(pa.array(few))
    order = np.empty(len(own), np.int64)
    order[pc.sort_indices(items["id"]).to_numpy()] = np.arange(len(own))
    x = unit(np.array(queries["v"].to_pylist(), float))
    near = quantiser.lists_of(x, max(probes)) if min(probes) < lists else None
    for number in probes:
        member = None
        if number < lists:
            member = np.zeros((len(x), lists), bool)
            np.put_along_axis(member, near[:, :number], True, 1)
        score, at = quantiser.best(x, own, codes, order, budget + 1, member)
        asked, place = np.nonzero(score > -np.inf)
        found = [pa.array(np.full(len(asked), number, np.int32)), queries["query_id"].take(pa.array(asked)), items["id"].take(pa.array(at[asked, place])), pa.array(score[asked, place])]
        found = pa.Table.from_arrays(found, names)
        out.append(found.filter(pc.fill_null(pc.not_equal(found["query_id"], found["item_id"]), True)))
    return pa.concat_tables(out)


class VectorIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser) -> None:
        self.spark, self.path, self.quantiser = spark, path, quantiser
        self.sent = spark.sparkContext.broadcast(quantiser)

    def add(self, items: DataFrame, id_col: str = "frame_id", vec: str = "vec") -> VectorIndex:
        """Append rows. Each list's rows are gathered first; large lists are split into several files."""
        sent = self.sent

        def run(parts):
            for pdf in parts:
                if len(pdf):
                    own, codes = sent.value.code(unit(np.stack(pdf.v.to_numpy())))
                    yield pd.DataFrame({"id": pdf["id"], "code": [c.tobytes() for c in codes], "list": own})

        source = items.where(C.searchable(vec)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        rows = source.mapInPandas(run, f"id {dict(items.dtypes)[id_col]}, code binary, list int")
        rows.hint("rebalance", F.col("list")).write.mode("append").partitionBy("list").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def probed(self, queries: DataFrame, probes: int, id_col: str = "frame_id", vec: str = "vec") -> DataFrame:
        """(query_id, v, list) for each list that a query probes, about PROBED of them at a time."""
        sent, step = self.sent, max(1, PROBED // probes)

        def run(parts):
            for pdf in parts:
                for lo in range(0, len(pdf), step):
                    asked = pdf.iloc[lo : lo + step]
                    x = unit(np.stack(asked.v.to_numpy()))
                    own = sent.value.lists(x, probes)
                    at = np.repeat(np.arange(len(x)), own.shape[1])
                    yield pd.DataFrame({"query_id": asked.query_id.to_numpy()[at], "v": [x[i] for i in at], "list": own.ravel()})

        source = queries.where(C.searchable(vec)).select(F.col(id_col).alias("query_id"), F.col(vec).cast("array<double>").alias("v"))
        return source.mapInPandas(run, f"query_id {dict(queries.dtypes)[id_col]}, v array<double>, list int")

    def asked_lists(self, queries: DataFrame, probes: int) -> list[int]:
        """Every list that some query (query_id, v) probes, at most MOST_LISTS."""
        sent = self.sent

        def run(parts):
            for pdf in parts:
                for lo in range(0, len(pdf), PROBED):
                    x = unit(np.stack(pdf.v.iloc[lo : lo + PROBED].to_numpy()))
                    yield pd.DataFrame({"list": np.unique(sent.value.lists_of(x, probes))})

        return sorted(r["list"] for r in queries.select("v").mapInPandas(run, "list int").distinct().collect())

    def blocks(self, queries: int, rows: int) -> tuple[int, int]:
        """How many blocks of queries meet how many of rows: as few as tasks hold, or enough to keep all cores at work."""
        most = lambda n, size: max(1, -(-n // size))
        wanted = CELLS * self.spark.sparkContext.defaultParallelism
        r = most(rows, HELD * CHUNK)
        q = max(most(queries, CHUNK), min(most(wanted, r), most(queries, ASKED)))
        return q, max(r, min(most(wanted, q), most(rows, CHUNK)))

    def candidates(self, queries: DataFrame, probes: list[int], budget: int, id_col: str = "frame_id", vec: str = "vec") -> DataFrame:
        """(probes, query_id, item_id, about): for each number of probes the best ``budget`` rows of each query's lists, itself left out."""
        sent, most = self.sent, max(probes)
        asked = queries.where(C.searchable(vec)).select(F.col(id_col).alias("query_id"), F.col(vec).cast("array<double>").alias("v"))
        rows = self.rows()
        if most < len(self.quantiser.centres):
            rows = rows.where(F.col("list").isin(self.asked_lists(asked, most)))  # prunes folders
        q_blocks, r_blocks = self.blocks(asked.count(), rows.count())
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        q = asked.withColumn("q", block("query_id", q_blocks)).withColumn("r", every(r_blocks))
        r = rows.select("id", "code", "list", block("id", r_blocks).alias("r")).withColumn("q", every(q_blocks))
        kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["id"]

        def best(queries: pa.Table, items: pa.Table) -> pa.Table:
            return met(sent.value, queries, items, probes, budget)

        found = q.groupBy("q", "r").cogroup(r.groupBy("q", "r")).applyInArrow(best, f"probes int, query_id {kinds[0]}, item_id {kinds[1]}, about double")
        place = F.row_number().over(Window.partitionBy("probes", "query_id").orderBy(F.desc("about"), "item_id"))
        return found.withColumn("place", place).where(F.col("place") <= budget).drop("place")

    def search(self, queries: DataFrame, items: DataFrame, k: int, probes: int, budget: int | None = None, id_col: str = "frame_id", vec: str = "vec") -> DataFrame:
        """The best k of the candidates by their full vectors: (query_id, item_id, score, rank)."""
        pairs = written(self.candidates(queries, [probes], budget or budget_of(k), id_col, vec).select("query_id", "item_id"), "candidates")
        v = lambda df, n: df.select(F.col(id_col).alias(f"{n}_id"), C.as_doubles(vec).alias(f"{n}_v")).hint("merge")
        scored = pairs.join(v(items, "item"), "item_id").join(v(queries, "query"), "query_id").select("query_id", "item_id", C.similarity("query_v", "item_v").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k)

    def share_read(self, queries: DataFrame, probes: int, id_col: str = "frame_id", vec: str = "vec") -> float:
        """Rows in a query's lists over all rows, on average."""
        sizes = written(self.rows().groupBy("list").agg(F.count("*").alias("n")), "sizes")
        got = self.probed(queries, probes, id_col, vec).join(small(sizes), "list").agg(F.sum("n")).first()[0] or 0
        asked, all_rows = queries.where(C.searchable(vec)).count(), sizes.agg(F.sum("n")).first()[0] or 0
        return got / max(1, asked * all_rows)

    def probes_for(self, items: DataFrame, k: int = 10, least: float = 0.95, queries: int = 200, id_col: str = "frame_id", vec: str = "vec") -> int:
        """The fewest lists, of 1, 2, 4, ... and all, with which about ``queries`` sampled items find this share of their k nearest.
        One of the k nearest that is among the candidates is among the k best of them, so candidates alone tell, and one scan finds them for every number of lists."""
        n = max(1, items.where(C.searchable(vec)).count() // queries)
        sample = written(items.where(F.pmod(F.xxhash64(F.lit("probes"), id_col), F.lit(n)) == 0), "probe-sample")
        exact = written(recall(sample, items, k, id_col, vec), "exact")
        wanted, lists = exact.count(), len(self.quantiser.centres)
        numbers = [1 << i for i in range((lists - 1).bit_length())]
        if not numbers:
            return lists
        found = self.candidates(sample, numbers, budget_of(k), id_col, vec).join(exact.select("query_id", "item_id").hint("merge"), ["query_id", "item_id"], "left_semi")
        share = dict(map(tuple, found.groupBy("probes").count().collect()))
        return next((p for p in numbers if share.get(p, 0) >= least * wanted), lists)


def indexed(items: DataFrame, path: str, lists: int | None = None, id_col: str = "frame_id", vec: str = "vec", train: Callable[..., Quantiser] = fit) -> VectorIndex:
    """Fit on the items, and index all of them."""
    return VectorIndex(items.sparkSession, path, train(items, lists, vec=vec)).add(items, id_col, vec)
