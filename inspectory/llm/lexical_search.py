"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

``build_index`` deals documents into blocks of bounded size and writes, for each term of a block, its postings (ordinals in
the block and occurrences). ``search`` reads the postings of the query's terms alone and brings those of a block together.
In a block, each query sums the lists of its short terms (at most one posting for every SHORT documents) into accumulators,
which then are one list with upper bounds like any other. Documents are visited in windows, and a window is skipped when
the bounds of the accumulators and of the long lists cannot reach the k-th best score so far. The best of the blocks
are ranked by Spark.

A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased and nothing else is. Scores are
64-bit integers. Equal scores are ordered by id, null ids last; of rows that are equal in both any order holds. Null and
empty texts have no terms: as documents they count nowhere, as queries they find nothing. Repeated rows are documents of
their own, repeated items (null ids included) queries of their own. Very long texts are indexed whole. No documents or no
items give no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import LOWER, arrow_map, parts, small_batches, utf8, written

#: ASCII letters and digits and all bytes beyond ASCII are terms' own; the rest parts them.
TO_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
#: A block holds this many documents, and terms with their repeats, at most (one document may hold more).
BLOCK_DOCS, BLOCK_TERMS = 16_384, 2_000_000
#: Documents of a window; a list is short with fewer postings than one for so many documents.
WINDOW, SHORT = 64, 32
#: Terms of the queries that are searched at a time.
QUERY_TERMS = 200_000


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_TERMS).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (block, term, n, docs, tfs), and one (block, ids, lengths, n, total) without a term for each block.

    docs: ordinals as uint16, tfs and lengths: uint32; ordinals follow the ids, null ones last."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"block long, term binary, n long, docs binary, tfs binary, ids array<{kind}>, total long"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = np.append(0, ends).astype(np.int32) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])

    def block(name: int, ids: list, found: list[np.ndarray], names: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
        lengths = np.array([len(found[i]) for i in order], np.uint32)
        term = np.concatenate([found[i] for i in order])
        key, tf = np.unique(term << 16 | np.repeat(np.arange(len(order)), lengths), return_counts=True)
        at = np.flatnonzero(np.diff(key >> 16, append=-1)) + 1
        own = {"block": pa.array(np.full(len(at), name)), "term": pa.array([names[i] for i in (key[at - 1] >> 16).tolist()], pa.binary()), "n": pa.array(np.diff(at, prepend=0)), "docs": blobs((key & 0xFFFF).astype(np.uint16), at), "tfs": blobs(tf.astype(np.uint32), at)}
        head = {"block": [name], "n": [int((lengths > 0).sum())], "tfs": [lengths.tobytes()], "ids": [[ids[i] for i in order]], "total": [int(lengths.sum())]}
        for out in (own, head):
            size = len(out["block"])
            yield pa.RecordBatch.from_pydict({f.name: out.get(f.name, pa.nulls(size, f.type)) for f in fields}, schema=fields)

    def run(batches):
        first, n, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, found, number = [], [], {}
        for batch in parts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = terms(text)
                if ids and (len(ids) >= BLOCK_DOCS or size + len(own) > BLOCK_TERMS):
                    yield from block(first + n, ids, found, list(number))
                    ids, found, number, size, n = [], [], {}, 0, n + 1
                ids.append(doc)
                found.append(np.fromiter((number.setdefault(t, len(number)) for t in own), np.int64, len(own)))
                size += len(own)
        if ids:
            yield from block(first + n, ids, found, list(number))

    return written(small_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema), "index")


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """The postings of one block, as the queries need them."""

    def __init__(self, lengths: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int) -> None:
        m = 100 - 75 + 75 * lengths.astype(np.int64) * n_docs // n_terms
        self.size, self.windows = len(lengths), -(-len(lengths) // WINDOW)
        self.lists = {t: (d.astype(np.int64), impacts(f.astype(np.int64), m[d])) for t, (d, f) in lists.items()}
        self.long = {t: self.bounded(*x) for t, x in self.lists.items() if len(x[0]) * SHORT > self.size}

    def bounded(self, docs: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting of each window and one past the last; the largest value in each window."""
        start = np.searchsorted(docs, np.arange(self.windows + 1) * WINDOW)
        most = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(np.diff(start))
        if len(full):
            most[full] = np.maximum.reduceat(value, start[full])
        return start, most

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and scores of the k best documents with a score above 0; query: (term, weight times its repeats)."""
        lists, bound = [], np.zeros(self.windows, np.int64)
        short = [(t, w) for t, w in query if t in self.lists and t not in self.long]
        if short:  # term at a time
            docs, at = np.unique(np.concatenate([self.lists[t][0] for t, _ in short]), return_inverse=True)
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, at, np.concatenate([w * self.lists[t][1] for t, w in short]))
            start, most = self.bounded(docs, total)
            lists.append((docs, total, start, 1))
            bound += most
        for t, w in query:
            if t in self.long:
                start, most = self.long[t]
                lists.append((*self.lists[t], start, w))
                bound += w * most
        top, score = np.empty(0, np.int64), np.empty(0, np.int64)
        todo, step = np.argsort(-bound, kind="stable"), 8
        while len(todo) and bound[todo[0]] > 0 and (len(top) < k or bound[todo[0]] >= score[-1]):
            now, todo, step = np.sort(todo[:step]), todo[step:], 2 * step
            sums, place = np.zeros(len(now) * WINDOW, np.int64), np.zeros(self.windows, np.int64)
            place[now] = np.arange(len(now)) * WINDOW
            for docs, value, start, w in lists:  # every list skips to the windows
                begin, n = start[now], start[now + 1] - start[now]
                at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
                np.add.at(sums, place[docs[at] // WINDOW] + docs[at] % WINDOW, w * value[at])
            own = np.flatnonzero(sums)
            top, score = np.append(top, now[own // WINDOW] * WINDOW + own % WINDOW), np.append(score, sums[own])
            keep = np.lexsort((top, -score))[:k]
            top, score = top[keep], score[keep]
        return top, score


def ranking(sent, n_docs: int, n_terms: int, k: int):
    """What ranks one block's documents for all queries that were sent: (row, [(term, weight times its repeats)])."""

    def ranked(postings: pa.Table, head: pa.Table) -> pa.Table:
        number = lambda kind, x: [np.frombuffer(v, kind) for v in x.to_pylist()]
        rows = zip(postings["t"].to_pylist(), number(np.uint16, postings["docs"]), number(np.uint32, postings["tfs"]))
        block = Block(np.frombuffer(head["lengths"][0].as_py(), np.uint32), {t: (d, f) for t, d, f in rows}, n_docs, n_terms)
        found = [(row, *block.best(query, k)) for row, query in sent.value]
        at = np.concatenate([np.empty(0, np.int64), *(x[1] for x in found)])
        score = np.concatenate([np.empty(0, np.int64), *(x[2] for x in found)])
        row = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        return pa.table({"row": row, "doc_id": head["ids"].combine_chunks().flatten().take(pa.array(at)), "score": score})

    return ranked


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents of an index."""
    spark = index.sparkSession
    doc_kind = dict(index.dtypes)["ids"].removeprefix("array<")[:-1]

    def make():
        def each(batch):
            own = [Counter(terms(t)) for t in utf8(batch.column(2))]
            yield {"row": batch.column(0), "item_id": batch.column(1), "terms": [list(c) for c in own], "repeats": [list(c.values()) for c in own]}

        return each

    asked = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item_id"), F.col(text_col).alias("text"))
    asked = written(arrow_map(asked, f"row long, item_id {dict(asked.dtypes)['item_id']}, terms array<binary>, repeats array<long>", make), "items")
    sums = index.where("term is null").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.size("ids"))).first()
    n_batches = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS
    heads = index.where("term is null").select("block", "ids", F.col("tfs").alias("lengths"))
    out = spark.createDataFrame([], f"row long, doc_id {doc_kind}, score long")
    for b in range(n_batches if sums.n else 0):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_batches)) == b).select("row", "terms", "repeats").collect()
        names = {t: i for i, t in enumerate(dict.fromkeys(bytes(t) for r in own for t in r.terms))}
        if not names:
            continue
        sought = F.broadcast(spark.createDataFrame([(bytearray(t), i) for t, i in names.items()], "term binary, t int"))  # QUERY_TERMS of them at most, or one item's
        hits = written(index.where("term is not null").join(sought, "term").select("block", "t", "n", "docs", "tfs"), "hits")
        weight = {r.t: math.floor(1000 * math.log((2 * sums.n + 2) / (2 * r.df + 1))) for r in hits.groupBy("t").agg(F.sum("n").alias("df")).collect()}
        queries = [(r.row, [(i, n * weight[i]) for t, n in zip(r.terms, r.repeats) if (i := names[bytes(t)]) in weight]) for r in own]
        sent = spark.sparkContext.broadcast(queries)

        best = hits.groupBy("block").cogroup(heads.join(hits.select("block").distinct().hint("merge"), "block", "left_semi").groupBy("block")).applyInArrow(ranking(sent, sums.n, sums.total, k), out.schema)
        best = written(best, "best")
        sent.destroy()
        out = out.unionAll(best)
    place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.join(asked.select("row", "item_id").hint("merge"), "row").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), sizes AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM terms),
postings AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), sizes GROUP BY item_id, doc_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
