"""Harmonic packing into fixed-length token sequences.

A piece of length r belongs to class k = capacity // r: exactly k pieces of that class fill one sequence, so each class
is filled on its own, by counting, without a search. A remainder that would waste much of its class is cut to the longest
piece of the next class and goes on with what is left (at most a few cuts; from class 32 on, the waste is below a
32nd). Pieces are counted by class and by hash bucket; a prefix sum of these counts gives each piece its place, so no
task sees a whole class. At most k - 1 pieces of each class are left over; this fixed number (about 21,000 at 4,096
tokens) is packed best-fit-decreasing on the driver.

A null text is empty and gives its end id only. Very long texts are cut, never shortened. Repeated rows and equal ids are
packed row by row; pieces that tie in id, start and ids are alike, so their order is of no matter. An empty table gives no
sequences. Further columns of any name are ignored.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, written
from .tokens import WordEncoder

CAPACITY, END, FINE, FULL, FEW = 4096, 2, 32, 0.98, 200_000


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out, at = [], 0
    while at < n:
        r = n - at
        k = capacity // r if r < capacity else 1
        size = min(r, capacity) if k >= FINE or r * k >= FULL * capacity else capacity // (k + 1)
        out.append((at, size))
        at += size
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts; one row for each piece, with its ids as bytes if asked for."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        encoder, end = WordEncoder(vocabulary), END.to_bytes(4, "little")

        def each(batch):
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", *(["ids"] * keep_ids))}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.ids(text.as_py() or "") + end
                for start, n in cuts(len(raw) // 4, capacity):
                    ids = raw[4 * start : 4 * (start + n)]
                    for c, v in zip(out, (doc, start, n, zlib.crc32(ids), len(raw) // 4, capacity // n, ids)):
                        out[c].append(v)
            yield out

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, k int" + ", ids binary" * keep_ids, make)


def packed_rest(rest: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """(k, index, length) -> (k, index, bin, offset): each, longest first, into the fullest bin that has room."""
    room: list[tuple[int, int]] = []
    out, bins = [], 0
    for k, index, n in sorted(rest, key=lambda x: (-x[2], x[0], x[1])):
        i = bisect.bisect_left(room, (n, -1))
        free, b = room.pop(i) if i < len(room) else (capacity, bins)
        bins = max(bins, b + 1)
        out.append((k, index, b, capacity - free))
        bisect.insort(room, (free - n, b))
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    spark = rows.sparkSession
    rows = written(rows, "pieces")
    buckets = 8 + rows.count() // 50_000
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy("k", "bucket").agg(F.count("*").alias("n")), "counts")
    before = written(counts.select("k", "bucket", (F.sum("n").over(Window.partitionBy("k").orderBy("bucket")) - F.col("n")).alias("before")), "before")
    before = F.broadcast(before) if before.count() <= FEW else before.hint("merge")
    classes, base = [], 0
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect():
        classes.append((r.k, base, r.n // r.k * r.k))
        base += r.n // r.k
    index = F.col("before") + F.row_number().over(Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = rows.join(before, ["k", "bucket"]).withColumn("index", index.cast("long"))
    placed = written(placed.join(F.broadcast(spark.createDataFrame(classes, "k int, base long, filled long")), "k").drop("bucket", "before"), "placed")
    rest = placed.where("index >= filled").select("k", "index", "length").collect()  # fewer than k of each class
    own = spark.createDataFrame([(k, i, base + b, o) for k, i, b, o in packed_rest([tuple(r) for r in rest], capacity)], "k int, index long, sequence_id long, offset long")
    done = placed.where("index >= filled").join(F.broadcast(own), ["k", "index"])
    filled = placed.where("index < filled").withColumn("sequence_id", F.col("base") + F.floor(F.col("index") / F.col("k")).cast("long"))
    in_bin = Window.partitionBy("sequence_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long"))
    return filled.unionByName(done).drop("k", "index", "base", "filled")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
