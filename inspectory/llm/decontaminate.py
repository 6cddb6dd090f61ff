"""Benchmark decontamination by spaced seeds.

A mask over consecutive words keeps some positions and ignores the others, so a seed still matches when ignored words were
replaced. Seeds of documents and of benchmark items are joined by hash; around each hit, along its diagonal, the longest
stretch with at least 80 % equal words is found, and reported if it spans 13 words from an equal word to an equal word. An
item of any length is also reported if it stands whole with at least 80 % equal words, its ends included; so an item of
fewer than 5 words must stand as it is.

The masks find every such case: of 13 words or more with 80 % equal, some 4 next to each other are, but for 15 words with
every fourth changed, which hold 1110111. Shorter items have masks by their length.

Documents are read once, whatever the benchmark's size. In that reading a bitmap of the benchmark's seeds (16 MB at most,
OR-ed together on the cluster) holds back seeds that no item has; a larger benchmark only lets more through. What passes
is written with the words around it, in tiles as wide as the longest item, so that long documents stay in bounded rows.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased, so case and punctuation are
ignored. Null and empty texts and items match nothing; repeated rows are treated alike, and equal ids stay apart; of
several places of one item in a document the longest is given, the first among equals. Very long texts are read whole;
columns of any other name are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, mix, utf8, word_hashes, written
from .licenses import TO_WORDS

MASKS = ("1111", "1110111")
#: Masks of items by their number of words, where others than MASKS are needed.
SHORT = {n: ("1" * n,) for n in range(1, 5)} | {5: ("1111", "11011", "10111", "11101"), 6: ("1111", "111011", "110111"), 10: ("1111", "111011")}
SPAN, SIMILAR = 13, 0.8
#: Bits of the bitmap, as powers of 2; seeds and bytes of items that are broadcast (beyond, they are merge-joined).
LEAST_BITS, MOST_BITS, PROBES, FEW_SEEDS, FEW_BYTES, LEAST_TILE = 20, 27, 3, 2_000_000, 64_000_000, 256


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask and of the kept words at each of its places."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int("1" + mask, 2), np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1":
            out = (out + h[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return mix(out)


def stretch(equal: np.ndarray, share: float = SIMILAR) -> tuple[int, int]:
    """(start, end) of the longest run in which at least ``share`` are true and both ends are."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    least = np.minimum.accumulate(np.where(np.append(equal, False), total, np.inf))
    most = np.maximum.accumulate(np.where(np.append(False, equal), total, -np.inf)[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    while i < len(total) and j < len(total):
        if most[j] >= least[i] - 1e-9:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    return best


def overlap(item: np.ndarray, words: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """(first word, words, equal words) of the longest overlap on the diagonals that start at ``shifts``; the first among equals."""
    best = None
    for shift in sorted(shifts):
        a, b = max(0, -shift), min(len(item), len(words) - shift)
        equal = item[a:b] == words[a + shift : b + shift]
        same = int(equal.sum())
        if 5 * same < 4 * min(SPAN, len(item)):
            continue
        if b - a == len(item) and 5 * same >= 4 * len(item):
            x, y = 0, len(item)
        else:
            x, y = stretch(equal)
        if y - x >= min(SPAN, len(item)) and (best is None or y - x > best[1]):
            best = a + x + shift, y - x, int(equal[x:y].sum())
    return best


def hashed(text: bytes) -> np.ndarray:
    return word_hashes(text.translate(TO_WORDS).split())


def item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words, n) of each item that has words, and (seed, item, pos)."""
    kind = dict(benchmark.dtypes)["item_id"]

    def make_items():
        def each(batch):
            h = [hashed(t or b"") for t in utf8(batch.column(1))]
            yield {"item_id": batch.column(0), "words": [x.tobytes() for x in h], "n": [len(x) for x in h]}

        return each

    items = arrow_map(benchmark.select("item_id", "text"), f"item_id {kind}, words binary, n int", make_items).where("n > 0")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def make_seeds():
        def each(batch):
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                for mask in SHORT.get(len(h), MASKS):
                    s = seeds(h, mask).view(np.int64)
                    yield {"seed": s, "item": np.full(len(s), item), "pos": np.arange(len(s), dtype=np.int32)}

        return each

    return items, written(arrow_map(items.select("item", "words"), "seed long, item long, pos int", make_seeds), "seeds")


def places_of(seed: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """Bit of each seed for one of the probes: the top bits of the seed turned by 21 bits a probe."""
    turn = np.uint64(21 * probe)
    return ((seed << turn) | (seed >> ((np.uint64(64) - turn) & np.uint64(63)))) >> np.uint64(64 - bits)


def bitmap(found: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The number of bits, as a power of 2, and the bitmap of these seeds in 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    turned = [F.shiftleft("seed", 21 * p).bitwiseOR(F.shiftrightunsigned("seed", 64 - 21 * p)) if p else F.col("seed") for p in range(PROBES)]
    at = found.select(F.explode(F.array(*(F.shiftrightunsigned(t, 64 - bits) for t in turned))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    whole = at.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(one).alias("on")).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[whole.column("word").to_numpy()] = whole.column("on").to_numpy().view(np.uint64)
    return bits, out


def tiles(docs: DataFrame, id_col: str, text_col: str, masks: list[str], widest: int, bits: int, on: np.ndarray) -> DataFrame:
    """(doc, doc_id, start, words, seeds, places): each part of a document that has seeds of the bitmap, with the words around."""
    sent = docs.sparkSession.sparkContext.broadcast(on)
    size = max(widest, LEAST_TILE)
    kind = dict(docs.dtypes)[id_col]

    def make():
        own, number = sent.value, [TaskContext.get().partitionId() << 36]

        def passing(s: np.ndarray) -> np.ndarray:
            at = np.arange(len(s))
            for p in range(PROBES):
                bit = places_of(s[at], bits, p)
                at = at[(own[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            return at

        def each(batch):
            out: dict[str, list] = {c: [] for c in ("doc", "doc_id", "start", "words", "seeds", "places")}
            for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                number[0] += 1
                h = hashed(t or b"")
                by_mask = [seeds(h, m) for m in masks]
                hits = [passing(s) for s in by_mask]
                if not any(map(len, hits)):
                    continue
                place, seed = np.concatenate(hits), np.concatenate([s[x] for s, x in zip(by_mask, hits)]).view(np.int64)
                tile = place // size
                for k in np.unique(tile).tolist():
                    start = max(0, k * size - widest)
                    for c, v in zip(out, (number[0], d, start, h[start : (k + 1) * size + widest].tobytes(), seed[tile == k], place[tile == k].astype(np.int32))):
                        out[c].append(v)
            yield out

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc long, doc_id {kind}, start int, words binary, seeds array<long>, places array<int>", make)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", few_seeds: int = FEW_SEEDS, few_bytes: int = FEW_BYTES) -> DataFrame:
    """One row for each document row and item that overlap: doc_id, item_id, start_word, n_words, n_equal."""
    items, found = item_tables(benchmark)
    size = items.agg(F.max("n").alias("widest"), F.sum("n").alias("words")).first()
    masks = sorted({m for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect() for m in SHORT.get(r.n, MASKS)})
    n = found.count()
    part = written(tiles(docs, id_col, text_col, masks, size.widest or 0, *bitmap(found, n)).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    hits = part.select("tile", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("tile", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    hits = hits.join(F.broadcast(found) if n <= few_seeds else found.hint("merge"), "seed")
    pairs = written(hits.groupBy("tile", "item").agg(F.collect_set(F.col("place") - F.col("pos")).alias("shifts")), "diagonals")
    items = items.select("item", "item_id", F.col("words").alias("item_words"))
    both = pairs.join(part.select("tile", "doc", "doc_id", "start", "words").hint("merge"), "tile").join(F.broadcast(items) if 8 * (size.words or 0) <= few_bytes else items.hint("merge"), "item")
    kinds = dict(both.dtypes)

    def make():
        def each(batch):
            out: dict[str, list] = {c: [] for c in ("doc", "doc_id", "item", "item_id", "start_word", "n_words", "n_equal")}
            for r in batch.to_pylist():
                one = overlap(np.frombuffer(r["item_words"], np.uint64), np.frombuffer(r["words"], np.uint64), [s - r["start"] for s in r["shifts"]])
                if one:
                    for c, v in zip(out, (r["doc"], r["doc_id"], r["item"], r["item_id"], one[0] + r["start"], *one[1:])):
                        out[c].append(v)
            yield out

        return each

    checked = arrow_map(both, f"doc long, doc_id {kinds['doc_id']}, item long, item_id {kinds['item_id']}, start_word long, n_words long, n_equal long", make)
    row = F.struct("doc_id", "item_id", "start_word", "n_words", "n_equal")
    return checked.groupBy("doc", "item").agg(F.max_by(row, F.struct("n_words", -F.col("start_word"))).alias("best")).select("best.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, bench).withColumn("similarity", F.col("n_equal") / F.col("n_words"))
