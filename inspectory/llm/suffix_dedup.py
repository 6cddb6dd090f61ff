"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A string of SPAN bytes is repeated if its bytes start at two places of the input. To sort few suffixes and yet miss no
such string, each window of SPAN bytes names one of its GRAM-byte grams by content alone (least hash, leftmost), so
equal windows name equal grams at the same offset. Suffixes that start at named grams are the ones that are sorted, and
only those whose gram's hash occurs twice in the input.

Each task sorts its suffixes, collapses equal ones and writes front-coded runs (length of the prefix shared with the one
before, then the rest) for each bucket of gram hashes. Runs of a bucket are merged by a loser tree that carries common
prefix lengths, so known prefixes are never compared again. The merged lengths tell, within a gram's group, which windows
are shared: a window that starts l bytes before the gram is shared by two places if their common suffix before the gram
is at least l and their common prefix from it at least SPAN - l. Flags go back by run and place in the run; which
documents stand behind a place never leaves the shared folder's table, so copies do not gather in one task.

A bucket whose unlike entries are more than one task should hold (the edge of a passage that very many documents share)
is not merged in one: its runs' windows are counted by their 128-bit hash over the cluster, each run's equal windows
first made one row, and those found twice give the same flags.

Equal texts are one text (by a 64-bit key; where two texts have the same key, which a second hash tells, both get another);
those of SPAN bytes or more with a copy go whole. A null text is empty; texts shorter than SPAN are kept as they are, very
long ones are cut into segments that overlap by SPAN. Repeated rows are copies of each other; ids are carried only, so
null or equal ids do no harm. An empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_map, mix, parts, small_batches, utf8, written

SPAN, GRAM, SEGMENT, BUCKET_ROWS, RUN_ROWS, MASK_BYTES = 200, 48, 1 << 18, 20_000, 150_000, 20
RUN_ENTRIES, HOT_ENTRIES, MOST_ALIKE = 4096, 2 * BUCKET_ROWS, 10_000
GRAMS = SPAN - GRAM + 1
_BASE = 0x2545F4914F6CDD1D


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    def of(b):
        with np.errstate(over="ignore"):
            return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SEGMENT + SPAN, b, np.uint64))])

    return of(_BASE), of(pow(_BASE, -1, 2**64))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    up, down = powers()
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)])
    return (p[GRAM:] - p[:-GRAM]) * down[: len(x) - GRAM + 1]


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    up = np.minimum.accumulate(blocks, 1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Named grams: place, first and last start of the windows that name it, hash."""
    out = []
    for s0 in range(0, len(text) - SPAN + 1, SEGMENT - SPAN):
        h = gram_hashes(np.frombuffer(text, np.uint8)[s0 : s0 + SEGMENT - 1].astype(np.uint64))  # SEGMENT - SPAN windows
        low = np.uint64((1 << 20) - 1)
        at = (window_minima((mix(h) & ~low) | np.arange(len(h), dtype=np.uint64), GRAMS) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        out.append((at[first] + s0, first + s0, last + s0, h[at[first]]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, at least ``at``."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    lo, hi = at, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def encoded(run: list[tuple[bytes, bytes, bool]]) -> bytes:
    """Sorted (suffix, bytes before it, more than once) as a front-coded run."""
    out, last = [], b""
    for suffix, before, more in run:
        n = common(last, suffix)
        out += [n.to_bytes(2, "little"), (len(suffix) - n).to_bytes(2, "little"), bytes((len(before), more)), suffix[n:], before]
        last = suffix
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(prefix shared with the one before, suffix, bytes before it, more than once)"""
    at, suffix, size = 0, b"", len(blob)
    while at < size:
        n, rest, before, more = int.from_bytes(blob[at : at + 2], "little"), int.from_bytes(blob[at + 2 : at + 4], "little"), blob[at + 4], blob[at + 5]
        at += 6
        suffix = suffix[:n] + blob[at : at + rest]
        at += rest
        yield n, suffix, blob[at : at + before], bool(more)
        at += before


def merged(runs: list[Iterator[tuple[int, bytes, bytes, bool]]]) -> Iterator[tuple[int, bytes, bytes, bool, int]]:
    """Merge sorted runs; yields (prefix shared with the one before, suffix, bytes before it, more than once, run).

    Each player has the length that its suffix shares with the last winner; the longer one is smaller, and only equal
    lengths are compared, from there on. The loser keeps what it shares with the player that beat it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def duel(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[x] is None or heads[y] is None:
            return (y, x) if heads[x] is None else (x, y)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        n = common(a, b, shared[x])
        if a[n : n + 1] > b[n : n + 1]:
            x, y = y, x
        shared[y] = n
        return x, y

    losers, players = [0] * size, list(range(size))
    while len(players) > 1:
        half = len(players) // 2
        for i in range(half):
            players[i], losers[half + i] = duel(players[2 * i], players[2 * i + 1])
        players = players[:half]
    top = players[0]
    while heads[top] is not None:
        _, suffix, before, more = heads[top]
        yield shared[top], suffix, before, more, top
        heads[top] = next(runs[top], None)
        shared[top] = heads[top][0] if heads[top] else 0
        at = (size + top) // 2
        while at:
            top, losers[at] = duel(top, losers[at])
            at //= 2


def bits(lo: int, hi: int) -> int:
    return (1 << (hi + 1)) - (1 << lo) if lo <= hi else 0


def shared_windows(group: list[tuple[bytes, bytes, bool]], shared: list[int]) -> list[int]:
    """For each (suffix, bytes before, more than once) of a gram's group in suffix order, the set of l whose window also starts elsewhere, as bits. shared[i]: common prefix of i - 1 and i."""
    most = [bits(max(0, SPAN - len(s)), len(b)) for s, b, _ in group]
    kinds: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (s, b, _) in enumerate(group):
        kinds.setdefault((s, b), []).append(i)
    own = [most[g[0]] if len(g) > 1 or group[g[0]][2] else 0 for g in kinds.values()]
    firsts = [g[0] for g in kinds.values()]
    if len(firsts) > 24:
        found = by_prefixes([group[i][:2] for i in firsts], [0] + [min(shared[i + 1 : j + 1]) for i, j in zip(firsts, firsts[1:])])
        own = [a | b for a, b in zip(own, found)]
    else:
        for y in range(1, len(firsts)):
            j = firsts[y]
            prefix, i = SPAN, j
            for x in range(y - 1, -1, -1):
                while i > firsts[x]:
                    prefix = min(prefix, shared[i])
                    i -= 1
                a, b = group[firsts[x]][1], group[j][1]
                n = common(a[::-1], b[::-1])
                both = bits(max(0, SPAN - prefix), n) & most[firsts[x]] & most[j]
                own[x] |= both
                own[y] |= both
    out = [0] * len(group)
    for g, mask in zip(kinds.values(), own):
        for i in g:
            out[i] = mask
    return out


def by_prefixes(group: list[tuple[bytes, bytes]], shared: list[int]) -> list[int]:
    """The same for a large group of unlike entries in suffix order: common prefixes in two orders, that of the suffixes and
    that of the bytes before read backwards, tell for each offset which entries are alike on both sides of the gram."""
    n = len(group)
    backwards = [b[::-1] for _, b in group]
    order = sorted(range(n), key=backwards.__getitem__)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ahead = np.array(shared)
    behind = np.array([0] + [common(backwards[i], backwards[j]) for i, j in zip(order, order[1:])])
    before = np.array([len(b) for _, b in group])
    least = np.array([max(0, SPAN - len(s)) for s, _ in group])
    on = np.zeros((n, 8 * MASK_BYTES), np.uint8)
    for el in range(int(least.min()), int(before.max()) + 1):
        rows = np.flatnonzero((before >= el) & (least <= el))
        if len(rows) > 1:
            kind = np.cumsum(ahead < SPAN - el)[rows] * (n + 1) + np.cumsum(behind < el)[place[rows]]
            _, own, times = np.unique(kind, return_inverse=True, return_counts=True)
            on[rows[times[own] > 1], el] = 1
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(on, 1, "little")]


def merge_bucket(runs: list[bytes]) -> list[bytes]:
    """Window sets of each entry of each run, MASK_BYTES each."""
    out: list[list[bytes]] = [[] for _ in runs]
    group, shared, owners = [], [], []

    def close():
        for mask, run in zip(shared_windows(group, shared), owners):
            out[run].append(mask.to_bytes(MASK_BYTES, "little"))

    for n, suffix, before, more, run in merged([decoded(r) for r in runs]):
        if group and n < GRAM:
            close()
            group, shared, owners = [], [], []
        group.append((suffix, before, more))
        shared.append(n)
        owners.append(run)
    if group:
        close()
    return [b"".join(x) for x in out]


def gram_table(texts: DataFrame) -> DataFrame:
    """(k, h, c): how often each text names each gram."""

    def make():
        def each(batch):
            ks, hs, cs = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if t and len(t) >= SPAN:
                    h, c = np.unique(anchors(t)[3], return_counts=True)
                    ks.append(np.full(len(h), k, np.int64))
                    hs.append(h.view(np.int64))
                    cs.append(c.astype(np.int32))
            cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            yield {"k": cat(ks, np.int64), "h": cat(hs, np.int64), "c": cat(cs, np.int32)}

        return each

    return arrow_map(texts.select("k", "text"), "k long, h long, c int", make)


def runs_table(hit: DataFrame, buckets: int) -> DataFrame:
    """(bucket, run, n, entries, places) from (k, text, hs): front-coded runs of n entries, RUN_ENTRIES at most, and for each entry the texts and places behind it."""
    schema = "bucket long, run long, n int, entries binary, places binary"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def flushed(held: dict[int, dict], run: int):
        cols = {"bucket": [], "run": [], "n": [], "entries": [], "places": []}
        for bucket, entries in held.items():
            whole = sorted(entries)
            for at in range(0, len(whole), RUN_ENTRIES):
                order = whole[at : at + RUN_ENTRIES]
                places, sizes = [], []
                for e in order:
                    places += entries[e]
                    sizes.append(len(entries[e]))
                cols["bucket"].append(bucket)
                cols["run"].append((run << 8) + at // RUN_ENTRIES)
                cols["n"].append(len(order))
                cols["entries"].append(encoded([(*e, n > 1) for e, n in zip(order, sizes)]))
                cols["places"].append(len(sizes).to_bytes(4, "little") + np.array(sizes, "<i4").tobytes() + np.array(places, "<i8").tobytes())
        return pa.RecordBatch.from_pydict(cols, schema=fields)

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 20, {}, 0
        for batch in parts(batches):
            for k, t, hs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2)):
                place, first, last, h = anchors(t)
                h = h.view(np.int64)
                mine = np.isin(h, hs.values.to_numpy())
                for a, s, e, g in zip(place[mine].tolist(), first[mine].tolist(), last[mine].tolist(), h[mine].tolist()):
                    held.setdefault(g % buckets, {}).setdefault((t[a : e + SPAN], t[s:a]), []).append((k, a))
                    n += 1
                if n >= RUN_ROWS:
                    yield flushed(held, number)
                    number, held, n = number + 1, {}, 0
        if held:
            yield flushed(held, number)

    return small_batches(hit).mapInArrow(run, schema)


def window_masks(runs: DataFrame) -> DataFrame:
    """(bucket, run, masks) from (bucket, run, n, entries), for runs too many for one task; runs without a repeated window give no row."""

    def make_windows():
        def each(batch):
            for bucket, run, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                times: dict[bytes, int] = {}
                places: dict[bytes, list[int]] = {}
                for i, (_, suffix, before, more) in enumerate(decoded(entries)):
                    text, edge = before + suffix, len(before)
                    for el in range(max(0, SPAN - len(suffix)), edge + 1):
                        w = xxhash.xxh3_128_digest(text[edge - el : edge - el + SPAN])
                        times[w] = times.get(w, 0) + 1 + more
                        places.setdefault(w, []).append(i << 8 | el)
                yield {"bucket": [bucket] * len(times), "run": [run] * len(times), "w": list(times), "times": list(times.values()), "places": list(places.values())}

        return each

    windows = written(arrow_map(runs.select("bucket", "run", "entries"), "bucket long, run long, w binary, times long, places array<int>", make_windows), "windows")
    twice = written(windows.groupBy("w").agg(F.sum("times").alias("times")).where("times > 1").select("w"), "twice")
    flags = windows.join(twice.hint("merge"), "w", "left_semi").groupBy("bucket", "run").agg(F.flatten(F.collect_list("places")).alias("flags"))
    flags = runs.select("bucket", "run", "n").join(flags.hint("merge"), ["bucket", "run"])

    def make_masks():
        def each(batch):
            masks = []
            for n, at in zip(batch.column(2).to_pylist(), batch.column(3)):
                at, on = at.values.to_numpy(), np.zeros((n, 8 * MASK_BYTES), np.uint8)
                on[at >> 8, at & 255] = 1
                masks.append(np.packbits(on, 1, "little").tobytes())
            yield {"bucket": batch.column(0), "run": batch.column(1), "masks": masks}

        return each

    return arrow_map(flags, "bucket long, run long, masks binary", make_masks)


def spans_of(flags: DataFrame) -> DataFrame:
    """(k, start, end) of repeated strings from (places, masks)."""

    def make():
        def each(batch):
            ks, starts, ends = [], [], []
            for places, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = int.from_bytes(places[:4], "little")
                sizes = np.frombuffer(places, "<i4", n, 4).tolist()
                at = np.frombuffer(places, "<i8", -1, 4 + 4 * n).reshape(-1, 2)
                done = 0
                for i, size in enumerate(sizes):
                    mask, low = int.from_bytes(masks[i * MASK_BYTES : (i + 1) * MASK_BYTES], "little"), 0
                    while mask:
                        skip = (mask & -mask).bit_length() - 1
                        mask >>= skip
                        low += skip
                        n_set = (~mask & (mask + 1)).bit_length() - 1
                        for k, a in at[done : done + size].tolist():
                            ks.append(k)
                            starts.append(a - (low + n_set - 1))
                            ends.append(a - low + SPAN)
                        mask >>= n_set
                        low += n_set
                    done += size
            yield {"k": ks, "start": starts, "end": ends}

        return each

    return arrow_map(flags, "k long, start long, end long", make)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        if s > end:
            runs += 1
            kept.append(text[at:s])
            removed += e - s
            end = e
        elif e > end:
            removed += e - end
            end = e
        at = max(at, end)
    return b"".join([*kept, text[at:]]), removed, runs


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, k, text); (doc_id, k, n_bytes, sha); and (k, copies). Unlike texts have unlike k."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, second = text_keys(text)
    for turn in range(8):
        keyed = docs.select(F.col(id_col).alias("doc_id"), key.cast("long").alias("k"), text.alias("text"))
        size = F.octet_length("text").cast("long").alias("n_bytes")
        digest = docs.select(F.col(id_col).alias("doc_id"), key.cast("long").alias("k"), second.alias("k2"), text.alias("text"))
        digest = written(digest.select("doc_id", "k", "k2", size, F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digest")
        texts = written(digest.groupBy("k").agg(F.count("*").alias("copies"), F.min("k2").alias("x"), F.max("k2").alias("y")), "texts")
        alike = [r.k for r in texts.where("x <> y").select("k").limit(MOST_ALIKE).collect()]  # about n ** 2 / 2 ** 65 of n texts
        if not alike:
            return keyed, digest.drop("k2"), texts.select("k", "copies")
        key = F.when(key.isin(alike), F.xxhash64(F.lit(turn), text)).otherwise(key)
    raise ValueError("texts could not be keyed apart")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 for each document; with ``keep_text`` also ``kept``, the bytes left."""
    keyed, digest, copies = keyed_texts(docs, id_col, text_col)
    grams = written(gram_table(keyed), "grams")
    again = grams.groupBy("h").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.max("c").alias("c")).where("k0 <> k1 or c > 1").select("h")
    hits = grams.join(again.hint("merge"), "h").groupBy("k").agg(F.collect_set("h").alias("hs"))
    hits = written(hits, "hits")
    total = hits.agg(F.sum(F.size("hs"))).first()[0] or 0
    hit = written(keyed.select("k", "text").join(hits.hint("merge"), "k").select("k", "text", "hs"), "hit-texts")
    runs = written(runs_table(hit, max(8, total // BUCKET_ROWS)), "runs")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf.bucket, "run": pdf.run, "masks": merge_bucket(pdf.entries.tolist())})

    sized = runs.groupBy("bucket").agg(F.sum("n").alias("size"))
    hot = written(sized.where(F.col("size") > hot_entries).select("bucket"), "hot-buckets")
    entries = runs.select("bucket", "run", "n", "entries")
    masks = entries.join(hot.hint("merge"), "bucket", "left_anti").groupBy("bucket").applyInPandas(merge, "bucket long, run long, masks binary")
    if not hot.isEmpty():
        masks = masks.unionAll(window_masks(entries.join(hot.hint("merge"), "bucket", "left_semi")))
    spans = spans_of(runs.select("bucket", "run", "places").join(masks.hint("merge"), ["bucket", "run"]).select("places", "masks"))
    spans = written(spans.groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")

    def make():
        def each(batch):
            out = [cut(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist())]
            yield {"k": batch.column(0), "removed": [x[1] for x in out], "runs": [x[2] for x in out], "left_sha": [hashlib.sha256(x[0]).hexdigest() for x in out], "left": [x[0] for x in out] if keep_text else [None] * len(out)}

        return each

    changed = arrow_map(hit.select("k", "text").join(spans.hint("merge"), "k").select("k", "text", "spans"), "k long, removed long, runs long, left_sha string, left binary", make)
    # one row for each text, written: Spark then splits the other side where many copies share a key
    changed = written(changed.groupBy("k").agg(F.first("removed").alias("removed"), F.first("runs").alias("runs"), F.first("left_sha").alias("left_sha"), *([F.first("left").alias("left")] * keep_text)), "changed")
    known = written(copies.where("copies > 1").join(changed.hint("merge"), "k", "full"), "known")
    out = digest.join(known.hint("merge"), "k", "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= SPAN)
    pick = lambda all_gone, some, none: F.when(whole, all_gone).otherwise(F.coalesce(some, none))
    result = [
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"), pick(F.sha2(F.lit(b""), 256), F.col("left_sha"), F.col("sha")).alias("kept_sha256"),
    ]
    if keep_text:
        firsts = keyed.groupBy("k").agg(F.first("text").cast("binary").alias("text"))
        out = out.join(firsts.hint("merge"), "k")
        result.append(pick(F.lit(b""), F.col("left"), F.col("text")).alias("kept"))
    return out.select(*result)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
