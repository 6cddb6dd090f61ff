"""Cross-tokenizer alignment by lockstep vectorised merging.

A is a byte-level BPE over a space and the text, B a piece BPE over the text (it adds that space itself). Where tokens of
both end at the same byte, the text is cut; the tokens between two cuts are a group, and each A token of a group is linked
with each B token of it.

The documents of a batch are dealt into lanes: stretches of about LANE tokens that start and end where both tokenizers
must end a token (before a single space between two other characters). One NumPy state vector holds all lanes' pointers;
each step advances, in every lane at once, the pointer whose token ends first (or both), emits the cuts and links of the
lanes where both end, and drops the lanes that are done.

The number of documents that hold an id pair linked is counted over the whole corpus, and each document's links are looked
up in these counts.

Null and empty texts, and texts whose tokens do not give their bytes back (those with U+2581), have no tokens: zeros and
an empty digest; so they hold no pair. Very long texts are aligned whole. Repeated rows, and rows with equal or null ids,
are documents of their own. All ties count. An empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

LANE = 192
#: An id pair is one number: A's id times this, plus B's id. Both vocabularies have fewer than 65,536 ids.
B_IDS = 32_768
#: Groups of more links than this are counted by distinct ids.
LARGE_GROUP = 4096
#: Characters of the texts that are aligned at once, at most (or one text).
BATCH_CHARS = 4_000_000
#: Chunks that are kept between batches, and A tokens of them, at most.
LIMIT, MOST_KEPT = 1_200_000, 16_000_000
#: Id pairs (16 bytes each) that are broadcast; more are merge-joined.
FEW_PAIRS = 1_000_000

#: Decimal ids as up to five characters of a number (the first one lowest), and how many they are.
DECIMALS = np.array([int.from_bytes(str(i).encode(), "little") for i in range(65_536)], np.uint64)
DIGITS = np.array([len(str(i)) for i in range(65_536)], np.uint64)

#: A single space between two other characters.
CHUNK_END = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Both tokenizers over chunks. Chunks seen lately are kept: their ids lie one after the other in flat arrays.

    A is read from its ranks; its ids are those of ``byte_bpe_50k.json``."""

    own: dict[tuple, Pair] = {}

    def __init__(self, a_path: str | None, b_path: str | None) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.a_bytes = sorted(ranks, key=ranks.get)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.size = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.forget()

    @classmethod
    def of_worker(cls, a_path: str | None, b_path: str | None) -> Pair:
        """One for each Python worker: later tasks find the chunks of earlier ones."""
        key = (a_path, b_path)
        if key not in cls.own:
            cls.own[key] = cls(*key)
        return cls.own[key]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = [np.empty(0, np.uint16), np.empty(0, np.uint16)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.fits = np.empty(0, bool)

    def encoded(self, chunks: list[str]) -> None:
        """Keep chunks that no tokenizer joins when single spaces part them."""
        text = " ".join(chunks)
        whole = (" " + text).encode()
        ids = [np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text), np.int64)]
        fits = self.size[0][ids[0]].sum() == len(whole) and b"".join([self.b_bytes[i] for i in ids[1].tolist()]) == whole  # A's tokens are bytes of the text by construction
        if not fits and len(chunks) > 1:
            for c in chunks:
                self.encoded([c])
            return
        stop = np.cumsum([len(c.encode()) + 1 for c in chunks])
        for k in (0, 1):
            ends = np.searchsorted(np.cumsum(self.size[k][ids[k]]), stop) + 1 if fits else np.zeros(1, np.int64)
            self.ends[k] = np.append(self.ends[k], self.ends[k][-1] + ends)
            self.ids[k] = np.append(self.ids[k], (ids[k] if fits else ids[k][:0]).astype(np.uint16))
        self.number.update(zip(chunks, range(len(self.fits), len(self.fits) + len(chunks))))
        self.fits = np.append(self.fits, np.full(len(chunks), fits))

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts: each chunk's number, and its text's."""
        if len(self.number) > LIMIT or len(self.ids[0]) > MOST_KEPT:
            self.forget()
        found = [text.split(" ") if text else [] for text in texts]
        number = list(map(self.number.get, chain.from_iterable(found)))
        new = {c for c, i in zip(chain.from_iterable(found), number) if i is None}
        if odd := {c for c in new if c.strip() != c or not c}:  # blanks at an end: only single spaces part such texts
            found = [x if odd.isdisjoint(x) else CHUNK_END.split(text) for x, text in zip(found, texts)]
            new = set(chain.from_iterable(found)).difference(self.number)
        if plain := sorted(c for c in new if c.strip() == c):
            self.encoded(plain)
        for c in new.difference(plain):
            self.encoded([c])
        if odd:
            number = map(self.number.__getitem__, chain.from_iterable(found))
        elif new:
            late = self.number
            number = [late[c] if i is None else i for c, i in zip(chain.from_iterable(found), number)]
        sizes = [len(x) for x in found]
        number, doc = np.fromiter(number, np.int64, sum(sizes)), np.repeat(np.arange(len(texts)), sizes)
        good = np.bincount(doc, ~self.fits[number], len(texts)) == 0
        return number[good[doc]], doc[good[doc]]


def expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, n of them."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def merged(a_end: np.ndarray, b_end: np.ndarray, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The groups that each step closes: first A token and their number, first B token and their number.

    a_end, b_end: where tokens end, over all texts; lanes: rows of (first A token, one past the last, first B token)."""
    i, stop, j = (np.ascontiguousarray(c) for c in lanes[lanes[:, 0] < lanes[:, 1]].T)
    gi, gj = i.copy(), j.copy()
    while len(i):
        a, b = a_end[i], b_end[j]
        i, j = i + (a <= b), j + (b <= a)
        cut = np.flatnonzero(a == b)
        if len(cut):
            yield gi[cut], i[cut] - gi[cut], gj[cut], j[cut] - gj[cut]
            gi[cut], gj[cut] = i[cut], j[cut]
            live = i < stop
            if not live.all():
                i, stop, j, gi, gj = i[live], stop[live], j[live], gi[live], gj[live]


def links(a: np.ndarray, b: np.ndarray, group: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first A token of the link's group, id pair, links that it stands for; None: one) of groups."""
    gi, na, gj, nb = group
    n = na * nb
    if n.max() == 1:
        yield gi, a[gi] * B_IDS + b[gj], None
        return
    for k in np.flatnonzero(n > LARGE_GROUP):
        (x, cx), (y, cy) = (np.unique(ids[g : g + m], return_counts=True) for ids, g, m in ((a, gi[k], na[k]), (b, gj[k], nb[k])))
        yield np.full(len(x) * len(y), gi[k]), (x[:, None] * B_IDS + y).ravel(), (cx[:, None] * cy).ravel()
    some = np.flatnonzero(n <= LARGE_GROUP)
    gi, gj, nb, n = gi[some], gj[some], nb[some], n[some]
    at, place = np.repeat(np.arange(len(n)), n), expanded(np.zeros(len(n), np.int64), n)
    yield gi[at], a[gi[at] + place // nb[at]] * B_IDS + b[gj[at] + place % nb[at]], None


def shown(a: np.ndarray, b: np.ndarray, gi: np.ndarray, na: np.ndarray, gj: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups, in order, as ``a1,a2|b1;a3|b2,b3;`` in bytes; where each group's part ends."""
    ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint64)
    ids[np.arange(len(a)) + np.repeat(gj, na)] = a
    ids[np.arange(len(b)) + np.repeat(gi + na, nb)] = b
    sep[gi + na - 1 + gj], sep[gi + na + gj + nb - 1] = ord("|"), ord(";")
    size = DIGITS[ids]
    chars = DECIMALS[ids] | sep << (size << np.uint64(3))
    return np.frombuffer(chars.astype("<u8").tobytes().translate(None, b"\0"), np.uint8), np.cumsum(size + np.uint64(1))[gi + na + gj + nb - 1].astype(np.int64)


def aligned_batch(texts: list[str], pair: Pair) -> Iterator[dict]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256, groups (A and B tokens of each group) and the distinct pairs (id pair * 2**32 + links)."""
    number, doc = pair.chunks(texts)
    a_n, b_n = (np.diff(x)[number] for x in pair.ends)
    a, b = (ids[expanded(ends[number], n)].astype(np.int64) for ids, ends, n in zip(pair.ids, pair.ends, (a_n, b_n)))
    a_end, b_end = np.cumsum(pair.size[0][a]), np.cumsum(pair.size[1][b])
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    n_a, n_b = (np.bincount(doc, n, len(texts)).astype(np.int64) for n in (a_n, b_n))
    doc_a = np.cumsum(n_a) - n_a
    part = (a_at - doc_a[doc]) // (LANE // 2)
    start = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    steps, own = [], []
    for group in merged(a_end, b_end, np.stack([a_at[start], np.append(a_at[start], len(a))[1:], b_at[start]], 1)):
        steps.append(group)
        own += links(a, b, group)
    groups = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*steps)] if steps else [np.empty(0, np.int64)] * 4
    place = np.full(len(a), -1)
    place[groups[0]] = np.arange(len(groups[0]))
    gi, na, gj, nb = (x[place[place >= 0]] for x in groups)  # in order of the first A token
    group_doc = np.searchsorted(doc_a + n_a, gi, "right")
    n_groups = np.bincount(group_doc, minlength=len(texts))
    n_links = np.bincount(group_doc, na * nb, len(texts)).astype(np.int64)
    text, end = shown(a, b, gi, na, gj, nb)
    text, last, began = text.tobytes(), np.append(0, end)[np.cumsum(n_groups)], np.append(0, end)[np.cumsum(n_groups) - n_groups]
    digest = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(began.tolist(), last.tolist())]
    none = np.empty(0, np.int64)
    at = np.concatenate([none, *(x[0] for x in own)])
    key = np.searchsorted(doc_a + n_a, at, "right") << 32 | np.concatenate([none, *(x[1] for x in own)])
    if all(x[2] is None for x in own):
        key, count = np.unique(key, return_counts=True)
    else:
        count = np.concatenate([np.ones(len(x[0]), np.int64) if x[2] is None else x[2] for x in own])
        key, to = np.unique(key, return_inverse=True)
        count = np.bincount(to, count, len(key)).astype(np.int64)
    pairs, per = (key & 0xFFFFFFFF) << 32 | count, np.bincount(key >> 32, minlength=len(texts))
    listed = lambda values, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values))
    shape = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), pa.int32()), pa.StructArray.from_arrays([pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32))], ["a", "b"]))
    yield {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest, "groups": shape, "pairs": listed(pairs, per)}


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs; ``keep`` adds groups: the number of A and B tokens of each."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        pair = Pair.of_worker(a_path, b_path)

        def each(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                size, n = 0, at
                while n < len(texts) and (n == at or size + len(texts[n]) <= BATCH_CHARS):
                    size, n = size + len(texts[n]), n + 1
                for out in aligned_batch(texts[at:n], pair):
                    if not keep:
                        del out["groups"]
                    yield {"doc_id": batch.column(0).slice(at, n - at)} | out
                at = n

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + "groups array<struct<a: int, b: int>>, " * keep + "pairs array<long>", make)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold an id pair linked, and whether no other pair of its A id has more."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy(F.shiftright("pair", 32).cast("int").alias("pair")).agg(F.count("*").alias("n"))
    n = written(n, "pair-counts")
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / B_IDS))))  # at most B_IDS rows an A id


def weighed(aligned: DataFrame) -> DataFrame:
    """Aligned documents with n_best and count_sum over their links."""
    rows = aligned.withColumn("row", F.monotonically_increasing_id())
    counts = written(pair_counts(aligned), "counts")
    counts = F.broadcast(counts) if counts.count() <= FEW_PAIRS else counts.hint("merge")
    held = rows.select("row", F.explode("pairs").alias("p")).select("row", F.shiftright("p", 32).cast("int").alias("pair"), F.col("p").bitwiseAND(0xFFFFFFFF).alias("links"))
    sums = held.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs").join(written(sums, "sums").hint("merge"), "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = written(align(spark.read.parquet(f"{sf_dir}/documents.parquet")), "aligned")
    return weighed(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
