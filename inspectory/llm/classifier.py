"""Quality classifier: a factorisation machine over hashed words, structure statistics and text-derived metadata.

Inputs are the distinct lower-cased words (hashed), levels of structure statistics (letter case, punctuation, symbols,
digits, word lengths, repetition, lines) and metadata that the text itself shows (length class, share of non-ASCII
bytes). Pairwise interactions are low-rank, so the sum over all pairs costs time linear in the number of inputs: half of
(sum squared minus sum of squares), for each factor. Labels, language, source and id are never inputs.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows (a documented bound, chosen by hash of the id), never
on held-out ones; scoring is distributed. Of the texts of one id, one is learnt from (the least by hash), chosen before
anything reaches the driver.

A null text is empty and has a score like any other; rows with a null id are scored but never learnt from. Very long
texts are read whole. Repeated rows have equal scores. Without labels the score is the same for all; an empty table gives
no rows. A further column named like the added score is replaced, others are ignored or kept as they are.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, utf8

BITS, RANK, SAMPLE, EPOCHS, LEVELS, THRESHOLD = 15, 6, 6000, 6, 12, 0.3
N_STATS = 14
SIZE = (1 << BITS) + N_STATS * (LEVELS + 1)

_KIND = np.full(256, 7, np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence marks, 5 symbols, 6 other ASCII, 7 beyond ASCII
_KIND[:128] = 6
for _k, _chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b".,!?;:"), (5, b"#*$%&|<>")):
    _KIND[list(_chars)] = _k


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's inputs."""
    found = text.translate(LOWER).split()
    distinct = set(found)
    ids = np.unique(np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) & ((1 << BITS) - 1))
    n, size = max(len(found), 1), max(len(text), 1)
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8) if text else np.zeros(8)
    lines = text.split(b"\n")
    again = sum(map(operator.eq, found, found[1:]))
    shares = (kinds[1] / size, kinds[2] / size, kinds[4] / n, kinds[5] / n, again / n, text.count(b"|") / n, text.count(b"!!") / n, 1 - len({*lines}) / len(lines))
    sizes = (kinds[7] / size * 3, kinds[3] / size * 2, (size - kinds[3]) / n / 20, 1 - len(distinct) / n, len(lines) / n * 4, np.log2(n + 1) / 16)
    level = np.concatenate([[0 if x <= 0 else min(max(int(np.log2(x * 2048)), 0), LEVELS - 1) + 1 for x in shares], np.minimum(np.asarray(sizes) * LEVELS, LEVELS)]).astype(np.int64)
    own = (1 << BITS) + np.arange(N_STATS) * (LEVELS + 1) + level
    return np.concatenate([ids, own]), np.concatenate([np.full(len(ids), 1 / np.sqrt(max(len(ids), 1))), np.full(N_STATS, 0.5)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[ids] * x[:, None]
        z = self.bias + self.linear[ids] @ x + 0.5 * float(((vx.sum(0)) ** 2 - (vx**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by minibatches with per-weight adaptive rates."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    g_lin, g_fac, g_bias = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 64)) if len(order) else []:
            ids, x = (np.concatenate([rows[i][j] for i in part]) for j in (0, 1))
            own = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            vx = m.factors[ids] * x[:, None]
            at = np.searchsorted(own, np.arange(len(part)))
            sums = np.add.reduceat(vx, at, axis=0)
            z = m.bias + np.add.reduceat(m.linear[ids] * x, at) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at, axis=0)).sum(1)
            off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            each = off[own] * x / len(part)
            used, back = np.unique(ids, return_inverse=True)
            d_lin = np.bincount(back, each, len(used)) + decay * m.linear[used]
            d_fac = np.stack([np.bincount(back, each * (sums[own, f] - vx[:, f]), len(used)) for f in range(rank)], 1) + decay * m.factors[used]
            g_lin[used] += d_lin**2
            g_fac[used] += d_fac**2
            g_bias += off.mean() ** 2
            m.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
            m.factors[used] -= rate / 2 * d_fac / np.sqrt(g_fac[used])
            m.bias -= rate * off.mean() / np.sqrt(g_bias)
    return Machine(m.bias, m.linear.astype(np.float32), m.factors.astype(np.float32))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows whose fold is not 0, ``sample`` at most."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are sent
    texts = texts.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("label", "text")

    def make():
        def each(batch):
            got = [features(t or b"") for t in utf8(batch.column(1))]
            yield {"label": batch.column(0), "ids": [i.astype("<i4").tobytes() for i, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got]}

        return each

    got = arrow_map(texts, "label double, ids binary, x binary", make).collect()  # at most `sample` rows
    got.sort(key=lambda r: (r.label, bytes(r.ids)))
    return fit([(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float)) for r in got], np.array([r.label for r in got]))


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "quality_score") -> DataFrame:
    """doc_id and score; with ``keep`` all columns and the score as ``name``."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size, about 1 MB
    if keep:
        df = docs.drop(name)
        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{name}` double"
    else:
        df, schema, name = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), f"doc_id {dict(docs.dtypes)[id_col]}, score double", "score"

    def make():
        def each(batch):
            cols = dict(zip(batch.schema.names, batch.columns))
            score = [model.value.score(*features(t or b"")) for t in utf8(cols[text_col])]
            yield (cols if keep else {"doc_id": cols["doc_id"]}) | {name: score}

        return each

    return arrow_map(df, schema, make)


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    df = scored(docs, train(docs, labels))
    return df.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
