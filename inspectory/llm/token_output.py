"""Token-id output: best-fit-decreasing packing with a segment tree over free capacities.

Each task tokenises its own documents, cuts overlong ones into pieces of full capacity and a rest, and packs blocks of a
bounded number of tokens, longest piece first, into the sequence with the least room that suffices. A row of the result
is one sequence: its padded ids as a row of a uint16 matrix, cumulative segment lengths, and where positions restart.
Nothing is shuffled, so a lost task is simply run again and gives the same rows.

``write_shards`` also writes each block as raw binary files for memory-mapped reading: the id matrix (uint16), the
cumulative lengths and the resets of all rows (int32, each row's numbers after their count), and their sizes and
checksums as JSON. Files get their name when whole, and a task that runs again writes the same bytes.

A null text is empty and gives its end id only; an empty table gives no rows and no files; repeated rows and equal or null
ids are packed one by one, pieces of equal length in the order of the rows; very long texts are cut, never shortened.
Further columns of any name are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, small_batches, written
from .tokens import ByteEncoder

CAPACITY, BLOCK = 2048, 4_000_000


class CapacityTree:
    """How many open sequences have each free capacity; finds the least capacity that suffices in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, need: int) -> int | None:
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces of each sequence, in the order in which they were placed."""
    tree, open_at, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.least(lengths[i])
        if free is None:
            free, b = capacity, len(bins)
            bins.append([])
        else:
            b = open_at[free].pop()
            tree.add(free, -1)
        bins[b].append(i)
        open_at[free - lengths[i]].append(b)
        tree.add(free - lengths[i], 1)
    return bins


def counted(rows: list[list[int]]) -> bytes:
    """Rows of numbers, each after its length, as int32."""
    return np.array([x for r in rows for x in (len(r), *r)], "<i4").tobytes()


def uncounted(raw: bytes) -> list[np.ndarray]:
    x, at, out = np.frombuffer(raw, "<i4"), 0, []
    while at < len(x):
        out.append(x[at + 1 : at + 1 + x[at]])
        at += 1 + int(x[at])
    return out


def put_shard(folder: str, block: int, capacity: int, out: dict[str, list]) -> None:
    """Write one block's files; the JSON comes last, so a shard that has it is whole."""
    os.makedirs(folder, exist_ok=True)
    files = {"ids.bin": b"".join(out["ids"]), "cu_seqlens.bin": counted(out["cu_seqlens"]), "position_resets.bin": counted(out["position_resets"])}
    about = {"capacity": capacity, "rows": len(out["ids"]), "dtype": "uint16", "files": {n: [len(x), zlib.crc32(x)] for n, x in files.items()}}
    for name, x in (*files.items(), ("json", json.dumps(about).encode())):
        own = f"{folder}/.{block:012d}.{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(x)
        os.replace(own, f"{folder}/{block:012d}.{name}")


def read_shard(folder: str, block: int, check: bool = True) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A shard's id matrix (memory-mapped), and each row's cumulative lengths and position resets."""
    with open(f"{folder}/{block:012d}.json", "rb") as f:
        about = json.load(f)
    raw = {}
    for name, (size, crc) in about["files"].items():
        at = f"{folder}/{block:012d}.{name}"
        if os.path.getsize(at) != size:
            raise ValueError(f"{at} has other bytes than its shard says")
        raw[name] = np.memmap(at, np.uint8, "r")
        if check and zlib.crc32(raw[name]) != crc:
            raise ValueError(f"{at} has other bytes than its shard says")
    ids = raw["ids.bin"].view("<u2").reshape(about["rows"], about["capacity"])
    return ids, uncounted(raw["cu_seqlens.bin"].tobytes()), uncounted(raw["position_resets.bin"].tobytes())


def write_shards(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Write all shards below a folder that driver and executors mount; returns the rows without ids: which documents stand where."""
    return written(sequences(docs, folder=folder, **options).drop("ids"), "shard-index")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, pad: int = ByteEncoder.END, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Rows of packed sequences; with ``folder`` each block is written there too."""
    kind = dict(docs.dtypes)[id_col]

    def packed(held, number):
        out = {c: [] for c in ("block", "row", "doc_ids", "starts", "cu_seqlens", "position_resets", "n_tokens", "ids", "ids_crc32")}
        for row, members in enumerate(best_fit([len(ids) // 2 for _, _, ids in held], capacity)):
            ends = np.cumsum([0, *(len(held[i][2]) // 2 for i in members)]).tolist()
            ids = b"".join(held[i][2] for i in members) + pad.to_bytes(2, "little") * (capacity - ends[-1])
            for c, v in zip(out, (number, row, [held[i][0] for i in members], [held[i][1] for i in members], ends, ends[:-1], ends[-1], ids, zlib.crc32(ids))):
                out[c].append(v)
        if folder:
            put_shard(folder, number, capacity, out)
        return out

    def run(batches):
        import pyarrow as pa

        encoder, end, task = ByteEncoder(vocabulary), ByteEncoder.END.to_bytes(2, "little"), TaskContext.get().partitionId()
        held, size, n = [], 0, 0
        for batch in parts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.ids(text.as_py() or "") + end
                for at in range(0, len(raw) // 2, capacity):
                    held.append((doc, at, raw[2 * at : 2 * (at + capacity)]))
                size += len(raw) // 2
                if size >= block:
                    yield pa.RecordBatch.from_pydict(packed(held, task * 1_000_000 + n), schema=fields)
                    held, size, n = [], 0, n + 1
        if held:
            yield pa.RecordBatch.from_pydict(packed(held, task * 1_000_000 + n), schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"block long, row long, doc_ids array<{kind}>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary, ids_crc32 long"
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return small_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
