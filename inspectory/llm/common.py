"""What the training-data operators share: scratch tables, Arrow maps and word splitting.

Words here are runs of anything but the six ASCII blanks; A-Z are lower-cased and nothing else is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_OWN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own in ``spark.checkpoint.dir``, which the driver and all executors share; it is deleted when the driver's JVM ends. Where that setting is unset and Spark runs in one local process, a temporary folder takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    own = f"{at.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWN.add(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage is cut and later plans know their real size."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """Map Arrow batches. ``make`` runs once in each task and returns what turns a batch into dicts of columns."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = make()
        for batch in parts(batches):
            for out in each(batch):
                yield pa.RecordBatch.from_pydict(out, schema=fields)

    return small_batches(df).mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of rows, so what a slice becomes in Python stays small beside the batch; freed memory goes back between batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def small_batches(df: DataFrame) -> DataFrame:
    """Whole texts are long: unless the session sets its own number, 1,000 rows make an Arrow batch."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes."""
    return text.translate(LOWER).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of a multiply-shift hash)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(found: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if not found:
        return np.empty(0, np.uint64)
    h, n = word_hashes(found), min(width, len(found))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return np.unique(out)
