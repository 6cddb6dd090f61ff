"""Scans of label tables, folders and annotation arrays; versioned registry writes."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

# Accepted image suffixes.
IMAGE_SUFFIX = r"\.(png|jpg|jpeg|bmp|tif|tiff|webp)$"

_OWN: set[str] = set()


@dataclass(frozen=True)
class CorpusSchema:
    """Roles of a label table's columns; ``normal_label`` and ``anomaly_label`` are the two values of its label."""

    image: str
    label: str
    mask: str | None = None
    defect: str | None = None
    category: str | None = None
    normal_label: int = 0
    anomaly_label: int = 1


def scan_labels(df: DataFrame, schema: CorpusSchema, category: str | None = None, key: str = "row_id") -> DataFrame:
    """Key, normal/anomalous flags and defect type only; payload columns are never read."""
    if category is not None and schema.category:
        df = df.where(F.col(schema.category) == category)
    defect = F.coalesce(F.col(schema.defect), F.lit("")) if schema.defect else F.lit("")
    return df.select(key, (F.col(schema.label) == schema.normal_label).alias("normal"), (F.col(schema.label) == schema.anomaly_label).alias("anomalous"), defect.alias("defect"))


def materialise(selected: DataFrame, payload: DataFrame, key: str = "row_id") -> DataFrame:
    """Payload of chosen rows only; the requested order stays in its column."""
    return selected.join(payload, key)


def split_files(spark: SparkSession, root: str, split: str, pattern: str = "{split}-*.parquet") -> DataFrame:
    """One split's files, or folders of part files, directly below ``root``; without any there, its files in folders of partitions."""
    name = pattern.format(split=split)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if found:
        return spark.read.parquet(*(s.getPath().toString() for s in found))
    return spark.read.option("pathGlobFilter", name).parquet(root)


def scan_paths(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths and sizes below a folder, without contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def folder_layout(paths: DataFrame) -> DataFrame:
    """split, defect type, stem and mask flag from paths like .../train/good/001.png and .../ground_truth/crack/001_mask.png."""
    part = lambda i: F.element_at(F.split("path", "/"), i)
    stem = F.regexp_replace(part(-1), r"\.[^.]*$", "")
    return paths.where(F.lower("path").rlike(IMAGE_SUFFIX)).select("path", part(-3).alias("split"), part(-2).alias("defect"), F.regexp_replace(stem, "_mask$", "").alias("stem"), (part(-3) == "ground_truth").alias("is_mask"))


def pair_masks(rows: DataFrame) -> DataFrame:
    masks = rows.where("is_mask").select("defect", "stem", F.col("path").alias("mask_path"))
    return rows.where("not is_mask").join(masks, ["defect", "stem"], "left")


def scan_capture_dir(paths: DataFrame, held_out: DataFrame | list[str]) -> DataFrame:
    """Accepted files with their names and split. Withheld names are a list or a table with a column ``name``."""
    if isinstance(held_out, list):
        names = F.broadcast(paths.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(held_out)], "name string"))
    else:
        names = held_out.select("name").distinct().hint("merge")
    files = paths.where(F.lower("path").rlike(IMAGE_SUFFIX)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    split = F.when(F.col("held").isNotNull(), "held_out").otherwise("train_good")
    return files.join(names.withColumn("held", F.lit(True)), "name", "left").select("path", "name", split.alias("split"))


def flat_boxes(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Parallel arrays of boxes and label numbers as rows."""
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    each = df.where(F.size("bboxes") == F.size("labels")).select("frame_id", F.explode(F.arrays_zip("bboxes", "labels")).alias("z"))
    return each.select("frame_id", label[F.col("z.labels")].alias("label"), *(F.get("z.bboxes", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def upsert(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Replace whole rows by key, else add. The result goes to a new version, never over what is read."""
    return existing.join(new.select(*key), [*key], "left_anti").unionByName(new)


def insert_suffixed(existing: DataFrame, new: DataFrame, suffix: str, key: str = "name") -> DataFrame:
    """New rows, their name suffixed where it exists already."""
    taken = existing.select(key).distinct().withColumn("taken", F.lit(True))
    return new.join(taken, key, "left").withColumn(key, F.when(F.col("taken"), F.concat(key, F.lit("-" + suffix))).otherwise(F.col(key))).drop("taken")


def update_fields(existing: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of known rows replaced where a new value is given."""
    renamed = new.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    out = existing.join(renamed, key, "left")
    return out.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*(f"new_{f}" for f in fields))


def superseded(existing: DataFrame, new: DataFrame, key: str, artifact: str) -> DataFrame:
    return existing.join(new.select(key, F.col(artifact).alias("kept_artifact")), key).where(~F.col(artifact).eqNullSafe(F.col("kept_artifact"))).select(key, artifact)


def backfill_embeddings(findings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fill missing embeddings where an image id exists; what finds no vector stays missing."""
    out = findings.join(vectors, "image_id", "left")
    return out.withColumn("embedding", F.when(C.searchable("embedding"), F.col("embedding")).otherwise(F.col("vec"))).drop("vec")


def shifted(findings: DataFrame, days: int) -> DataFrame:
    """Backfilled findings moved back by a stable number of days; observed_at keeps the true time."""
    back = F.conv(F.substring(C.stable_order("finding_id"), 1, 2), 16, 10).cast("int") % days
    return findings.withColumn("observed_at", F.col("ts")).withColumn("ts", F.when(F.col("backfilled"), F.col("ts") - F.make_dt_interval(days=back)).otherwise(F.col("ts")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; only a local session without it gets a temporary one. It is deleted when the driver's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    own = f"{at.rstrip('/')}/work-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new scratch folder and read back: lineage is cut and later plans know their real size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_findings(df: DataFrame, path: str) -> None:
    """Append, one folder for each day. A day's rows are gathered first, so tasks do not each write a file for every day; large days are split."""
    df.withColumn("day", C.utc_day("ts")).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table version; readers switch to the new folder when it is whole."""
    path = f"{root.rstrip('/')}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path
