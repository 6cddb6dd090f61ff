"""A training corpus from raw documents, stage by stage.

Documents that the classifier rejects go; one document of each near-duplicate group stays; documents that hold benchmark
passages go; secrets are replaced by a mark; what is left is packed into token sequences.

Every stage takes rows as they come: null ids, texts, languages and sources, empty and very long texts, equal ids with
unlike texts and repeated rows. Decisions belong to rows, never to ids alone, so no unique text is lost with another one's
id. Of repeated rows and of rows whose texts are near-duplicates one stays: that with the least id, null ids last, the
first such row among equals. Empty texts are near-duplicates of nothing. An empty table gives an empty result. Further
columns, whatever their names, are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectory.llm import classifier, decontaminate, near_duplicates, packing, secrets
from inspectory.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: An item of fewer words than this says nothing about a document that holds it.
TELLING_WORDS = 5
#: Texts whose keys (16 bytes each) are broadcast; more are merge-joined.
FEW_TEXTS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the factorisation machine, fitted on this input's labelled rows, accepts."""
    docs = docs.select(*COLUMNS)
    machine = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.scored(docs, machine, keep=True).where(F.col("quality_score") >= classifier.THRESHOLD).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group (five-word shingles, similarity 0.8)."""
    return near_duplicates.near_duplicates(docs, width=5, carry=("lang", "source", "n_chars")).where("stays").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text overlaps a benchmark item."""
    keys = lambda df: df.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    numbered = docs.select(F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).alias("key"), "text")
    found = decontaminate.matches(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").where(F.col("n_words") >= TELLING_WORDS)
    found = written(found.select("doc_id.h1", "doc_id.h2").distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= FEW_TEXTS else found.hint("merge")
    return keys(docs).join(found, ["h1", "h2"], "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows where the text is not null."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4,096 tokens."""
    return packing.pack(packing.pieces(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicate), ("decontamination", decontamination), ("secret scan", secret_scan), ("packing", pack)]

#: SQL can't express the classifier or the LSH forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
