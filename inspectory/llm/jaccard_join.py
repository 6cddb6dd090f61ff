"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is by the number of sets that hold one, then by hash. It is cut into fragments at powers of
two of that number, and each set into a segment for each fragment. Partial overlaps of two sets are counted fragment by
fragment, in rows of their own, and summed per pair.

Which pairs are counted: two sets of this similarity differ in few n-grams, so (1) a set that holds more n-grams of its
own alone than that is linked with nothing (a first fragment, a fifth of the hashes, shows this for most texts), and
(2) two linked sets share one of the first n-grams of both in the global order. The sets with such an n-gram in common
are a region. Neighbours by size in a region are counted first; regions that these links do not join are then compared
whole, crowded ones in blocks over the cluster, where fragments are ranges of the common n-grams. So every link is found.

Equal sets are one class and are linked without pairs. Null and empty texts and texts without words have no n-grams and
are linked with nothing; a text of fewer words than an n-gram is one n-gram. Equal ids with unlike texts are separate
documents that share a name; a null id is linked by its text and is nobody's component. Very long texts are taken whole.
Repeated rows fall into one group. An empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_map, shingles, small_batches, utf8, words, written
from .near_duplicates import closed, least

WIDTH, PERCENT = 4, 85
#: Hashes below this are the first fragment that is looked at; it has to be more than what linked sets need not share.
FIRST = np.uint64(2**64 // 5)
#: Row numbers that are broadcast; more are merge-joined.
FEW_ROWS = 1_000_000
#: Fragments of the global order: n-grams of 2 or 3 sets, of 4 to 7, and so on; the last one is open.
FRAGMENTS = 6
#: Rows of a region that are sorted in one group, on average.
GROUP = 4096


def described(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, n_shingles, set_key (equal for equal sets; null without n-grams) and n_low (n-grams in the first fragment)."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def each(batch):
            sets = [shingles(words(t or b""), width) for t in utf8(batch.column(1))]
            yield {
                "doc_id": batch.column(0), "text": batch.column(1),
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "n_low": [int(np.searchsorted(s, FIRST)) for s in sets],
            }

        return each

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, text string, n_shingles long, set_key binary, n_low long", make)


def few(ids: DataFrame) -> DataFrame:
    """A written table of row numbers as the small side of a join, if it is one."""
    return F.broadcast(ids) if ids.count() <= FEW_ROWS else ids.hint("merge")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(rep, set) of rows (rep, text)."""

    def make():
        def each(batch):
            yield {"rep": batch.column(0), "set": [shingles(words(t or b""), width).tobytes() for t in utf8(batch.column(1))]}

        return each

    return written(arrow_map(texts, "rep long, set binary", make), "sets")


def alone(size: np.ndarray, percent: int) -> np.ndarray:
    """N-grams that a set of this size and a linked one need not share."""
    return size - -(-percent * size // 100)


def shared_counts(texts: DataFrame, width: int) -> DataFrame:
    """Of rows (rep, text): (rep, shared), how many n-grams of the first fragment another row holds too; rows without any are left out.

    What a batch shows to be shared is summed there; one row of each n-gram and batch goes on."""

    def make():
        def each(batch):
            sets = [shingles(words(t or b""), width) for t in utf8(batch.column(1))]
            own = [s[: np.searchsorted(s, FIRST)] for s in sets]
            rep = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            gram, at, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            who, times = np.unique(rep[n[at] > 1], return_counts=True)
            holder = np.empty(len(gram), np.int64)
            holder[at] = rep
            yield {
                "gram": pa.array(np.append(gram.view(np.int64), np.zeros(len(who), np.int64)), mask=np.arange(len(gram) + len(who)) >= len(gram)),
                "rep": pa.array(np.append(holder, who), mask=np.append(n > 1, np.zeros(len(who), bool))),
                "shared": pa.array(np.append(np.zeros(len(gram), np.int64), times), mask=np.arange(len(gram) + len(who)) < len(gram)),
            }

        return each

    fields = to_arrow_schema(StructType.fromDDL("rep long, shared long"))

    def run(batches):
        """Sums of batches first, then n-grams in order: rows next to an equal one. The last row waits for the next batch."""
        gram, rep, known = np.empty(0, np.int64), pa.array([], pa.int64()), False
        for batch in batches:
            sums = batch.filter(batch.column(0).is_null())
            yield pa.RecordBatch.from_arrays([sums.column(1), sums.column(2)], schema=fields)
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            gram, rep = np.append(gram, batch.column(0).to_numpy()), pa.concat_arrays([rep, batch.column(1)])
            same = gram[1:] == gram[:-1]
            meets = np.append(known, same) | np.append(same, False)
            done = rep.slice(0, len(rep) - 1).filter(pa.array(meets[:-1])).drop_null()
            yield pa.RecordBatch.from_pydict({"rep": done, "shared": np.ones(len(done), np.int64)}, schema=fields)
            gram, rep, known = gram[-1:], rep.slice(len(rep) - 1), bool(meets[-1])
        if known:
            last = rep.drop_null()
            yield pa.RecordBatch.from_pydict({"rep": last, "shared": np.ones(len(last), np.int64)}, schema=fields)

    rows = arrow_map(texts, "gram long, rep long, shared long", make)
    in_order = rows.repartition(F.coalesce("gram", F.xxhash64("rep"))).sortWithinPartitions("gram")
    return small_batches(in_order).mapInArrow(run, "rep long, shared long").groupBy("rep").agg(F.sum("shared").alias("shared"))


def ordered(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (rep, set): members (rep, n, region, sets, last), the shared n-grams among the first of each set in the global order; and
    segments (rep, n, fragment, segment)."""

    def make_grams():
        def each(batch):
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in own])
            yield {"rep": np.repeat(batch.column(0).to_numpy(), n), "n": np.repeat(n, n), "gram": np.concatenate(own)}

        return each

    grams = arrow_map(sets, "rep long, n int, gram long", make_grams)
    held = written(grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1"), "frequencies")
    rows = grams.join(held.hint("merge"), "gram").groupBy("rep", "n").agg(F.collect_list(F.struct("sets", "gram")).alias("grams"))

    def make():
        def each(batch):
            out = {c: [] for c in ("rep", "n", "region", "sets", "last", "fragment", "segment")}
            for rep, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held, gram = (own.values.field(k).to_numpy() for k in (0, 1))
                order = np.lexsort((gram, held))
                held, gram = held[order], gram[order]
                first = int(alone(np.int64(n), percent)) + 1 - (n - len(gram))
                if first <= 0:
                    continue
                first = min(first, len(gram))
                part = np.minimum(np.log2(held).astype(np.int64), FRAGMENTS) - 1
                ends = np.searchsorted(part, np.arange(FRAGMENTS + 1))
                for k, v in (("region", gram[:first].tolist()), ("sets", held[:first].tolist()), ("last", [False] * (first - 1) + [True])):
                    out[k] += v + [None] * FRAGMENTS
                out["fragment"] += [None] * first + list(range(FRAGMENTS))
                out["segment"] += [None] * first + [np.sort(gram[x:y]).tobytes() for x, y in zip(ends, ends[1:])]
                out["rep"] += [rep] * (first + FRAGMENTS)
                out["n"] += [n] * (first + FRAGMENTS)
            yield out

        return each

    both = written(arrow_map(rows, "rep long, n int, region long, sets long, last boolean, fragment int, segment binary", make), "ordered")
    return both.where("fragment is null").select("rep", "n", "region", "sets", "last"), both.where("length(segment) > 0").select("rep", "n", "fragment", "segment")


def counted(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of at least this similarity: partial overlaps of each fragment, summed per pair."""
    side = lambda c: segments.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), "fragment", F.col("segment").alias(f"segment_{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", "segment_a", "segment_b")

    def make():
        def each(batch):
            own = [np.concatenate([np.frombuffer(v, np.int64) for v in x]) for x in zip(*(batch.column(c).to_pylist() for c in (4, 5)))]
            for x in own:
                x.sort(kind="stable")
            yield {n: batch.column(i) for i, n in enumerate(("a", "b", "n_a", "n_b"))} | {"same": [int((x[1:] == x[:-1]).sum()) for x in own]}

        return each

    partial = arrow_map(both, "a long, b long, n_a int, n_b int, same long", make)
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("same").alias("same")).where(100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def next_by_size(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that are next to each other by size among those with the same last n-gram of one's first ones; large regions are sorted in salted groups."""
    salt = F.pmod(F.xxhash64("rep"), 1 + F.floor(F.col("sets") / GROUP))
    group = Window.partitionBy("region", salt).orderBy("n", "rep")
    near = members.select("rep", "n", "last", F.lead("rep").over(group).alias("next"), F.lead("n").over(group).alias("m")).where(F.col("last") & (100 * F.col("n") >= percent * F.col("m")))
    return near.select(F.least("rep", "next").alias("a"), F.greatest("rep", "next").alias("b")).distinct()


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id of the group) for each row. Ids are integers."""
    rows = written(described(docs, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "described")
    doc = F.col("doc_id").cast("long")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(least(doc, "row").alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("n_low").alias("n_low"))
    classes = written(classes.select("set_key", F.col("head.doc").alias("doc"), F.col("head.row").alias("rep"), "n_shingles", "n_low"), "classes")
    numbered = rows.where("set_key is not null").withColumnRenamed("row", "rep")
    copies = written(numbered.select("rep").join(classes.select("rep").hint("merge"), "rep", "left_anti"), "copies")
    shared = shared_counts(numbered.select("rep", "text").join(few(copies), "rep", "left_anti"), width)
    n = F.col("n_shingles")
    left = classes.join(shared.hint("merge"), "rep", "left").where(F.col("n_low") - F.coalesce("shared", F.lit(0)) <= n - F.ceil(percent * n / 100))
    sets = sets_of(numbered.select("rep", "text").join(few(written(left.select("rep"), "left")), "rep", "left_semi"), width)
    members, segments = ordered(sets, percent)
    confirm = lambda pairs: counted(pairs, segments, percent)
    near = written(confirm(written(next_by_size(members, percent), "next")), "near")
    named = closed(classes, near, members.select("rep", "region"), sets, confirm, percent)
    out = rows.select("doc_id", "n_shingles", "set_key").join(named.hint("merge"), "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("head").isNull(), doc).otherwise(F.col("head.doc")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""
