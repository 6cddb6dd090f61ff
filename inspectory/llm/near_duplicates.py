"""MinHash near-duplicates with an LSH forest.

Each document's signature is cut into several trees' keys. All keys of a tree are sorted over the cluster (range
partitions, no task sees a whole region). Rows at the ends of partitions meet in a small second step. Next neighbours
are confirmed first on their full shingle sets, and connected components give the first groups. Then every region (the
rows of a tree that share a prefix) that these groups do not join yet is compared whole: a small one pair by pair, a
crowded one in blocks, each pair of blocks a task's bounded work. A pair is missed only if no tree gives it a common prefix.

Documents with equal shingle sets are one class and linked without candidates, so copies are never expanded into pairs.
Rows have numbers of their own, so neither repeated ids nor null ones confuse texts.

Null and empty texts have no shingles and are linked with nothing. Equal ids with unlike texts are separate documents
that share a name. A null id is linked by its text and is nobody's component. Repeated rows fall into one group. Very
long texts are taken whole. An empty table gives no rows. Carried columns may have any names but those of the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_map, shingles, small_batches, utf8, words, written
from .components import components, forest

TREES, DEPTH, LEAST_DEPTH, NEAREST, NEAR, PERCENT = 20, 6, 3, 1, 12, 80
#: A block of a crowded region: rows, and bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES, FEW_REGIONS = 1024, 4_000_000, 50_000

_rng = np.random.default_rng(20240511)
_MUL = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over a set, big-endian uint32, so bytes sort as numbers do."""
    out = np.full(len(_MUL), 2**32 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, ((s[at : at + 2048, None] * _MUL + _ADD) >> np.uint64(32)).min(0))
    return out.astype(">u4")


def described(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, carried, n_shingles, set_key (equal for equal sets; null without shingles) and sig."""
    kind = dict(docs.dtypes)[id_col]
    carried = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carried"))

    def make():
        def each(batch):
            sets = [shingles(words(t or b""), width) for t in utf8(batch.column(1))]
            yield {
                "doc_id": batch.column(0), "text": batch.column(1), "carried": batch.column(2),
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            }

        return each

    return arrow_map(source, f"doc_id {kind}, text string, carried {dict(source.dtypes)['carried']}, n_shingles long, set_key binary, sig binary", make)


def neighbours(tree: np.ndarray, key: np.ndarray, rep: np.ndarray, gap: np.ndarray | None = None, most: int = NEAR) -> np.ndarray:
    """Rows (less, greater, steps apart) for sorted rows at most ``most`` apart, of one tree, with a common prefix of LEAST_DEPTH values. No pair spans a gap (true: something is missing before this row)."""
    out = [np.empty((0, 3), np.int64)]
    run = np.cumsum(gap) if gap is not None else np.zeros(len(rep), np.int64)
    for step in range(1, most + 1):
        ok = (tree[step:] == tree[:-step]) & (run[step:] == run[:-step]) & (key[step:, :LEAST_DEPTH] == key[:-step, :LEAST_DEPTH]).all(1)
        a, b = rep[:-step][ok], rep[step:][ok]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), step)], 1))
    return np.concatenate(out)


def regions(tree: np.ndarray, key: np.ndarray, rep: np.ndarray, gap: np.ndarray | None = None) -> np.ndarray:
    """Rows (rep, region) for sorted rows next to one of their tree with the same prefix of LEAST_DEPTH values."""
    same = (tree[1:] == tree[:-1]) & (key[1:, :LEAST_DEPTH] == key[:-1, :LEAST_DEPTH]).all(1)
    if gap is not None:
        same &= ~gap[1:]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))
    name = [xxhash.xxh3_64_intdigest(int(tree[i]).to_bytes(4) + key[i, :LEAST_DEPTH].astype(">u4").tobytes()) for i in at]
    return np.stack([rep[at].astype(np.int64), np.array(name, np.uint64).view(np.int64)], 1)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (rep, sig): distinct pairs (a < b) that are next to each other in any order; and (rep, region) of all regions with several rows."""

    def make_keys():
        def each(batch):
            sigs = utf8(batch.column(1))
            n = 4 * DEPTH
            yield {"tree": [t for _ in sigs for t in range(TREES)], "key": [s[n * t : n * t + n] for s in sigs for t in range(TREES)], "rep": np.repeat(batch.column(0).to_numpy(), TREES)}

        return each

    keys = arrow_map(reps.select("rep", "sig"), "tree int, key binary, rep long", make_keys)
    ordered = keys.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    schema = "a long, b long, region long, part int, place long, n long, tree int, key binary"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        part, n, held, first = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            tree, key, rep = batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH), batch.column(2).to_numpy()
            if held is not None:
                tree, key, rep = (np.concatenate(x) for x in zip(held, (tree, key, rep)))
            new = len(rep) - (0 if held is None else len(held[2]))
            if n < NEAR:
                first = [(int(tree[i]), key[i].tobytes(), int(rep[i])) for i in range(min(NEAR, len(rep)))]
            n += new
            pairs, own = np.unique(neighbours(tree, key, rep, most=NEAREST), axis=0), regions(tree, key, rep)
            for columns in ({"a": pairs[:, 0], "b": pairs[:, 1]}, {"a": own[:, 0], "region": own[:, 1]}):
                yield pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * len(columns["a"])) for f in fields}, schema=fields)
            held = tree[-NEAR:], key[-NEAR:], rep[-NEAR:]
        if n:
            last = [(int(t), k.tobytes(), int(r)) for t, k, r in zip(*held)]
            ends = {i: x for i, x in enumerate(first)} | {n - len(last) + i: x for i, x in enumerate(last)}
            yield pa.RecordBatch.from_pydict({"a": [x[2] for x in ends.values()], "b": [None] * len(ends), "region": [None] * len(ends), "part": [part] * len(ends), "place": list(ends), "n": [n] * len(ends), "tree": [x[0] for x in ends.values()], "key": [x[1] for x in ends.values()]}, schema=fields)

    found = written(small_batches(ordered).mapInArrow(run, schema), "neighbours")
    spark = reps.sparkSession
    ends = found.where("part is not null").orderBy("part", "place").collect()  # at most 2 NEAR rows of each partition
    across: list[list[int]] = []
    named: list[list[int]] = []
    if ends:
        gap = [i > 0 and r.part == ends[i - 1].part and r.place != ends[i - 1].place + 1 for i, r in enumerate(ends)]
        at = np.array([r.tree for r in ends]), np.frombuffer(b"".join(bytes(r.key) for r in ends), ">u4").reshape(-1, DEPTH), np.array([r.a for r in ends]), np.array(gap)
        across, named = neighbours(*at, most=NEAREST)[:, :2].tolist(), regions(*at).tolist()
    pairs = found.where("b is not null").select("a", "b").unionAll(spark.createDataFrame(across, "a long, b long")).where("a <> b").distinct()
    members = found.where("region is not null").select(F.col("a").alias("rep"), "region").unionAll(spark.createDataFrame(named, "rep long, region long"))
    return pairs, members.distinct()


def full_sets(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, set) for each text of these ids."""

    def make_sets():
        def each(batch):
            yield {"rep": batch.column(0), "set": [shingles(words(t or b""), width).tobytes() for t in utf8(batch.column(1))]}

        return each

    return written(arrow_map(texts.join(ids.hint("shuffle_hash"), "rep", "left_semi"), "rep long, set binary", make_sets), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have at least this Jaccard similarity; sets: (rep, set)."""
    with_b = pairs.join(sets.withColumnsRenamed({"rep": "b", "set": "set_b"}).hint("merge"), "b")
    both = with_b.join(sets.withColumnsRenamed({"rep": "a", "set": "set_a"}).hint("merge"), "a").select("a", "b", "set_a", "set_b")

    def make():
        def each(batch):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = (len(x) + len(y)) // 8
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                z.sort(kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                ok.append(100 * same >= percent * (n - same))
            keep = pa.array(ok, pa.bool_())
            yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

        return each

    return arrow_map(both, "a long, b long", make)


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Number of common values of each set of x with each of y."""
    nx, lengths = len(x), np.array([len(s) for s in (*x, *y)])
    row = np.repeat(np.arange(len(lengths)), lengths)
    value, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    both = (np.bincount(at[row < nx], minlength=len(value)) > 0) & (np.bincount(at[row >= nx], minlength=len(value)) > 0)
    column = np.cumsum(both) - 1
    use = both[at]
    row, at = row[use], column[at[use]]
    out = np.zeros((nx, len(y)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for first in range(0, int(both.sum()), 4096):
        part = slice(*np.searchsorted(at, (first, first + 4096)))
        one = np.zeros((len(lengths), min(4096, int(both.sum()) - first)), np.float32)
        one[row[part], at[part] - first] = 1
        out += one[:nx] @ one[nx:].T
    return np.rint(out).astype(np.int64)


def linked(x: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Components to join in two blocks (columns of, set, side: 0, 1, or 2 in a block that meets itself)."""
    of, side = x.column("of").to_numpy(), x.column("side").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in x.column("set").to_pylist()]
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(a) or not len(b):
        return []
    size = np.array([len(s) for s in sets])
    same = shared([sets[i] for i in a], [sets[i] for i in b])
    ok = (100 * same >= percent * (size[a][:, None] + size[b][None, :] - same)) & (of[a][:, None] != of[b][None, :])
    i, j = np.nonzero(ok)
    return [(r, n) for n, r in forest(np.unique(np.stack([of[a[i]], of[b[j]]], 1), axis=0).tolist()).items() if n != r]


def crowded(members: DataFrame, stats: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of components to join: all rows (rep, of, size) of a region meet, except those of one component.

    A component that fills blocks has blocks of its own, which do not meet each other; the rest share blocks."""
    few = F.broadcast if stats.count() <= FEW_REGIONS else lambda df: df.hint("merge")
    rows = members.join(few(stats.select("region")), "region")
    heavy = written(rows.groupBy("region", "of").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "heavy")
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK_ROWS, b / BLOCK_BYTES, F.lit(1))).cast("int")
    large = (F.col("rows") > BLOCK_ROWS // 4) | (F.col("bytes") > BLOCK_BYTES // 4)
    rest = heavy.where(~large).groupBy("region").agg(blocks(F.sum("rows"), F.sum("bytes")).alias("n_rest"))
    own = heavy.where(large).select("region", "of", blocks(F.col("rows"), F.col("bytes")).alias("n_own"))
    few_own = F.broadcast if own.count() <= FEW_REGIONS else lambda df: df.hint("merge")
    rows = rows.join(few(rest), "region", "left").join(few_own(own), ["region", "of"], "left")
    mine = F.when(F.col("n_own").isNotNull(), F.col("of"))
    number = F.when(mine.isNotNull(), F.pmod(F.xxhash64("rep"), "n_own")).otherwise(F.pmod(F.xxhash64("rep"), "n_rest"))
    rows = written(rows.select("region", "rep", "of", mine.alias("mine"), number.alias("block")), "blocks")
    block = rows.select("region", "mine", "block").distinct().withColumn("name", F.xxhash64("mine", "block"))
    x, y = (block.select("region", F.col("name").alias(f"{c}_name"), F.col("mine").alias(f"{c}_mine")) for c in "xy")
    meet = x.join(y, "region").where((F.col("x_name") <= F.col("y_name")) & ((F.col("x_mine") == F.col("y_mine")).isNull() | (F.col("x_mine") != F.col("y_mine"))))
    alone = F.col("x_name") == F.col("y_name")
    sides = F.when(alone, F.array(F.struct(F.col("x_name").alias("name"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("x_name").alias("name"), F.lit(0).alias("side")), F.struct(F.col("y_name").alias("name"), F.lit(1).alias("side"))))
    meet = meet.select("region", F.xxhash64("region", "x_name", "y_name").alias("pair"), F.explode(sides).alias("s")).select("region", "pair", "s.name", "s.side")
    copies = rows.withColumn("name", F.xxhash64("mine", "block")).join(meet, ["region", "name"]).select("pair", "rep", "of", "side")
    own_rows = copies.join(sets.hint("merge"), "rep").select("pair", "of", "side", "set")

    def compare(table):
        found = linked(table, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return own_rows.groupBy("pair").applyInArrow(compare, "a long, b long")


def least(doc: Column, row: str) -> Column:
    """The least id of a group, null ids last, and its row."""
    return F.min(F.struct(F.isnull(doc).alias("none"), doc.alias("doc"), F.col(row).alias("row")))


def closed(classes: DataFrame, near: DataFrame, members: DataFrame, sets: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(set_key, head) of every class: head is (none, doc, row) of its component's least id.

    classes: set_key, doc, rep, n_shingles; near: links that are known; members: (rep, region), where any two linked classes
    share a region; sets: (rep, set) of the members; confirm: keeps linked pairs of (a, b). Regions of one component are
    closed; in others all rows of different components meet."""
    first = written(components(near), "first")
    group_of = first.select(F.col("node").alias("rep"), F.col("component").alias("of")).hint("merge")
    sizes = classes.select("rep", (8 * F.col("n_shingles")).alias("size")).hint("merge")
    members = written(members.join(group_of, "rep", "left").join(sizes, "rep").withColumn("of", F.coalesce("of", "rep")), "members")
    total = lambda salt: F.sum(F.xxhash64("rep", F.lit(salt)).cast("decimal(38,0)"))
    stats = members.groupBy("region").agg(F.count("*").alias("n"), F.min("of").alias("x"), F.max("of").alias("y"), total(1).alias("h"), total(2).alias("g"))
    stats = written(stats.where("x < y").dropDuplicates(["n", "h", "g"]).select("region", "n"), "open-regions")  # the same rows in several trees meet once
    few_rows = stats.where(F.col("n") <= NEAR + 1).select("region")
    few_rows = F.broadcast(few_rows) if few_rows.count() <= FEW_REGIONS else few_rows.hint("merge")
    small = written(members.join(few_rows, "region").select("region", "rep", "of"), "small-regions")  # a crowded region's rows never meet here
    side = lambda c: small.select("region", F.col("rep").alias(c), F.col("of").alias(f"of_{c}"))
    apart = written(side("a").join(side("b").hint("merge"), "region").where("a < b and of_a <> of_b").select("a", "b").distinct(), "apart")
    far = confirm(apart).unionAll(crowded(members, stats.where(F.col("n") > NEAR + 1), sets, percent))
    groups = written(components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(far)).withColumnRenamed("node", "rep"), "components")
    grouped = written(classes.select("rep", "doc").join(groups.hint("merge"), "rep"), "grouped")
    heads = written(grouped.groupBy("component").agg(least(F.col("doc"), "rep").alias("head")), "heads")
    grouped = grouped.join(heads.hint("merge"), "component").select("rep", "head")
    alone = F.struct(F.isnull("doc").alias("none"), "doc", F.col("rep").alias("row"))
    return written(classes.select("set_key", "rep", "doc").join(grouped.hint("merge"), "rep", "left").select("set_key", F.coalesce("head", alone).alias("head")), "groups")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of the group), kept (the id is its component's) and stays (true for
    exactly one row of each group) for each row; with ``carry`` also text and the carried columns. Ids are integers."""
    rows = written(described(docs, width, carry=carry).withColumn("row", F.monotonically_increasing_id()), "described")
    doc = F.col("doc_id").cast("long")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(least(doc, "row").alias("head"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes.select("set_key", F.col("head.doc").alias("doc"), F.col("head.row").alias("rep"), "sig", "n_shingles"), "classes")
    pairs, members = candidates(classes)
    members = written(members, "regions")
    sets = full_sets(members.select("rep").distinct(), rows.select(F.col("row").alias("rep"), "text"), width)  # neighbours share a region
    confirm = lambda pairs: confirmed(pairs, sets, percent)
    named = closed(classes, written(confirm(pairs), "near"), members, sets, confirm, percent)
    out = rows.drop("sig", *([] if carry else ["text", "carried"])).join(named.hint("merge"), "set_key", "left")
    stays = F.coalesce(F.col("row") == F.col("head.row"), F.lit(True))
    out = out.withColumn("component_id", F.when(F.col("head").isNull(), doc).otherwise(F.col("head.doc"))).withColumn("stays", stays)
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "stays", *(["text", "carried.*"] if carry else []))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4).drop("stays")
