"""Corpus curation: pools, caps, duplicates, splits, minima, crops and box pools."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import written
from .ranks import numbered, small, with_group_size


def interleave(df: DataFrame, by: str = "asset_class", kind: str = "defect") -> DataFrame:
    """place: the first of each defect type, then the second of each, types in order."""
    return numbered(numbered(df, [by, kind], ["ord", "row_id"], "turn"), [by], ["turn", kind], "place").drop("turn")


def capped(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= most).drop("rn")


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Exact-content duplicates: the first of each key in order stays."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def close_pairs(df: DataFrame, distance: int, by: str | None = None, bits: int = 64, kept: int = 3) -> DataFrame:
    """Pairs (earlier, later) of fingerprints at most ``distance`` bits apart. Of distance + kept blocks, ``kept`` at least are equal, so pairs meet where some choice of ``kept`` blocks is."""
    blocks = distance + kept
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned(F.col("fp"), a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    keys = F.array(*(F.xxhash64(*([F.col(by)] if by else []), F.lit(i), *(block[j] for j in own)) for i, own in enumerate(combinations(range(blocks), kept))))
    rows = df.select("place", "fp", *([F.col(by).alias("own")] if by else [F.lit(0).alias("own")]), F.explode(keys).alias("key"))
    a, b = rows.select(F.col("place").alias("earlier"), F.col("fp").alias("fa"), "own", "key"), rows.select(F.col("place").alias("later"), F.col("fp").alias("fb"), "own", "key")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    return a.join(b.hint("merge"), ["key", "own"]).where("earlier < later").where(near).select("earlier", "later").distinct()


def perceptual_dedupe(df: DataFrame, distance: int, by: str | None = None) -> DataFrame:
    """Greedy, first seen stays: a row goes if a kept earlier one is within ``distance`` bits; below 0 nothing goes. Rows have place (unique order) and fp (64 bits).

    Equal fingerprints fall to their first row at once. Of the rest, each round keeps rows without an undecided earlier
    neighbour and drops the neighbours of kept rows, until none is undecided.
    """
    if distance < 0:
        return df
    first = first_of_each(df, ["fp", *([by] if by else [])], ["place"])
    if distance == 0:
        return first
    first = written(first, "first")  # read by the pairs and by the result
    open_pairs = written(close_pairs(first, distance, by), "pairs")
    dropped = open_pairs.select(F.col("later").alias("place")).limit(0)
    while not open_pairs.isEmpty():
        free = open_pairs.select(F.col("earlier").alias("place")).distinct().join(open_pairs.select(F.col("later").alias("place")), "place", "left_anti")
        gone = written(open_pairs.join(free.withColumnRenamed("place", "earlier").hint("merge"), "earlier", "left_semi").select(F.col("later").alias("place")).distinct(), "gone")
        dropped = dropped.unionAll(gone)
        g = gone.hint("merge")
        rest = open_pairs.join(g.withColumnRenamed("place", "later"), "later", "left_anti").join(g.withColumnRenamed("place", "earlier"), "earlier", "left_anti")
        open_pairs = written(rest.join(free.withColumnRenamed("place", "earlier").hint("merge"), "earlier", "left_anti"), "pairs")
    return first.join(dropped.distinct().hint("merge"), "place", "left_anti")


def fraction_split(df: DataFrame, by: str = "asset_class", share: float = 0.8, most_train: int = 120, most_test: int = 30) -> DataFrame:
    """train_good: at most 120 and 80 % of a class, one at least; then at most 30 test_good."""
    n_train = F.least(F.lit(most_train), F.greatest(F.lit(1), F.floor(share * F.col("n_own"))))
    df = with_group_size(numbered(df, [by], ["ord", "row_id"], "rn"), [by], "n_own").withColumn("n_train", n_train)
    split = F.when(F.col("rn") <= F.col("n_train"), "train_good").when(F.col("rn") <= F.col("n_train") + most_test, "test_good")
    return df.withColumn("split", split).where("split is not null").drop("rn", "n_train", "n_own")


def holdout_errors(rows: DataFrame, names: DataFrame, by: str = "asset_class") -> DataFrame:
    """(class, error): listed names that a class does not have, or a class of which every row is withheld. Both tables have a class and a name."""
    listed = names.select(by, "name").distinct()
    unknown = listed.join(rows.select(by, "name").hint("merge"), [by, "name"], "left_anti").select(by, F.concat(F.lit("not present: "), F.col("name")).alias("error"))
    left = rows.select(by, "name").join(listed.hint("merge"), [by, "name"], "left_anti").select(by).distinct()
    emptied = rows.select(by).distinct().join(left.hint("merge"), by, "left_anti").select(by, F.lit("every frame is held out").alias("error"))
    return unknown.unionAll(emptied)


def named_holdout(rows: DataFrame, names: DataFrame, by: str = "asset_class") -> DataFrame:
    """Rows with their split: listed names are held_out, the rest train_good. A list with an error is refused, because a wrong name would train on what it should withhold."""
    if errors := holdout_errors(rows, names, by).orderBy(by, "error").limit(5).collect():
        raise ValueError("; ".join(f"{r[0]}: {r.error}" for r in errors))
    listed = names.select(by, "name").distinct().withColumn("held", F.lit(True)).hint("merge")
    return rows.join(listed, [by, "name"], "left").withColumn("split", F.when(F.col("held"), "held_out").otherwise("train_good")).drop("held")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("asset_class").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train_good", "test_good", "test_defect", "held_out")))


def minima_failures(counts: DataFrame) -> DataFrame:
    """Failure rows: too few training or defect rows; normal-only classes need 8 and a held-out row."""
    full = F.col("test_defect") > 0
    why = F.concat_ws(
        "; ", F.when(full & (F.col("train_good") < 20), "fewer than 20 train_good"), F.when(full & (F.col("test_defect") < 5), "fewer than 5 test_defect"),
        F.when(~full & (F.col("train_good") < 8), "fewer than 8 train_good"), F.when(~full & (F.col("held_out") < 1), "no held_out"),
    )
    return counts.withColumn("why", why).where("why <> ''")


def resized(w, h, edge: int = 512):
    """Width and height with the longest edge at most ``edge``."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(C.col(w), C.col(h)))
    fit = lambda x: F.greatest(F.lit(1), F.floor(C.col(x) * scale)).cast("long")
    return fit(w), fit(h)


def square_crop(df: DataFrame, frame_w: float = 640.0, frame_h: float = 640.0, margin: float = 0.15, least: float = 4.0, small: float = 160.0) -> DataFrame:
    """A square around each box, inside the frame; boxes of at most 4 px are rejected, small ones flagged for upscaling."""
    side = F.least(C.box_side() * (1 + margin), F.lit(min(frame_w, frame_h)))
    df = df.where(C.box_side() > least).withColumn("side", F.floor(side))
    left = F.greatest(F.lit(0.0), F.least((F.col("x0") + F.col("x1")) / 2 - F.col("side") / 2, F.lit(frame_w) - F.col("side")))
    top = F.greatest(F.lit(0.0), F.least((F.col("y0") + F.col("y1")) / 2 - F.col("side") / 2, F.lit(frame_h) - F.col("side")))
    return df.withColumn("left", F.floor(left)).withColumn("top", F.floor(top)).withColumn("upscale", F.col("side") < small)


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select("frame_id", *(F.col(c).alias(p + c) for c in ("box_id", "x0", "y0", "x1", "y1")))


def pairs_in_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of boxes of two sets in the same frame, as a_* and b_*: for results that hold every such pair. ``near_pairs`` is for the others."""
    return prefixed(a, "a_").join(prefixed(b, "b_"), "frame_id")


FEW = 1024  # pairs of a frame that are looked at without cells
STEP = 4.0  # each level's cells are this many times as wide as those of the level below


def with_level(df: DataFrame, p: str, reach: float) -> DataFrame:
    """Corners in order, grown by ``reach``, and the lowest level whose cells are as wide as the box: at most four of them hold it."""
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        a, b = F.col(p + lo).cast("double"), F.col(p + hi).cast("double")
        df = df.withColumn(p + "g" + lo, F.least(a, b) - reach).withColumn(p + "g" + hi, F.greatest(a, b) + reach).where((F.abs(a) < float("inf")) & (F.abs(b) < float("inf")))
    side = F.greatest(F.col(p + "gx1") - F.col(p + "gx0"), F.col(p + "gy1") - F.col(p + "gy0"), F.lit(1.0))
    return df.withColumn(p + "level", F.ceil(F.log(STEP, side) + 1e-9).cast("int"))


def cell(x, level):
    return F.floor(C.col(x) / F.pow(F.lit(STEP), C.col(level))).cast("long")


def in_cells(df: DataFrame, p: str) -> DataFrame:
    """A row for each cell that the box touches at the row's ``level``."""
    for axis in ("x", "y"):
        df = df.withColumn("c" + axis, F.explode(F.sequence(cell(f"{p}g{axis}0", "level"), cell(f"{p}g{axis}1", "level"))))
    return df


def near_pairs(a: DataFrame, b: DataFrame, reach: float = 0.0) -> DataFrame:
    """Pairs of boxes of two sets in the same frame that touch, overlap, or are at most ``reach`` apart along both axes, as a_* and b_*, each once.

    Frames of at most FEW pairs meet as they are. In the others a box lies in the cells of a grid whose width suits it (levels by powers of four). Two boxes meet at the level of the
    larger one, so the smaller is put at the levels that the other set has in its frame, and there only at own-level boxes of
    the other side; small boxes never meet in a large box's cell. Of the cells that both touch, the one with the upper left
    corner of what they share gives the pair. A frame of any number of boxes is spread over its cells. Boxes with a null,
    NaN or infinite corner are in no pair; corners in wrong order are taken in order to find cells.
    """
    return met_pairs(written(prefixed(a, "a_"), "boxes-a"), written(prefixed(b, "b_"), "boxes-b"), reach)


def met_pairs(a: DataFrame, b: DataFrame, reach: float = 0.0) -> DataFrame:
    """``near_pairs`` of written sets with prefixes."""
    size = lambda df, name: df.groupBy("frame_id").agg(F.count("*").alias(name))
    crowded = size(a, "n_a").join(size(b, "n_b").hint("merge"), "frame_id").where(F.col("n_a").cast("double") * F.col("n_b") > FEW)
    crowded = written(crowded.select("frame_id"), "crowded")
    slack = reach + 1e-6 * (1 + reach) if reach else 0.0  # the caller's test decides; rounding must lose none before it
    a, b = with_level(a, "a_", slack), with_level(b, "b_", 0.0)
    left, top = F.greatest("a_gx0", "b_gx0"), F.greatest("a_gy0", "b_gy0")
    touch = (left <= F.least("a_gx1", "b_gx1")) & (top <= F.least("a_gy1", "b_gy1"))
    plain = lambda df: df.select("frame_id", *(p + c for p in ("a_", "b_") for c in ("box_id", "x0", "y0", "x1", "y1")))
    if crowded.isEmpty():
        return plain(a.join(b.hint("merge"), "frame_id").where(touch))
    few = [df.join(small(crowded), "frame_id", "left_anti") for df in (a, b)]
    few = plain(few[0].join(few[1].hint("merge"), "frame_id").where(touch))
    a, b = (df.join(small(crowded), "frame_id", "left_semi") for df in (a, b))

    def met(own: DataFrame, p: str, other: DataFrame, q: str, above: bool) -> DataFrame:
        """Own-level boxes of ``own`` with boxes of ``other`` of a lower level, or of the same one unless ``above``."""
        levels = own.groupBy("frame_id").agg(F.collect_set(p + "level").alias("levels"))  # one entry a power of four
        fits = (lambda x: x > F.col(q + "level")) if above else (lambda x: x >= F.col(q + "level"))
        raised = other.join(levels.hint("merge"), "frame_id").withColumn("level", F.explode(F.filter("levels", fits))).drop("levels")
        own = in_cells(own.withColumn("level", F.col(p + "level")), p)
        return own.join(in_cells(raised, q).hint("merge"), ["frame_id", "level", "cx", "cy"])

    pairs = met(a, "a_", b, "b_", False).unionByName(met(b, "b_", a, "a_", True))
    return few.unionByName(plain(pairs.where(touch & (F.col("cx") == cell(left, "level")) & (F.col("cy") == cell(top, "level")))))


def encroaches(metric: str, threshold: float = 0.0) -> F.Column:
    """Whether the boxes a_* and b_* of a pair pass a metric."""
    test = {"intersect": C.intersects("a_", "b_"), "iou": C.iou("a_", "b_") >= threshold, "overlap_smaller": C.overlap_of_smaller("a_", "b_") >= threshold, "gap": C.gap("a_", "b_") <= threshold}
    if metric not in test:
        raise ValueError(f"metric must be one of {sorted(test)}")
    return test[metric]


def encroaching(pairs: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    return pairs.where(encroaches(metric, threshold))


def every_pair(metric: str, threshold: float) -> bool:
    """A share of 0 or less is passed by all pairs of a frame."""
    return metric in ("iou", "overlap_smaller") and threshold <= 0


def encroachments(a: DataFrame, b: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    """Pairs that pass a metric, met by cells. A share of 0 or less is passed by all pairs of a frame, which are then made."""
    return encroaching(pairs_in_frame(a, b) if every_pair(metric, threshold) else near_pairs(a, b, max(threshold, 0.0) if metric == "gap" else 0.0), metric, threshold)


def encroached(a: DataFrame, b: DataFrame, variants: tuple[tuple[str, float], ...]) -> DataFrame:
    """Each box of ``a`` once a variant (metric and threshold): variant, box_id, and hit, whether any box of ``b`` in its frame passes.

    The sets meet once, as far apart as the widest variant reaches, and a pair is tested by all variants. Boxes are told apart by
    all their columns, as ids need not be unique; equal ones are counted."""
    a, b = written(prefixed(a, "a_"), "boxes-a"), written(prefixed(b, "b_"), "boxes-b")
    reach = max([0.0] + [t for metric, t in variants if metric == "gap"])
    pairs = a.join(b.hint("merge"), "frame_id") if any(every_pair(*v) for v in variants) else met_pairs(a, b, reach)
    hits = [F.coalesce(encroaches(*v), F.lit(False)).alias(f"hit{i}") for i, v in enumerate(variants)]
    found = pairs.select(*a.columns, *hits, F.lit(0).alias("own"))
    none = a.select("*", *(F.lit(False).alias(f"hit{i}") for i in range(len(variants))), F.lit(1).alias("own"))
    each = none.unionByName(found).groupBy(*a.columns).agg(F.sum("own").alias("n"), *(F.max(f"hit{i}").alias(f"hit{i}") for i in range(len(variants))))
    by = F.explode(F.array(*(F.struct(F.lit(metric).alias("variant"), F.col(f"hit{i}").alias("hit")) for i, (metric, _) in enumerate(variants))))
    return each.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(F.col("a_box_id").alias("box_id"), by.alias("v")).select("v.variant", "box_id", "v.hit")
