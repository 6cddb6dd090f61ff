"""Regions of maps that no task has to hold whole.

Hot cells go to square tiles, those near an edge to the neighbours too, so each tile opens its own cells exactly. Tiles
then meet four at a time, level by level: labels that touch across the inner edges become one, regions that reach no outer
edge are done and leave, and of the others only the cells on the outer edge go on. A task holds one tile or the edges of
four, so its size follows a map's perimeter, not its area, and a map of n tiles a side takes log2(n) rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

HALO = 2  # an opened cell depends on cells two steps away
AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n-1 that each number reaches by pairs (a, b)."""
    up = np.arange(n)
    while len(a) and (up[a] != up[b]).any():
        least = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], least)
        np.minimum.at(up, up[b], least)
        while (up[up] != up).any():
            up = up[up]
    return up


def touching(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of cells that touch by side or corner."""
    wide = int(x.max()) + 3 if len(x) else 3
    key = y.astype("int64") * wide + x + 1
    order = np.argsort(key, kind="stable")
    ordered, pairs = key[order], []
    for dy, dx in AHEAD:
        want = key + dy * wide + dx
        at = np.minimum(np.searchsorted(ordered, want), max(len(key) - 1, 0))
        hit = ordered[at] == want
        pairs.append((np.nonzero(hit)[0], order[at[hit]]))
    return np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])


def on_edge(y, x, top: int, left: int, side: int, h: int, w: int):
    """Cells that a cell of another square may touch; the map's own edge is none."""
    return ((y == top) & (top > 0)) | ((y == top + side - 1) & (y < h - 1)) | ((x == left) & (left > 0)) | ((x == left + side - 1) & (x < w - 1))


COLUMNS = ["frame_id", "ty", "tx", "map_h", "map_w", "label", "y", "x", "y1", "x1", "area", "peak", "done"]


def rows_of(like: pd.Series, ty: int, tx: int, label, y, x, edge, regions: pd.DataFrame) -> pd.DataFrame:
    """Edge cells (area 0) and regions; a region without an edge cell is done."""
    cells = pd.DataFrame({"label": label[edge], "y": y[edge], "x": x[edge], "y1": y[edge], "x1": x[edge], "area": 0, "peak": 0.0, "done": False})
    regions = regions.assign(done=~regions.label.isin(np.unique(label[edge])))
    out = pd.concat([cells, regions], ignore_index=True) if len(cells) else regions
    return out.assign(frame_id=like.frame_id, ty=ty, tx=tx, map_h=like.map_h, map_w=like.map_w)[COLUMNS]


def summed(label, y, x, y1, x1, area, peak) -> pd.DataFrame:
    own = pd.DataFrame({"label": label, "y": y, "x": x, "y1": y1, "x1": x1, "area": area, "peak": peak})
    return own.groupby("label", as_index=False).agg({"y": "min", "x": "min", "y1": "max", "x1": "max", "area": "sum", "peak": "max"})


def around(m: np.ndarray, how) -> np.ndarray:
    """All or any of the nine cells about each inner cell."""
    h, w = m.shape
    return how([m[a : h - 2 + a, b : w - 2 + b] for a in range(3) for b in range(3)], axis=0)


def tiled_regions(norm_cells: DataFrame, cut: float = 0.5, opened: bool = True, tile: int = 512) -> DataFrame:
    """Eight-connected regions of each frame's cells at or above ``cut`` (above 0), after a 3 x 3 opening: bbox, area, peak.

    A map reaches to its greatest y and x; cells that are not given are cold, cells without a place or value are left out, and
    of a cell given twice the greater value counts. Frames without a hot region have no row."""
    kind = dict(norm_cells.dtypes)["frame_id"]
    given = norm_cells.select("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("norm").cast("double").alias("norm")).where("frame_id is not null and y is not null and x is not null")
    size = given.groupBy("frame_id").agg((F.max("y") + 1).alias("map_h"), (F.max("x") + 1).alias("map_w"))
    hot = given.where((F.col("norm") >= cut) & ~F.isnan("norm")).join(size.hint("merge"), "frame_id")
    for at, axis, end in (("ty", "y", "map_h"), ("tx", "x", "map_w")):
        last = F.floor((F.col(end) - 1) / tile)
        steps = (F.floor((F.col(axis) + step) / tile) for step in (-HALO, 0, HALO))
        tiles = F.array_distinct(F.array(*(F.least(F.greatest(F.lit(0), step), last).cast("int") for step in steps)))
        hot = hot.withColumn(at, F.explode(tiles))

    def label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        like = pdf.iloc[0]
        ty, tx, h, w, side = int(like.ty), int(like.tx), int(like.map_h), int(like.map_w), tile + 2 * HALO
        top, left = ty * tile, tx * tile
        v = np.full((side, side), -np.inf)
        np.maximum.at(v, (pdf.y.to_numpy() - top + HALO, pdf.x.to_numpy() - left + HALO), pdf.norm.to_numpy())
        mask = v >= cut
        if opened:
            ys, xs = np.arange(top - HALO, top + tile + HALO), np.arange(left - HALO, left + tile + HALO)
            outside = ((ys < 0) | (ys >= h))[:, None] | ((xs < 0) | (xs >= w))[None]
            mask = around(around(mask | outside, np.all) & ~outside[1:-1, 1:-1], np.any) & ~outside[HALO:-HALO, HALO:-HALO]
        else:
            mask = mask[HALO:-HALO, HALO:-HALO]
        y, x = np.nonzero(mask)
        first = joined(len(y), *touching(y, x))
        y, x, peak = y + top, x + left, v[y + HALO, x + HALO]
        label = (y.astype("int64") * w + x)[first]
        return rows_of(like, ty, tx, label, y, x, on_edge(y, x, top, left, tile, h, w), summed(label, y, x, y, x, np.ones(len(y), "int64"), peak))

    def merge(side: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            like = pdf.iloc[0]
            ty, tx, h, w = int(like.ty) >> 1, int(like.tx) >> 1, int(like.map_h), int(like.map_w)
            is_cell = (pdf.area == 0).to_numpy()
            names, place = np.unique(pdf.label.to_numpy(), return_inverse=True)
            cells = pdf[is_cell]
            y, x, own = cells.y.to_numpy(), cells.x.to_numpy(), place[is_cell]
            a, b = touching(y, x)
            to = names[joined(len(names), own[a], own[b])[place]]
            regions, label = pdf[~is_cell], to[is_cell]
            merged = summed(to[~is_cell], *(regions[c].to_numpy() for c in ("y", "x", "y1", "x1", "area", "peak")))
            return rows_of(like, ty, tx, label, y, x, on_edge(y, x, ty * side, tx * side, side, h, w), merged)

        return run

    schema = f"frame_id {kind}, ty int, tx int, map_h int, map_w int, label long, y int, x int, y1 int, x1 int, area long, peak double, done boolean"
    rows = written(hot.groupBy("frame_id", "ty", "tx").applyInPandas(label_tile, schema), "tiles")
    found, side = rows.where("done"), tile
    while not (still := rows.where("not done")).isEmpty():
        side *= 2
        own = still.groupBy("frame_id", F.shiftright("ty", 1).alias("up_y"), F.shiftright("tx", 1).alias("up_x"))
        rows = written(own.applyInPandas(merge(side), schema), "tiles")
        found = found.unionAll(rows.where("done"))
    length = lambda hi, lo: (F.col(hi) - F.col(lo) + 1).alias
    return found.select("frame_id", "x", "y", length("x1", "x")("w"), length("y1", "y")("h"), F.col("area").cast("int").alias("area"), "peak", "map_w", "map_h")
