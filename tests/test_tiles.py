"""Regions by tiles against a flood fill of the whole map."""

import numpy as np
import pytest

from inspectory.operators.tiles import tiled_regions

SCHEMA = "frame_id long, y int, x int, norm double"
NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def flooded(cells, h, w, opened):
    """cells: {(y, x): value} of hot cells."""
    todo = set(cells)
    if opened:
        core = {(y, x) for y, x in cells if all((y + a, x + b) in cells for a, b in NEAR if 0 <= y + a < h and 0 <= x + b < w)}
        todo = {(y + a, x + b) for y, x in core for a, b in NEAR if 0 <= y + a < h and 0 <= x + b < w}
    out = []
    while todo:
        part, stack = set(), [todo.pop()]
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for a, b in NEAR:
                if (y + a, x + b) in todo:
                    todo.discard((y + a, x + b))
                    stack.append((y + a, x + b))
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part), max(cells[p] for p in part), w, h))
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r)[1:] for r in tiled_regions(df, **how).collect())


@pytest.mark.parametrize("opened,tile", [(True, 2), (True, 7), (False, 3)])
def test_any_tile_gives_the_same(spark, opened, tile):
    rng = np.random.default_rng(tile)
    v = np.where(rng.random((31, 26)) < (0.05 if opened else 0.3), 0.9, 0.1) * rng.random((31, 26))
    for y, x in zip(rng.integers(0, 31, 22), rng.integers(0, 26, 22)):  # blocks, some of them cut off by the map's edge
        v[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2] = 0.5 + rng.random() / 2
    df = spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(31) for x in range(26)], SCHEMA)
    want = flooded({(y, x): float(v[y, x]) for y in range(31) for x in range(26) if v[y, x] >= 0.5}, 31, 26, opened)
    assert found(df, opened=opened, tile=tile) == want and len(want) > 2


def test_a_map_that_no_task_holds(spark):
    """20,000 cells a side: long lines through many tiles, a ring, and specks on the corners of tiles."""
    side, rng = 20_000, np.random.default_rng(2)
    cells = {(7_000 + k // 3, k): 0.6 + k * 1e-6 for k in range(1_000, 9_000)}  # one region through sixteen tiles
    cells |= {(k, 15_000): 0.7 for k in range(0, side, 1)}  # edge to edge
    cells |= {(12_000 + int(900 * np.sin(t)), 5_000 + int(900 * np.cos(t))): 0.8 for t in np.linspace(0, 6.3, 12_000)}
    cells |= {(512 * i - int(rng.integers(2)), 512 * i - int(rng.integers(2))): 0.9 for i in range(1, 25)}
    rows = [(5, y, x, v) for (y, x), v in cells.items()] + [(5, side - 1, side - 1, 0.1)]
    got = found(spark.createDataFrame(rows, SCHEMA), opened=False)
    assert got == flooded(cells, side, side, False) and any(r[4] >= side for r in got)


def test_odd_cells(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 0, 0.6), (1, 3, 3, float("nan")), (1, None, 2, 0.9), (None, 1, 1, 0.9), (2, 4, 4, 0.2), (3, 9, 9, 0.5), (1, 2, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, tiled_regions(df, opened=False, tile=2).collect()))
    assert got == [(1, 0, 0, 1, 1, 1, 0.9, 4, 4), (3, 9, 9, 1, 1, 1, 0.5, 10, 10)]
    assert tiled_regions(df.limit(0)).count() == 0
