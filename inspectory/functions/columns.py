"""Column functions: numbers, vectors, boxes and names. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip01(c) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(c)))


def half_even(c, places: int = 4) -> Column:
    return F.bround(col(c), places)


def rate(part, whole, places: int = 4) -> Column:
    """part / max(whole, 1), half-even."""
    return half_even(col(part) / F.greatest(col(whole), F.lit(1)), places)


# vectors


def as_doubles(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v, eps: float = 1e-12) -> Column:
    n = l2_norm(v) + eps
    return F.transform(col(v), lambda x: x / n)


def unit_score(cosine) -> Column:
    return (1 + col(cosine)) / 2


def similarity(a, b) -> Column:
    """(1 + cosine) / 2"""
    return unit_score(dot(a, b) / ((l2_norm(a) + 1e-12) * (l2_norm(b) + 1e-12)))


def searchable(v) -> Column:
    return F.coalesce(F.size(col(v)) > 0, F.lit(False))


# boxes: names of four columns x0, y0, x1, y1, with a prefix


def edges(p: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1"))


def box_side(p: str = "") -> Column:
    x0, y0, x1, y1 = edges(p)
    return F.greatest(x1 - x0, y1 - y0)


def box_area(p: str = "") -> Column:
    x0, y0, x1, y1 = edges(p)
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = edges(a)
    bx0, by0, bx1, by1 = edges(b)
    return F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0)) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    return overlap(a, b) / F.greatest(box_area(a) + box_area(b) - overlap(a, b), F.lit(1e-6))


def overlap_of_smaller(a: str, b: str) -> Column:
    return overlap(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(1e-6))


def gap(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = edges(a)
    bx0, by0, bx1, by1 = edges(b)
    none = F.lit(0.0)
    return F.hypot(F.greatest(ax0 - bx1, bx0 - ax1, none), F.greatest(ay0 - by1, by0 - ay1, none))


def centre_inside(inner: str, outer: str) -> Column:
    ix0, iy0, ix1, iy1 = edges(inner)
    ox0, oy0, ox1, oy1 = edges(outer)
    return ((ix0 + ix1) / 2).between(ox0, ox1) & ((iy0 + iy1) / 2).between(oy0, oy1)


def intersects(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = edges(a)
    bx0, by0, bx1, by1 = edges(b)
    return (F.least(ax1, bx1) > F.greatest(ax0, bx0)) & (F.least(ay1, by1) > F.greatest(ay0, by0))


def union_box(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = edges(a)
    bx0, by0, bx1, by1 = edges(b)
    return F.struct(F.least(ax0, bx0).alias("x0"), F.least(ay0, by0).alias("y0"), F.greatest(ax1, bx1).alias("x1"), F.greatest(ay1, by1).alias("y1"))


# names and times


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def model_name(hint, backbone) -> Column:
    return F.concat(slug(F.coalesce(col(hint), F.lit("unknown-asset"))), F.lit("-"), col(backbone), F.lit("-coldstart-v1"))


def class_name(hint) -> Column:
    return F.translate(slug(hint), "-", "_")


def default_name(asset_class) -> Column:
    return F.concat(col(asset_class), F.lit("-patchcore-v1"))


def utc_day(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def iso(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def image_url(c) -> Column:
    return F.concat(F.lit("/image/"), col(c))


def severity_band(c) -> Column:
    return F.when(col(c) >= 0.75, "high").when(col(c) >= 0.5, "mid").otherwise("low")


def stable_order(key, seed: int = 1234) -> Column:
    """A shuffle that every engine repeats: by digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
