"""Boxes and polygons as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Corners:
    """A box by two corners."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str) -> Corners:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def holds_center_of(self, other: Corners) -> Column:
        """Edges count as inside."""
        x, y = other.center
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)

    def iou(self, other: Corners) -> Column:
        w = F.greatest(F.lit(0.0), F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1))
        h = F.greatest(F.lit(0.0), F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1))
        union = self.area + other.area - w * h
        return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))

    def center_distance(self, other: Corners) -> Column:
        (ax, ay), (bx, by) = self.center, other.center
        return F.hypot(ax - bx, ay - by)


def pixel_corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Corners:
    """Normalized centre box to pixel corners, unclamped."""
    cx, cy, pw, ph = x * width, y * height, w * width, h * height
    return Corners(cx - pw / 2, cy - ph / 2, cx + pw / 2, cy + ph / 2)


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed polygon area of coordinate arrays."""
    n = F.size(xs)
    after = lambda a, i: F.get(a, F.pmod(i + 1, n))
    cross = lambda acc, i: acc + F.get(xs, i) * after(ys, i) - after(xs, i) * F.get(ys, i)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross) / 2


def roi_error(x: Column, y: Column, w: Column, h: Column) -> Column:
    from trailmark.functions.numeric import first_error

    return first_error(
        (x.isNull() | y.isNull() | w.isNull() | h.isNull(), "roi must be four integers"),
        ((x < 0) | (y < 0), "roi x and y must be non-negative"),
        ((w <= 0) | (h <= 0), "roi width and height must be greater than 0"),
    )


def roi_within_error(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.when((x + w > width) | (y + h > height), F.lit("roi exceeds the frame"))
