"""Box geometry as column functions. A box is four double columns (x1, y1, x2, y2), pixels unless said otherwise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO, ONE = 0.0, 1.0


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{n}") for n in cls._fields))

    @classmethod
    def in_struct(cls, struct: Column) -> Box:
        return cls(*(struct[n] for n in cls._fields))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip(self._fields, self, strict=True)]


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(ZERO), w) * F.greatest(F.lit(ZERO), h)


def iou(a: Box, b: Box, clamp_areas: bool = False) -> Column:
    """Intersection over union, 0 where the union is not positive. ``clamp_areas``: inverted boxes have no area."""
    area = (lambda x: F.greatest(F.lit(ZERO), x.width) * F.greatest(F.lit(ZERO), x.height)) if clamp_areas else (lambda x: x.area)
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(ZERO)


def flip_horizontal(box: Box, width: Column) -> Box:
    """Mirror image coordinates; its own inverse."""
    return Box(width - box.x2, box.y1, width - box.x1, box.y2)


def clamp(box: Box, width: Column, height: Column) -> Box:
    edge = lambda v, most: F.least(most, F.greatest(F.lit(ZERO), v))
    return Box(edge(box.x1, width), edge(box.y1, height), edge(box.x2, width), edge(box.y2, height))


def snap(box: Box, width: Column, height: Column, part: float = 1e-5) -> Box:
    """Edges within ``max(width, height) * part`` of the image border move onto it."""
    slack = F.greatest(width, height) * F.lit(part)
    edge = lambda v, most: F.when(F.abs(v) <= slack, ZERO).when(F.abs(v - most) <= slack, most).otherwise(v)
    return Box(edge(box.x1, width), edge(box.y1, height), edge(box.x2, width), edge(box.y2, height))


class YoloBox(NamedTuple):
    x_center: Column
    y_center: Column
    width: Column
    height: Column


def to_yolo(box: Box) -> YoloBox:
    """Normalised corners to centre and size, clamped to [0, 1] first."""
    unit = clamp(box, F.lit(ONE), F.lit(ONE))
    return YoloBox((unit.x1 + unit.x2) / 2, (unit.y1 + unit.y2) / 2, unit.width, unit.height)


def from_yolo(box: YoloBox, width: Column, height: Column) -> Box:
    return Box(
        (box.x_center - box.width / 2) * width,
        (box.y_center - box.height / 2) * height,
        (box.x_center + box.width / 2) * width,
        (box.y_center + box.height / 2) * height,
    )


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def polygon_bounds(points: Column) -> Box:
    """Bounding box of a flat array x0, y0, x1, y1, ..."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def window_starts(size: int, slice_size: int, stride: int) -> list[int]:
    """Left edges that cover ``size`` completely; the last window ends at the border."""
    if size <= slice_size:
        return [0]
    starts = list(range(0, size - slice_size + 1, stride))
    return starts if starts[-1] == size - slice_size else [*starts, size - slice_size]


def slice_starts(size: Column, slice_size: int, stride: int) -> Column:
    """The same as a column expression: an array of starts."""
    last = size - F.lit(slice_size)
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    whole = F.when(F.element_at(regular, -1) == last, regular).otherwise(F.array_append(regular, last))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(whole)


def finite(values: Column) -> Column:
    """Whether an array has four finite numbers."""
    infinite = float("inf")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(infinite))
    return F.coalesce((F.size(values) == 4) & F.forall(values, fine), F.lit(False))
