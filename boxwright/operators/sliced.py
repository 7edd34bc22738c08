"""Detection on overlapping slices of large pictures, as a table function over image bytes.

A task decodes a picture, hands its slices one by one to a predictor (any callable) and gives the boxes in picture coordinates; no more
than one picture is held. Seams are mended on Spark: a box that ends at an inner edge of its slice is a fragment if a larger box of
its class has most of it, and goes; what is left meets greedy suppression by class.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import window_starts
from boxwright.operators import matching


class Window(NamedTuple):
    left: int
    top: int
    right: int
    bottom: int


class Found(NamedTuple):
    """A detection in a slice's own pixels."""

    class_id: int
    confidence: float
    x1: float
    y1: float
    x2: float
    y2: float


Predictor = Callable[[np.ndarray, Window], Iterable[Found]]
_FOUND = "image_id {key}, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, cut boolean"


def decode(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3) of a binary PPM or an uncompressed 24-bit BMP; ValueError for others. Another decoder can be given."""
    if raw[:2] == b"P6":
        fields, at = [], 2
        while len(fields) < 3:
            end = raw.index(b"\n", at) if raw[at : at + 1] == b"#" else at
            if end > at:
                at = end + 1
                continue
            start = at
            while not raw[at : at + 1].isspace():
                at += 1
            if at > start:
                fields.append(int(raw[start:at]))
            at += 1
        width, height, most = fields
        if most == 255 and len(raw) - at >= 3 * width * height:
            return np.frombuffer(raw, np.uint8, 3 * width * height, at).reshape(height, width, 3)
    elif raw[:2] == b"BM" and len(raw) >= 54:
        (start,), (width, height), (bits, packed) = struct.unpack_from("<I", raw, 10), struct.unpack_from("<ii", raw, 18), struct.unpack_from("<HI", raw, 28)
        line = (3 * width + 3) // 4 * 4
        if bits == 24 and packed == 0 and len(raw) - start >= line * abs(height):
            rows = np.frombuffer(raw, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
            return rows[::-1] if height > 0 else rows
    raise ValueError("not a picture that can be decoded")


def slices(width: int, height: int, size: int, overlap: float) -> list[Window]:
    """Windows that cover a picture; the last ones end at its border."""
    if size < 1 or not 0 <= overlap < 1:
        raise ValueError("a slice needs a positive size and an overlap in [0, 1)")
    stride = max(1, round(size * (1 - overlap)))
    return [Window(x, y, min(x + size, width), min(y + size, height)) for y in window_starts(height, size, stride) for x in window_starts(width, size, stride)]


def in_picture(found: Iterable[Found], window: Window, width: int, height: int) -> Iterator[tuple]:
    """(class, confidence, box, cut) in picture coordinates, clipped to the slice; ``cut`` if the box ends at an edge that is not the picture's."""
    w, h = window.right - window.left, window.bottom - window.top
    for f in found:
        x1, y1, x2, y2 = max(0.0, f.x1), max(0.0, f.y1), min(float(w), f.x2), min(float(h), f.y2)
        if x2 > x1 and y2 > y1:
            cut = (x1 <= 0 < window.left) or (y1 <= 0 < window.top) or (x2 >= w and window.right < width) or (y2 >= h and window.bottom < height)
            yield f.class_id, f.confidence, x1 + window.left, y1 + window.top, x2 + window.left, y2 + window.top, cut


def detect_slices(images: DataFrame, predictor: Predictor, *, size: int = 640, overlap: float = 0.2, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """``images``: image_id, content. Every slice's boxes in picture coordinates."""
    key = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, content in zip(batch.column(0), batch.column(1), strict=True):
                pixels = decoder(content.as_py())
                height, width = pixels.shape[:2]
                rows = [r for w in slices(width, height, size, overlap) for r in in_picture(predictor(pixels[w.top : w.bottom, w.left : w.right], w), w, width, height)]
                if rows:
                    kinds = [pa.int32(), *[pa.float64()] * 5, pa.bool_()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    ids = pa.array([image_id.as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["image_id", "class_id", "confidence", "x1", "y1", "x2", "y2", "cut"])

    return images.select("image_id", "content").mapInArrow(run, _FOUND.format(key=key))


def mend_seams(found: DataFrame, *, contained: float = 0.7, nms_iou: float = 0.5) -> DataFrame:
    """One box for an object: cut boxes of which a larger one of their class has the share ``contained`` go, then greedy suppression over ``nms_iou``."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    marked = found.withColumn("area", area)
    whole = marked.select("image_id", "class_id", *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2", "area")))
    common = F.greatest(F.lit(0.0), F.least("x2", "o_x2") - F.greatest("x1", "o_x1")) * F.greatest(F.lit(0.0), F.least("y2", "o_y2") - F.greatest("y1", "o_y1"))
    met = (marked["image_id"] == whole["image_id"]) & (marked["class_id"] == whole["class_id"]) & marked["cut"] & (F.col("o_area") > F.col("area")) & (common >= contained * F.col("area"))
    kept = marked.join(whole, met, "left_anti").drop("area", "cut")
    order = [-F.col("confidence"), F.col("class_id"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    return matching.suppress(kept, ["image_id"], order, nms_iou, strict=True).where("verdict = 'accepted'").drop("verdict")


def predict_sliced(images: DataFrame, predictor: Predictor, *, size: int = 640, overlap: float = 0.2, nms_iou: float = 0.5, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """image_id, confidence, class_id and box of every object of every picture."""
    return mend_seams(detect_slices(images, predictor, size=size, overlap=overlap, decoder=decoder), nms_iou=nms_iou)
