"""Sliced detection against a look at the whole picture."""

import random
import struct

import numpy as np
import pytest

from boxwright.operators import sliced


def finder():
    def bright(pixels, _window=None):
        """Boxes of connected bright areas; the colour is the class."""
        out, seen = [], np.zeros(pixels.shape[:2], bool)
        for y, x in zip(*np.nonzero(pixels.max(axis=2)), strict=True):
            if not seen[y, x]:
                channel, x2, y2 = int(pixels[y, x].argmax()), x, y
                while x2 < pixels.shape[1] and pixels[y, x2, channel]:
                    x2 += 1
                while y2 < pixels.shape[0] and pixels[y2, x, channel]:
                    y2 += 1
                seen[y:y2, x:x2] = True
                out.append(sliced.Found(channel, float(pixels[y, x].max()) / 255, float(x), float(y), float(x2), float(y2)))
        return out

    return bright


bright = finder()  # nested, so that it is sent to tasks by value


def picture(r, width, height):
    pixels, taken = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    for _ in range(40):
        w, h = r.randrange(8, 60), r.randrange(8, 60)
        x, y = r.randrange(0, width - w), r.randrange(0, height - h)
        if not taken[max(0, y - 2) : y + h + 2, max(0, x - 2) : x + w + 2].any():
            taken[y : y + h, x : x + w] = True
            pixels[y : y + h, x : x + w, r.randrange(3)] = r.randrange(100, 256)
    return pixels


def ppm(pixels):
    return b"P6\n# made\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def bmp(pixels):
    h, w = pixels.shape[:2]
    lines = b"".join(row[:, ::-1].tobytes().ljust((3 * w + 3) // 4 * 4, b"\0") for row in pixels[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines


def test_objects_on_seams_appear_once(spark):
    r = random.Random(2)
    pictures = {k: picture(r, r.randrange(300, 700), r.randrange(250, 600)) for k in range(8)}
    images = spark.createDataFrame([(k, (ppm if k % 2 else bmp)(p)) for k, p in pictures.items()], "image_id long, content binary").repartition(3)
    raw = sliced.detect_slices(images, bright, size=200, overlap=0.4)
    assert raw.where("cut").count() > 20
    got = {(x.image_id, x.class_id, x.x1, x.y1, x.x2, x.y2) for x in sliced.predict_sliced(images, bright, size=200, overlap=0.4).collect()}
    want = {(k, f.class_id, f.x1, f.y1, f.x2, f.y2) for k, p in pictures.items() for f in bright(p)}
    assert got == want


def test_decoding_and_slices():
    p = picture(random.Random(1), 101, 90)
    assert (sliced.decode(ppm(p)) == p).all() and (sliced.decode(bmp(p)) == p).all()
    for bad in (b"", b"P6\n5 5\n255\nxx", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            sliced.decode(bad)
    covered = np.zeros((90, 101), bool)
    for w in sliced.slices(101, 90, 40, 0.25):
        covered[w.top : w.bottom, w.left : w.right] = True
    assert covered.all() and sliced.slices(30, 20, 40, 0.2) == [sliced.Window(0, 0, 30, 20)]
    with pytest.raises(ValueError):
        sliced.slices(10, 10, 5, 1.0)


def test_pictures_without_objects(spark):
    images = spark.createDataFrame([("a", ppm(np.zeros((50, 50, 3), np.uint8)))], "image_id string, content binary")
    assert sliced.predict_sliced(images, bright, size=20).count() == 0
