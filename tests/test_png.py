import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import png
from quirelake.operators import ocr_geometry


def write(pixels, colour, depth, laced=False, extra=(), filters=range(5)):
    """A PNG of (height, width, n) samples; row filters by the format's text, one byte at a time."""
    high, wide, n = pixels.shape
    body = b""
    for x, y, across, down in png.PASSES if laced else ((0, 0, 1, 1),):
        part = pixels[y::down, x::across]
        if not part.size:
            continue
        step, above = max(1, n * depth // 8), None
        for i, row in enumerate(part):
            bits = "".join(f"{v:0{depth}b}" for v in row.reshape(-1))
            line = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            up = above or bytes(len(line))
            kind = list(filters)[i % len(filters)]
            coded = bytearray()
            for j, v in enumerate(line):
                a, b, c = (line[j - step] if j >= step else 0), up[j], (up[j - step] if j >= step else 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                coded.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
            body += bytes([kind]) + bytes(coded)
            above = line
    head = struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, int(laced))
    half = len(zlib.compress(body)) // 2
    packed = zlib.compress(body)
    parts = [(b"IHDR", head), *extra, (b"IDAT", packed[:half]), (b"IDAT", packed[half:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("colour,depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
def test_every_mode(colour, depth, laced):
    rng = np.random.default_rng(depth + colour)
    for high, wide in ((1, 1), (7, 3), (13, 21)):
        pixels = rng.integers(0, 1 << depth, (high, wide, png.SAMPLES[colour]))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        extra = [(b"PLTE", palette.tobytes())] if colour == 3 else []
        want = palette[pixels[..., 0]] if colour == 3 else pixels >> 8 if depth == 16 else pixels * 255 // ((1 << depth) - 1)
        assert (png.decode(write(pixels, colour, depth, laced, extra)) == want).all()


def test_transparency_and_bad_bytes():
    index = np.arange(4).reshape(2, 2, 1)
    colours = [(b"PLTE", bytes(range(200, 212))), (b"tRNS", bytes([0, 128]))]
    got = png.decode(write(index, 3, 8, extra=colours))
    assert got[..., 3].tolist() == [[0, 128], [255, 255]] and png.on_black(got)[0].tolist() == [[0, 0, 0], [102, 102, 103]]
    rgb = np.array([[[255, 0, 0], [9, 9, 9]]])
    assert png.decode(write(rgb, 2, 8, extra=[(b"tRNS", struct.pack(">HHH", 255, 0, 0))]))[..., 3].tolist() == [[0, 255]]
    good = write(np.zeros((3, 3, 3), int), 2, 8)
    for bad in (b"", b"GIF89a", good[:-1], good[:40], good.replace(b"IDAT", b"IDAX"), good[:45] + b"\0" + good[46:], write(index, 3, 8), write(index, 3, 8, extra=[(b"PLTE", b"abc")])):
        with pytest.raises(png.NotPng):
            png.decode(bad)


def test_a_page_at_350_dpi_and_its_parts(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (400, 300, 3)).astype(np.uint8)
    page[:100, :150] = (220, 10, 10)
    grey, clear = write(np.full((4, 4, 1), 255), 0, 8), write(np.tile([255, 0, 0, 0], (2, 2, 1)), 6, 8)
    content = png.encode_rgb(page)
    none = (None,)
    rows = [("whole", content, *none), ("part", content, (-50.0, 0.0, 150.0, 200.0)), ("edge", content, (299.0, 0.0, 300.5, 1.0)), ("off", content, (700.0, 0.0, 800.0, 9.0)),
            ("grey", grey, *none), ("clear", clear, *none), ("bad", content[:99], *none), ("null", None, *none), ("thin", content, (5.0, 5.0, 5.0, 9.0))]
    images = spark.createDataFrame(rows, "image_id string, content binary, box struct<x0:double,y0:double,x1:double,y1:double>").withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    got = {r.image_id: (r.red_ratio, r.has_red_annotations) for r in ocr_geometry.red_share_of_png(images).collect()}
    r, g, b = (page[..., c].astype(int) for c in range(3))
    red = (r >= 180) & (r - g >= 70) & (r - b >= 70)
    assert got["whole"] == (red.mean(), True) and got["part"] == (1.0, True) and got["edge"] == (red[0:1, 149:151].mean(), True)
    assert got["off"] == got["thin"] == (None, None) and {got[k] for k in ("grey", "clear", "bad", "null")} == {(0.0, False)}
    assert ocr_geometry.red_share_of_png(images.limit(0)).count() == 0
    large = rng.integers(0, 256, (4000, 2900, 3)).astype(np.uint8)
    assert (png.decode(png.encode_rgb(large)) == large).all()


def test_running_sums_need_no_diagonals(monkeypatch):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (300, 3, 3), dtype=np.uint8)
    data = png.encode_rgb(pixels)
    monkeypatch.setattr(png.np, "choose", None)
    assert (png.decode(data) == pixels).all()
