"""PNG bytes as samples, and back: every colour type, bit depth, row filter and interlacing of the public format."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class NotPng(ValueError):
    """What isn't a whole and sound PNG."""


def _chunks(data: bytes) -> dict[bytes, bytes]:
    if not data.startswith(SIGNATURE):
        raise NotPng("signature")
    at, parts = len(SIGNATURE), {}
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if int.from_bytes(data[at + 8 + size : at + 12 + size], "big") != zlib.crc32(kind + body):
            raise NotPng("checksum")
        parts.setdefault(kind, []).append(body)
        at += size + 12
        if kind == b"IEND":
            return {k: b"".join(v) for k, v in parts.items()}
    raise NotPng("no end")


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters.

    Rows that add the one above them are running sums; where others need the bytes left and above left, diagonals are done whole.
    """
    high, wide = raw.shape[0], raw.shape[1] // step
    if (kinds[1:] == 2).all() and kinds[0] in (0, 2):
        return raw.cumsum(axis=0, dtype=np.uint8)
    out = np.zeros((high + 1, wide + 1, step), np.int16)
    filtered = raw.reshape(high, wide, step)
    for d in range(high + wide - 1):
        y = np.arange(max(0, d - wide + 1), min(high, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.choose(kinds[y][:, None], (np.int16(0), left, up, (left + up) >> 1, nearest))
        out[y + 1, x + 1] = (filtered[y, x] + guess) & 255
    return out[1:, 1:].reshape(high, wide * step).astype(np.uint8)


def _samples(rows: np.ndarray, wide: int, n: int, depth: int) -> np.ndarray:
    """(rows, wide, n) samples: the upper byte of two, or as they are below eight bits."""
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : wide * n * depth].reshape(len(rows), wide * n, depth)
        rows = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return rows.reshape(len(rows), wide, n)


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of bytes: grey, grey and alpha, RGB or RGBA; palettes become colours. Raises NotPng."""
    parts = _chunks(data)
    try:
        wide, high, depth, colour, packing, filters, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    except (KeyError, struct.error) as e:
        raise NotPng("header") from e
    if not wide or not high or colour not in SAMPLES or depth not in DEPTHS[colour] or packing or filters or laced > 1:
        raise NotPng("header")
    n = SAMPLES[colour]
    step = max(1, n * depth // 8)
    grids = [g for g in (PASSES if laced else ((0, 0, 1, 1),)) if wide > g[0] and high > g[1]]
    sizes = [(-(-(high - y) // down), -(-(wide - x) // across)) for x, y, across, down in grids]
    lengths = [(h, w, -(-w * n * depth // 8)) for h, w in sizes]
    total = sum(h * (1 + line) for h, _, line in lengths)
    try:
        raw = zlib.decompressobj().decompress(parts.get(b"IDAT", b""), total)
    except zlib.error as e:
        raise NotPng("data") from e
    if len(raw) < total:
        raise NotPng("data")
    pixels, at = np.zeros((high, wide, n), np.uint8), 0
    for (x, y, across, down), (h, w, line) in zip(grids, lengths):
        rows = np.frombuffer(raw, np.uint8, h * (1 + line), at).reshape(h, 1 + line)
        at += rows.size
        if rows[:, 0].max() > 4:
            raise NotPng("filter")
        pixels[y::down, x::across] = _samples(_unfilter(rows[:, 1:], rows[:, 0], step), w, n, depth)
    clear = parts.get(b"tRNS")
    if colour == 3:
        palette = np.frombuffer(parts.get(b"PLTE", b""), np.uint8)
        if not palette.size or palette.size % 3 or pixels.max() >= palette.size // 3:
            raise NotPng("palette")
        index, colours = pixels[..., 0], palette.reshape(-1, 3)
        if clear is None:
            return colours[index]
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[:256]
        return np.dstack([colours[index], alpha[index]])
    if colour == 2 and clear is not None and len(clear) == 6 and depth == 8:
        key = np.frombuffer(clear, np.uint8)[1::2]
        return np.dstack([pixels, np.where((pixels == key).all(axis=2), 0, 255).astype(np.uint8)])
    return pixels if depth >= 8 else (pixels.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)


def on_black(pixels: np.ndarray) -> np.ndarray:
    """Colours times their alpha, rounded; without an alpha as they are."""
    if pixels.shape[2] != 4:
        return pixels
    return ((pixels[..., :3].astype(np.uint32) * pixels[..., 3:] + 127) // 255).astype(np.uint8)


def encode_rgb(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width, 3) bytes, each row less the one above it."""
    above = np.vstack([np.zeros_like(pixels[:1]), pixels[:-1]])
    rows = (pixels - above).reshape(len(pixels), -1)
    body = np.hstack([np.full((len(rows), 1), 2, np.uint8), rows]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    header = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
