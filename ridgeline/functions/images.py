"""8-bit images as PNG files: grey, RGB and palettes, with or without alpha, all five row filters; written as RGB without a filter."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the kind of image (fixed values).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = rgb.reshape(h, 3 * w)
    parts = {b"IHDR": struct.pack(">II5B", w, h, 8, 2, 0, 0, 0), b"IDAT": zlib.compress(lines.tobytes(), 6), b"IEND": b""}
    out = bytearray(SIGNATURE)
    for name, body in parts.items():
        out += struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))
    return bytes(out)


def parts_of(data: bytes) -> dict[bytes, bytes]:
    """Bodies by name; those of one name together."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    out: dict[bytes, bytes] = {}
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        out[name] = out.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    return out


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows that begin with the number of their filter; step is the bytes of a pixel.

    A pixel needs the ones to its left, above and between these, so the pixels of one diagonal are made at once, and the
    diagonals follow each other.
    """
    kinds, h, w = lines[:, 0], lines.shape[0], (lines.shape[1] - 1) // step
    if kinds.max(initial=0) > 4:
        raise ValueError(f"there is no filter {kinds.max()}")
    given = lines[:, 1:].reshape(h, w, step).astype(np.int16)
    made = np.zeros((h + 1, w + 1, step), np.int16)  # with a row of zeros above and a column of zeros before
    for d in range(h + w - 1):
        k = np.arange(max(0, d - w + 1), min(h, d + 1))
        j = d - k
        left, up, corner = made[k + 1, j], made[k, j + 1], made[k, j]
        kind = kinds[k, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth(left, up, corner)], 0)
        made[k + 1, j + 1] = (given[k, j] + guess) & 255
    return made[1:, 1:].astype(np.uint8).reshape(h, w * step)


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one nearest to left + up - corner, the earlier of equally near ones."""
    three = np.stack([left, up, corner])
    nearest = np.abs(three - (left + up - corner)).argmin(axis=0)
    return np.take_along_axis(three, nearest[None], axis=0)[0]


def image_of(data: bytes) -> np.ndarray:
    """Height by width by 4 bytes, red, green, blue and alpha, of an image of 8 bits a sample that is not interlaced."""
    parts = parts_of(data)
    w, h, depth, kind, _, _, interlace = struct.unpack(">II5B", parts[b"IHDR"])
    if depth != 8 or kind not in SAMPLES or interlace:
        raise ValueError("only plain images of 8 bits a sample are read")
    n = SAMPLES[kind]
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + n * w)
    pixels = unfiltered(lines, n).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        table = np.zeros((256, 4), np.uint8)
        colours, alphas = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3), np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        table[: len(colours), :3], table[:, 3] = colours, 255
        table[: len(alphas), 3] = alphas
        return table[pixels[:, :, 0]]
    out[:, :, :3] = pixels[:, :, :3] if n > 2 else pixels[:, :, :1]
    if kind in (4, 6):
        out[:, :, 3] = pixels[:, :, -1]
    return out


def pixels_of(data: bytes) -> np.ndarray:
    """Red, green and blue alone."""
    return image_of(data)[:, :, :3]
