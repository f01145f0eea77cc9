"""Length-prefixed binary messages as map files and vector tiles use them: fields of numbers, reals and bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


#: Numbers up to which a plain loop is quicker than arrays.
FEW = 48


def packed(values) -> bytes:
    """Numbers of 0 to 2**64 - 1, each in groups of seven bits, lowest first, the top bit set on all but the last."""
    if len(values) <= FEW:
        out = bytearray()
        for v in values.tolist() if isinstance(values, np.ndarray) else values:
            v = int(v)
            if not 0 <= v < 1 << 64:
                raise OverflowError(f"{v} is no number of 64 bits")
            while v > 127:
                out.append(v & 127 | 128)
                v >>= 7
            out.append(v)
        return bytes(out)
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        return b""
    size = packed_sizes(v)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max())):
        on = size > k
        more = (size[on] > k + 1).astype(np.uint64) << np.uint64(7)
        out[start[on] + k] = (v[on] >> np.uint64(7 * k)) & np.uint64(127) | more
    return out.tobytes()


def packed_sizes(values: np.ndarray) -> np.ndarray:
    """How many bytes packed() gives each number."""
    v = np.asarray(values, dtype=np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    return size


def unpacked(data: bytes) -> np.ndarray:
    """The numbers that packed() wrote, as uint64."""
    if len(data) <= FEW:
        out, value, shift = [], 0, 0
        for x in data:
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                out.append(value & (1 << 64) - 1)
                value = shift = 0
        return np.array(out, dtype=np.uint64)
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def zigzag(values) -> np.ndarray:
    """Signed numbers as 0, -1, 1, -2, ... -> 0, 1, 2, 3, ..."""
    v = np.asarray(values, dtype=np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def steps(values) -> bytes:
    """Signed numbers packed as what each adds to the one before."""
    if len(values) > FEW:
        return packed(zigzag(np.diff(np.asarray(values, dtype=np.int64), prepend=0)))
    v, half = [int(x) for x in values], 1 << 63
    added = [((a - b + half) & 2 * half - 1) - half for a, b in zip(v, [0, *v[:-1]], strict=True)]
    return packed([d << 1 if d >= 0 else -2 * d - 1 for d in added])


def sums(data: bytes) -> np.ndarray:
    """The numbers that steps() wrote, as int64."""
    return np.cumsum(unzigzag(unpacked(data)))


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    return (v >> np.uint64(1)).view(np.int64) ^ -((v & np.uint64(1)).view(np.int64))


class Message:
    """Fields in the order in which they are put in."""

    def __init__(self):
        self.parts: list[bytes] = []

    def number(self, field: int, value: int) -> Message:
        self.parts.append(packed([field << 3, value]))
        return self

    def real(self, field: int, value: float) -> Message:
        self.parts.append(packed([field << 3 | 1]) + struct.pack("<d", value))
        return self

    def data(self, field: int, value: bytes | Message) -> Message:
        value = value.bytes() if isinstance(value, Message) else value
        self.parts.append(packed([field << 3 | 2, len(value)]) + value)
        return self

    def text(self, field: int, value: str) -> Message:
        return self.data(field, value.encode())

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def number_at(data: memoryview, at: int) -> tuple[int, int]:
    """A number, and where the next field begins."""
    value = shift = 0
    while True:
        x = data[at]
        at += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, at
        shift += 7


def fields(data: bytes | memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field, value) of a message, in order: a number, or the bytes of anything else."""
    view, at = memoryview(data), 0
    while at < len(view):
        tag, at = number_at(view, at)
        kind = tag & 7
        if kind == 0:
            value, at = number_at(view, at)
            yield tag >> 3, value
            continue
        if kind == 2:
            size, at = number_at(view, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"a field of kind {kind} is not read")
        if at + size > len(view):
            raise ValueError("the message ends within a field")
        yield tag >> 3, view[at : at + size]
        at += size
