"""Span records of the scanners, and what is made of them."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of overlapping (start, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlaps(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b in others)
