"""Lines in plain Python and numpy: simplification and well-known binary."""

from __future__ import annotations

import struct

import numpy as np


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas and Peucker's method, by a stack in place of recursion."""
    if len(points) < 3:
        return list(points)
    xy = np.asarray(points, float)
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    waiting = [(0, len(xy) - 1)]
    while waiting:
        i, j = waiting.pop()
        if j - i < 2:
            continue
        a, d = xy[i], xy[j] - xy[i]
        inner = xy[i + 1 : j]
        square = float(d @ d)
        t = np.clip(((inner - a) @ d) / square, 0, 1) if square else np.zeros(len(inner))
        away = np.hypot(*(inner - a - t[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            k += i + 1
            keep[k] = True
            waiting += [(i, k), (k, j)]
    return [points[k] for k in np.flatnonzero(keep)]


def from_wkb(raw: bytes) -> list[list[tuple[float, float]]]:
    """The parts of a point, line, or their multiples, as lists of x and y; further dimensions are left out."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if raw[at] else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        at += 5
        flags, kind = code >> 28, code & 0xFFFF
        if flags & 2:  # a reference system comes first
            at += 4
        width = 2 + (bool(flags & 8) + bool(flags & 4) if flags & 12 else {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000])
        kind %= 1000
        if kind == 1:
            row = struct.unpack_from(order + f"{width}d", raw, at)
            return [[row[:2]]], at + 8 * width
        (n,) = struct.unpack_from(order + "I", raw, at)
        at += 4
        if kind == 2:
            xy = np.frombuffer(raw, np.dtype(order + "f8"), n * width, at).reshape(n, width)[:, :2]
            return [[tuple(map(float, p)) for p in xy]], at + 8 * n * width
        if kind in (4, 5):
            parts = []
            for _ in range(n):
                own, at = read(at)
                parts += own
            return parts, at
        raise ValueError(f"geometry of kind {kind}")

    return read(0)[0]


def to_wkb(points: list[tuple[float, float]]) -> bytes:
    """A point (of one) or a line."""
    if len(points) == 1:
        return struct.pack("<BI2d", 1, 1, *points[0])
    return struct.pack("<BII", 1, 2, len(points)) + np.asarray(points, "<f8").tobytes()
