"""Vorbis floors of type 1: a curve of straight lines in integer arithmetic, through points given in a fixed order."""

from __future__ import annotations

import numpy as np


def neighbours(x: list[int], k: int) -> tuple[int, int]:
    """Indices of the nearest smaller and larger of the places before the k-th."""
    low = max((i for i in range(k) if x[i] < x[k]), key=lambda i: x[i])
    high = min((i for i in range(k) if x[i] > x[k]), key=lambda i: x[i])
    return low, high


def point(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    """Height at x of the line, cut towards its start."""
    rise = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - rise if y1 < y0 else y0 + rise


def line(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Heights at x0 to x1 - 1."""
    at = np.arange(x1 - x0, dtype=np.int64)
    return y0 + np.sign(y1 - y0) * (abs(y1 - y0) * at // (x1 - x0))


def decibels(steps: int = 256) -> np.ndarray:
    """Amplitudes of the heights: equal steps in decibels that end at 1.

    The format fixes a table; the rule behind it is 1.0649863e-07 * exp(y * 0.062954784) for y under 256."""
    return (1.0649863e-07 * np.exp(np.arange(steps) * (np.log(1 / 1.0649863e-07) / (steps - 1)))).astype(np.float32)


def curve(x: list[int], y: list[int], multiplier: int, n: int) -> np.ndarray:
    """Amplitudes of n bins from the coded values y of the places x (the first two are the ends)."""
    top = {1: 256, 2: 128, 3: 86, 4: 64}[multiplier]
    used, height = [True, True], [y[0], y[1]]
    for k in range(2, len(x)):
        low, high = neighbours(x, k)
        expected = point(x[low], height[low], x[high], height[high], x[k])
        v, above, below = y[k], top - expected, expected
        room = 2 * min(above, below)
        if not v:
            used.append(False)
            height.append(expected)
            continue
        used[low] = used[high] = True
        used.append(True)
        if v >= room:
            height.append(expected + v - below if above > below else expected - v + above - 1)
        else:
            height.append(expected - (v + 1) // 2 if v % 2 else expected + v // 2)
    out = np.zeros(n, np.int64)
    order = [k for k in np.argsort(x, kind="stable").tolist() if used[k]]
    for a, b in zip(order[:-1], order[1:], strict=True):
        heights = line(x[a], height[a] * multiplier, x[b], height[b] * multiplier)
        out[x[a] : min(x[b], n)] = heights[: max(min(x[b], n) - x[a], 0)]
    if x[order[-1]] < n:
        out[x[order[-1]] :] = height[order[-1]] * multiplier
    return decibels()[np.clip(out, 0, 255)]


def uncouple(magnitude: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two channels from the magnitude and angle of a coupled pair."""
    toward = np.where(magnitude > 0, angle, -angle)
    return np.where(angle > 0, magnitude, magnitude + toward), np.where(angle > 0, magnitude - toward, magnitude)
