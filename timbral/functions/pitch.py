"""Prediction and pitch of recent output, as the concealment of the CELT layer of Opus uses them: in single precision,
in the order of the samples, since the fit is close to singular."""

from __future__ import annotations

import numpy as np

ORDER = 24


def autocorrelate(x: np.ndarray, lags: int, taper: np.ndarray | None = None) -> np.ndarray:
    """Sums of products by lag, with a noise floor of 10 at lag 0; ``taper`` rises over both ends."""
    x = np.array(x, np.float32)
    if taper is not None and len(taper):
        x[: len(taper)] *= taper
        x[len(x) - len(taper) :] *= taper[::-1]
    out = np.array([np.cumsum(x[k:] * x[: len(x) - k], dtype=np.float32)[-1] if k < len(x) else 0 for k in range(lags + 1)], np.float32)
    out[0] += np.float32(10)
    return out


def damp(r: np.ndarray) -> np.ndarray:
    """A noise floor 40 dB down and a lag window."""
    k = np.arange(len(r), dtype=np.float32) * np.float32(0.008)
    out = (r - r * k * k).astype(np.float32)
    out[0] = r[0] * np.float32(1.0001)
    return out


def fit(r: np.ndarray, order: int) -> np.ndarray:
    """Whitening filter of an autocorrelation; ends where 30 dB are gained."""
    a, error = np.zeros(order, np.float32), np.float32(r[0])
    for i in range(order if r[0] else 0):
        turn = np.float32(-(np.dot(a[:i], r[i:0:-1]) + r[i + 1]) / error)
        a[:i] += turn * a[:i][::-1].copy()
        a[i] = turn
        error -= turn * turn * error
        if error < np.float32(0.001) * r[0]:
            break
    return a


def whiten(x: np.ndarray, a: np.ndarray, past: np.ndarray | None = None) -> np.ndarray:
    """x plus the filter on the samples before; ``past``: the latest last."""
    n = len(a)
    line = np.concatenate([np.zeros(n, np.float32) if past is None else past[len(past) - n :], x]).astype(np.float32)
    return sum((np.float32(c) * line[n - 1 - k : len(line) - 1 - k] for k, c in enumerate(a)), line[n:].copy())


def colour(e: np.ndarray, a: np.ndarray, past: np.ndarray | None = None) -> np.ndarray:
    """The inverse: a signal from what whitening leaves."""
    n = len(a)
    line = np.concatenate([np.zeros(n, np.float32) if past is None else past[len(past) - n :], e]).astype(np.float32)
    back = np.asarray(a, np.float32)[::-1]
    for i in range(n, len(line)):
        line[i] -= np.dot(back, line[i - n : i])
    return line[n:]


def flatten(channels: list[np.ndarray]) -> np.ndarray:
    """Half the rate, channels added, with the spectrum's shape and slope taken out."""
    out = np.float32(0)
    for x in channels:
        x = np.asarray(x, np.float32)
        before = np.append(np.float32(0), x[1:-1:2])
        out = out + np.float32(0.5) * (np.float32(0.5) * (before + x[1::2]) + x[0::2])
    a = fit(damp(autocorrelate(out, 4)), 4) * np.float32(0.9) ** np.arange(1, 5, dtype=np.float32)
    return whiten(whiten(out, a.astype(np.float32)), np.array([0.8], np.float32))


def _two_best(scores: np.ndarray, y: np.ndarray, n: int) -> tuple[int, int]:
    """The two lags whose squared correlation is largest for the energy there; the earlier of equals."""
    square = y.astype(np.float64) ** 2
    energy, now = [], 1.0 + float(square[:n].sum())
    for i in range(len(scores)):
        energy.append(now)
        now = max(1.0, now + square[i + n] - square[i]) if i + n < len(square) else now
    rank = np.where(scores > 0, scores**2 / np.array(energy), -1.0)
    order = np.argsort(-rank, kind="stable")[:2].tolist()
    found = [k for k in order if rank[k] >= 0]
    return (*found, 0, 1)[:2] if found else (0, 1)


def _correlation(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(y.astype(np.float64), len(x))[:lags]
    return windows @ x.astype(np.float64)


def search(x: np.ndarray, y: np.ndarray, n: int, lags: int) -> int:
    """The lag, in samples before halving, at which y is most like x: all lags of every other sample, then those next to
    the two best, then a half step from the shape of the peak."""
    coarse = _two_best(_correlation(x[: n // 2 : 2][: n // 4], y[: (n + lags) // 2 : 2], lags // 4), y[: (n + lags) // 2 : 2], n // 4)
    near = np.min(np.abs(np.arange(lags // 2)[:, None] - 2 * np.array(coarse)), axis=1) <= 2
    scores = np.where(near, np.maximum(-1, _correlation(x[: n // 2], y, lags // 2)), 0.0)
    best = _two_best(scores, y, n // 2)[0]
    turn = 0
    if 0 < best < lags // 2 - 1:
        a, b, c = scores[best - 1 : best + 2]
        turn = 1 if c - a > 0.7 * (b - a) else -1 if a - c > 0.7 * (b - c) else 0
    return 2 * best - turn


def period(channels: list[np.ndarray], longest: int = 720, shortest: int = 100) -> int:
    """The period of the end of recent output."""
    flat = flatten(channels)
    n = 2 * len(flat)
    return longest - search(flat[longest // 2 :], flat, n - longest, longest - shortest)
