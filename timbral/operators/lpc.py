"""Linear prediction: autocorrelation, the Levinson recursion for all orders at once, windows and quantised predictors.

``autocorrelation`` on rows is a self-join on the lag and a grouped sum; the rest works on one block's arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def autocorrelation_rows(signal: DataFrame, lags: int) -> DataFrame:
    """stream, k, r from rows (stream, i, x): sums of x[i] * x[i - k], partly summed before the shuffle by stream."""
    a = signal.select("stream", "i", F.col("x").alias("y")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(lags))))
    b = signal.select(F.col("stream").alias("__s"), F.col("i").alias("__i"), "x")
    return a.join(b, (F.col("stream") == F.col("__s")) & (F.col("__i") == F.col("i") - F.col("k"))).groupBy("stream", "k").agg(F.sum(F.col("x") * F.col("y")).alias("r"))


def autocorrelate(x: np.ndarray, lags: int) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return np.array([x[k:] @ x[: len(x) - k] if k < len(x) else 0.0 for k in range(lags + 1)])


def levinson(r: np.ndarray, order: int) -> tuple[list[np.ndarray], list[float]]:
    """Predictors of orders 1 to ``order`` and their error energies; stops where a reflection is 1 or more."""
    found, errors, a, e = [], [], np.zeros(0), float(r[0])
    for k in range(1, order + 1):
        if e <= 0:
            break
        reflection = (r[k] - a @ r[k - 1 : 0 : -1]) / e if k > 1 else r[1] / e
        if abs(reflection) >= 1:
            break
        a = np.append(a - reflection * a[::-1], reflection)
        e *= 1 - reflection * reflection
        found.append(a)
        errors.append(e)
    return found, errors


def tukey(n: int, taper: float) -> np.ndarray:
    """Flat in the middle, raised cosines over half the taper on each side, of a whole number of samples."""
    width = min(taper, 1.0) * (n - 1)
    at = np.minimum(np.arange(n), np.arange(n)[::-1])
    edge = int(width / 2) if taper > 0 else 0
    return np.where(at < edge, 0.5 * (1 - np.cos(2 * np.pi * at / max(width, 1e-9))), 1.0)


def quantise(coefficients: np.ndarray, precision: int) -> tuple[np.ndarray, int] | None:
    """Integer coefficients of so many bits and their shift (0 to 15); rounding errors pass on to the next."""
    largest = float(np.max(np.abs(coefficients), initial=0))
    if not largest or not math.isfinite(largest):
        return None
    shift = min(precision - 1 - math.frexp(largest)[1], 15)
    if shift < 0:
        return None
    limit, error, out = 1 << (precision - 1), 0.0, []
    for c in coefficients:
        error += c * (1 << shift)
        q = max(-limit, min(limit - 1, math.floor(error + 0.5)))
        error -= q
        out.append(q)
    return np.array(out, np.int64), shift


def predict(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """Residual of an integer predictor after its warm-up."""
    n = len(coefficients)
    past = np.lib.stride_tricks.sliding_window_view(x[:-1], n)[: len(x) - n] if len(x) > n else np.zeros((0, n), np.int64)
    return x[n:] - ((past @ coefficients[::-1]) >> shift)
