"""The lapped cosine transform of 2n samples to n coefficients and back, by FFT or by a joined basis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basis(n: int) -> np.ndarray:
    """cos(pi / n * (j + 0.5 + n / 2) * (k + 0.5)), rows j < 2n, columns k < n."""
    j, k = np.arange(2 * n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi / n * (j + 0.5 + n / 2) * (k + 0.5))


def forward(x: np.ndarray) -> np.ndarray:
    """Coefficients of blocks (..., 2n), scaled by 2 / n."""
    n = x.shape[-1] // 2
    return np.asarray(x, np.float64) @ basis(n) * (2 / n)


def inverse(c: np.ndarray) -> np.ndarray:
    """Aliased samples (..., 2n) of coefficients (..., n), unscaled: one complex FFT of 2n points.

    With c[k] at frequency k + 0.5, the sum over k is the real part of a twisted inverse transform."""
    n = c.shape[-1]
    k, j = np.arange(n), np.arange(2 * n)
    turned = np.zeros((*c.shape[:-1], 2 * n), complex)
    turned[..., :n] = c * np.exp(1j * np.pi / n * (0.5 + n / 2) * k)
    return (np.fft.ifft(turned, axis=-1) * (2 * n) * np.exp(1j * np.pi / n * (j + 0.5 + n / 2) * 0.5)).real


def power_window(n: int) -> np.ndarray:
    """The power-complementary window of a block of n samples."""
    return np.sin(np.pi / 2 * np.sin((np.arange(n) + 0.5) / n * np.pi) ** 2)


def forward_rows(blocks: DataFrame, n: int) -> DataFrame:
    """block, k, c from rows (block, j, x): the basis is a formula on the exploded k, so nothing is joined."""
    rows = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wave = F.cos(F.lit(math.pi / n) * (F.col("j") + 0.5 + n / 2) * (F.col("k") + 0.5))
    return rows.groupBy("block", "k").agg((F.sum(F.col("x") * wave) * (2 / n)).alias("c"))


def overlap_add(blocks: DataFrame) -> DataFrame:
    """stream, channel, pos, x from rows (stream, channel, start, samples): overlapping parts add up."""
    rows = blocks.select("stream", "channel", "start", F.posexplode("samples").alias("j", "x"))
    return rows.groupBy("stream", "channel", (F.col("start") + F.col("j")).alias("pos")).agg(F.sum("x").alias("x"))
