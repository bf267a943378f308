"""Checksums of the containers: CRCs that shift towards the high bit, start at zero and are not flipped at the end."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Generator polynomials by width.
POLYNOMIALS = {8: 0x07, 16: 0x8005, 32: 0x04C11DB7}


@cache
def crc_table(bits: int) -> tuple[int, ...]:
    """The effect of each top byte on a register of this width."""
    poly, top, full = POLYNOMIALS[bits], 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & full
        out.append(r)
    return tuple(out)


def crc(data: bytes, bits: int, start: int = 0) -> int:
    table, shift, full = crc_table(bits), bits - 8, (1 << bits) - 1
    r = start
    for b in data:
        r = (r << 8 & full) ^ table[r >> shift ^ b]
    return r


def crc_column(data: Column, bits: int) -> Column:
    """CRC of a binary column, Arrow batches at a time; see the query catalogue for the form in SQL folds."""

    @pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else crc(bytes(v), bits)).astype("Int64")

    return run(data)


def pcm_md5(samples: Column, depth: int) -> Column:
    """MD5 of an array of samples as little-endian signed integers of whole bytes."""
    width = -(-depth // 8)
    digits = lambda x: F.right(F.hex(x.cast("long")), F.lit(2 * width))
    padded = lambda x: F.when(x < 0, digits(x)).otherwise(F.lpad(digits(x), 2 * width, "0"))
    little = lambda h: F.concat(*(F.substr(h, F.lit(2 * width - 2 * k - 1), F.lit(2)) for k in range(width)))
    return F.md5(F.unhex(F.array_join(F.transform(samples, lambda x: little(padded(x))), "")))
