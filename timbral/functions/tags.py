"""Vorbis comments: a vendor string and NAME=value comments that may repeat and keep their order."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Longest field that is read.
LIMIT = 1 << 24


def parse(data: bytes, framing: bool = False) -> tuple[str, list[str]]:
    at = 0

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("comments end early")
        v = struct.unpack_from("<I", data, at)[0]
        at += 4
        return v

    def text() -> str:
        nonlocal at
        n = number()
        if n > LIMIT or at + n > len(data):
            raise ValueError("comment field is too long")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    vendor, count = text(), number()
    if count > (len(data) - at) // 4:
        raise ValueError("more comments than bytes")
    comments = [text() for _ in range(count)]
    if framing and (at >= len(data) or not data[at] & 1):
        raise ValueError("framing bit is missing")
    return vendor, comments


def encode(vendor: str, comments: list[str], framing: bool = False) -> bytes:
    field = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return field(vendor) + struct.pack("<I", len(comments)) + b"".join(map(field, comments)) + b"\1" * framing


def parse_column(data: Column, framing: bool = False) -> Column:
    """Struct (vendor, comments, error)."""

    @pandas_udf("struct<vendor:string,comments:array<string>,error:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append((*parse(bytes(v), framing), None) if v is not None else (None, None, None))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["vendor", "comments", "error"])

    return run(data)
