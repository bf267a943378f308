"""Streaming twins of the page operators: state is kept by logical stream, so a page is looked at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sequence_holes(pages: DataFrame) -> DataFrame:
    """serial, sequence, missing for each page of a stream that does not follow the one before it.

    Pages of a serial come in order; a page from before the last one seen is late and is passed over."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            out = []
            for sequence in sorted(frame.sequence.tolist()):
                if last is not None and sequence > last + 1:
                    out.append((key[0], sequence, sequence - last - 1))
                last = sequence if last is None else max(last, sequence)
            yield pd.DataFrame(out, columns=["serial", "sequence", "missing"])
        if last is not None:
            state.update((last,))

    return pages.select("serial", "sequence").groupBy("serial").applyInPandasWithState(run, "serial bigint, sequence bigint, missing bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
