"""Media files as tables.  Files are read by Spark's binaryFile source, so any store that Spark reads will do;
one file is one task's work, and a file that a kernel rejects gives a row with ``error`` set, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, path: str, kernel: Callable[[bytes], Iterator[dict]], ddl: str) -> DataFrame:
    """Rows that ``kernel`` makes of each file's bytes, with path and error columns."""
    schema = spark.createDataFrame([], f"path string, {ddl}, error string").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, error = [], None
                try:
                    for row in kernel(content):
                        rows.append({**row, "path": name})
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                except (ValueError, IndexError) as e:
                    error = str(e)
                if error is not None:
                    rows.append({"path": name, "error": error})
                yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def save(frame: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files of any folder that pyarrow opens; returns (name, size).  A task that runs
    again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{at}/{name}", compression=None) as f:
                    f.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], ["name", "size"])

    return frame.select("name", "content").mapInArrow(run, "name string, size bigint")
