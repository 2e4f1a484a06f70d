"""Files by URI inside tasks: local paths, and the stores that Arrow knows (s3, gs, abfs, hdfs)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from fieldlab.functions.shipping import by_value


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it). Spark's `file:/x` is a local path like `/x`."""
    found = re.match(r"(\w[\w+.-]+):", uri)
    if found is None or found[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def listed(root: str, suffix: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files under a root with the suffix, whatever its case; hidden ones and those of unfinished writes are left out. A file is its own root."""
    store, path = store_of(root)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        below = f.path[len(path) :] if f is not info else ""
        if f.type == fs.FileType.File and f.path.lower().endswith(suffix) and not re.search(r"(^|/)[._]", below):
            yield f.path, f.size


def contents(paths: DataFrame) -> DataFrame:
    """(path) rows to (path, length, content), read in the tasks; a file that is gone has null content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = store_of(path)
                try:
                    with store.open_input_file(inside) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([data and len(data)], pa.int64()), "content": pa.array([data], pa.binary())})

    return paths.select("path").mapInArrow(work, "path string, length bigint, content binary")


by_value(__name__)
