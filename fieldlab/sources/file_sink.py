"""Rows as single files, in two phases: a data source writer that shows no file of a failed write.

Tasks write below a hidden folder of the job, in one of their own, and say
what they wrote; the driver moves these to their names once all tasks have
ended, and at last writes _SUCCESS. What failed tasks, or other attempts of
the same, have written is never moved and goes with the hidden folder (a task
that still runs then may leave hidden files, which readers of stores skip).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fieldlab.functions.shipping import by_value
from fieldlab.sources.stores import store_of

#: Files moved at once.
MOVES = 16


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # (where it was written, its own path), below the root


def below(path: str) -> str:
    """The path as one below a root, whatever it looks like."""
    clean = posixpath.normpath("/" + str(path)).lstrip("/")
    if not clean:
        raise ValueError("a row without a path")
    return clean


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.hidden = root.rstrip("/"), f"_writing-{job}"

    def _at(self, name: str) -> str:
        return f"{store_of(self.root)[1].rstrip('/')}/{name}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, own = store_of(self.root)[0], f"{self.hidden}/{uuid.uuid4().hex}"
        names = []
        for row in rows:
            if row.path is None:
                raise ValueError("a row without a path")
            target = below(row.path)
            staged = f"{own}/{len(names)}"
            if not names:
                store.create_dir(self._at(own), recursive=True)
            with store.open_output_stream(self._at(staged)) as out:
                out.write(bytes(row.content or b""))
            names.append((staged, target))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store = store_of(self.root)[0]
        names = [n for m in messages if m is not None for n in m.names]
        for folder in {posixpath.dirname(target) for _, target in names}:
            store.create_dir(self._at(folder), recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda n: store.move(self._at(n[0]), self._at(n[1])), names))
        self.abort(messages)
        store.create_dir(self._at(""), recursive=True)
        with store.open_output_stream(self._at("_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store = store_of(self.root)[0]
        store.delete_dir_contents(self._at(self.hidden), missing_dir_ok=True)
        if store.get_file_info(self._at(self.hidden)).type.name == "Directory":
            store.delete_dir(self._at(self.hidden))


class FileSink(DataSource):
    """df.write.format("single_files"): rows (path, content) below the given path."""

    @classmethod
    def name(cls) -> str:
        return "single_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: write with mode append")
        return FileWriter(self.options["path"], uuid.uuid4().hex)


def write_files(files: DataFrame, root: str) -> None:
    """Writes (path, content) rows as single files below a root; a file that exists is replaced. Of rows with one path, one stays. A failure leaves the root as it was."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("path", "content").write.format("single_files").mode("append").save(root)


by_value(__name__)
