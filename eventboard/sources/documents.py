"""One file per record: a data source that writes documents under their own names, all of them or none.

    <path>/_staged-<job>/<task>/<name>     while the job runs; readers do not look into folders with an underscore
    <path>/gen-<job>/<task>/<name>         after the commit, one rename of the whole folder

A task writes into a folder of its own attempt, so a second attempt never meets the first one's files. On commit the
folders of attempts that did not count are dropped, the staged folder gets its name, and with ``overwrite`` what was
there before goes. If the job fails, it is marked as aborted before its staged folder goes; a task that is still writing
then looks for the mark when it is done and takes its files away itself. The next commit removes the mark. Files are
written through ``pyarrow.fs``, on the executors.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "documents"


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: int


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _is_there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def _drop(files: fs.FileSystem, folder: str) -> None:
    if _is_there(files, folder):
        files.delete_dir(folder)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _staged(self, root: str) -> str:
        return f"{root}/_staged-{self.job}"

    def _mark(self, root: str) -> str:
        return f"{root}/_aborted-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _at(self.path)
        task, n = uuid.uuid4().hex, 0
        folder = f"{self._staged(root)}/{task}"
        try:
            for row in iterator:
                if not n:
                    files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{row.path}") as out:
                    out.write(row.json.encode())
                n += 1
            if _is_there(files, self._mark(root)):
                raise RuntimeError("the job was aborted")
        except BaseException:
            _drop(files, folder)
            raise
        return Written(task, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _at(self.path)
        there = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        old = [f.path for f in there if f.base_name.startswith("gen-")]
        for f in there:
            if f.base_name.startswith("_aborted-"):
                _drop(files, f"{root}/_staged-{f.base_name.removeprefix('_aborted-')}")
                files.delete_file(f.path)
        good = {m.task for m in messages if m and m.files}
        if good:
            for f in files.get_file_info(fs.FileSelector(self._staged(root))):
                if f.base_name not in good:
                    files.delete_dir(f.path)
            files.move(self._staged(root), f"{root}/gen-{self.job}")
        else:
            files.create_dir(root, recursive=True)
        if self.overwrite:
            for path in old:
                files.delete_dir(path)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _at(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(self._mark(root)):
            pass
        _drop(files, self._staged(root))


class DocumentSource(DataSource):
    """``df.write.format("documents").save(path)`` of rows ``path, json``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if {"path", "json"} - set(schema.names):
            raise ValueError("documents are rows with the columns path and json")
        return DocumentWriter(self.options["path"], overwrite)


def write_documents(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A file for every row ``path, json``; all appear at once, and after a failure none does."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package installed
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.select("path", "json").write.format(FORMAT).mode(mode).save(path)
