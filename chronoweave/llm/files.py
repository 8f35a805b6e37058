"""Files that tasks write to and read from the shared folder, wherever it is."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from chronoweave.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared one."""
    uri = shared_folder(spark)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    elif uri.startswith("/"):
        uri = "file://" + uri
    uri = f"{uri}/{name}-{uuid.uuid4().hex[:12]}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return uri


def own_name(stem: str, ending: str) -> str:
    """Name of a file of this attempt of this task.

    A repeated task writes another file; results name the files of the attempt that Spark kept.
    """
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{stem}-{c.partitionId():06d}-{c.taskAttemptId()}.{ending}"


def open_to_write(folder: str, name: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs.open_output_stream(f"{path}/{name}", compression=None)


class Readers:
    """Open input files of a folder, the most recently used ones."""

    def __init__(self, folder: str, most: int = 32):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.most, self.open = most, {}

    def get(self, name: str):
        if name not in self.open:
            while len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.open[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.get(name)
        f.seek(offset)
        return f.read(length)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}
