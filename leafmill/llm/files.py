"""Files in the shared folder, written and read by tasks through the file systems Arrow knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from leafmill.llm.common import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a fresh folder below the shared one."""
    top = shared_dir(spark)
    if "://" not in top and not top.startswith("file:"):
        top = "file://" + top
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4()}"


def opened(uri: str):
    """Arrow's file system for ``uri`` and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class RollingFile:
    """Files of about ``limit`` bytes, named afresh by each attempt of a task.

    A lost or repeated attempt leaves files that no row names; it never touches another's.
    """

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.stream, self.name, self.at = None, "", 0

    def roll(self) -> bool:
        """Open the next file if there is none or the last is full; tell whether it did."""
        if self.stream is not None and self.at < self.limit:
            return False
        self.close()
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        self.name, self.at = f"{uuid.uuid4()}{self.suffix}", 0
        self.stream = fs.open_output_stream(f"{path}/{self.name}")
        return True

    def write(self, data: bytes) -> int:
        """Append; returns where the data begin."""
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
