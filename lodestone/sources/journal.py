"""Small files that tasks write and read in the shared folder, whatever its store."""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(uri: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    store, path = _store(uri)
    folder, name = os.path.split(path)
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, path)


def content(uri: str) -> bytes:
    """A whole file."""
    store, path = _store(uri)
    with store.open_input_stream(path, compression=None) as file:
        return file.read()


def lines(folder: str) -> Iterator[str]:
    """The lines of a folder's files, in any order; none where there is no folder."""
    store, path = _store(folder)
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and not info.base_name.startswith((".", "_")):
            # Compressed bytes as they are: the stream must not unpack them by the name.
            with store.open_input_stream(info.path, compression=None) as file:
                content = file.read()
            yield from (gzip.decompress(content) if info.path.endswith(".gz") else content).decode().split("\n")[:-1]


def names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in a folder's names, from the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [status.getPath().getName() for status in store.listStatus(where)] if store.exists(where) else []
    return sorted(name[len(prefix) :] for name in found if name.startswith(prefix))


def remove(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
