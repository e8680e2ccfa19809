"""Files that tasks write to, and read from, the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from shortlist.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str):
    """(pyarrow file system, path) of a folder given as URI or as local path."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def open_map(system, path: str):
    """A file for reading: memory-mapped if it is on a mounted disk."""
    import pyarrow as pa
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path, "r")
    return system.open_input_file(path)
