"""Ranges of files, by any URI that Arrow's file systems can open: what is read is what is asked for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str):
    """A file that can be read at any offset."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise ValueError("TooShort")
    return data


def listed(path: str) -> list[str]:
    """Files at or below a path, in order; hidden ones and those still being written (.partial) are left out."""
    uri = "://" in path or path.startswith("file:")
    system, at = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(at)] if uri and path.endswith(at) else "file://" if uri else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    names = (f.path for f in found if f.type == fs.FileType.File)
    return sorted(prefix + n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", ".")) and not n.endswith(".partial"))


def spans(start: int, stop: int, most: int) -> Iterator[tuple[int, int]]:
    for a in range(start, stop, most):
        yield a, min(stop, a + most)


def scratch(spark: SparkSession, name: str) -> str:
    """A new local path of this application below spark.checkpoint.dir, which all tasks can write to. Only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root and "://" in root.replace("file://", ""):
        raise ValueError("these files need a folder that is mounted on every machine")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = root.replace("file://", "").replace("file:", "") if root else f"{tempfile.gettempdir()}/gridloom-files"
    folder = f"{base.rstrip('/')}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    return folder
