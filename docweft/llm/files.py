"""Files in the shared folder, read and written inside tasks through Arrow's file systems."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark import TaskContext


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def attempt_name(prefix: str) -> str:
    """A file name of this partition's present attempt, so that a repeated task never meets a half-written file."""
    context = TaskContext.get()
    return f"{prefix}-{context.partitionId():06d}-{context.taskAttemptId()}"


def under(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def make_folder(folder: str) -> None:
    system, path = opened(folder)
    system.create_dir(path, recursive=True)


def file_size(path: str) -> int:
    system, inner = opened(path)
    return system.get_file_info(inner).size


def base(path: str) -> str:
    return os.path.basename(path)
