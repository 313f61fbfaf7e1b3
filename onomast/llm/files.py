"""Files in any folder that all executors can reach, by URI (file, hdfs, s3, ...)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it; Hadoop's names for S3 are understood."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def sizes(uri: str, suffixes: tuple[str, ...], missing: bool = False) -> list[tuple[str, int]]:
    """(URI, bytes) of the file, or of all files below the folder with one of the suffixes, in order of their names; none for a folder that may be ``missing``."""
    system, path = resolve(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        if missing:
            return []
        raise FileNotFoundError(uri)
    base = uri.rstrip("/")
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    root = len(info.path.rstrip("/"))
    return sorted((base + x.path[root:], x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes) and not x.base_name.startswith((".", "_")))


def open_read(uri: str) -> pa.NativeFile:
    system, path = resolve(uri)
    return system.open_input_file(path)


@contextmanager
def open_write(uri: str) -> Iterator[pa.NativeFile]:
    """A file that gets its name only when it is whole, so that a task may be lost, repeated or run twice at once."""
    system, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}"
    try:
        with system.open_output_stream(part) as f:
            yield f
        system.move(part, path)
    except BaseException:
        try:
            system.delete_file(part)
        except OSError:
            pass
        raise
