"""Whole files in a shared folder, written under a temporary name and renamed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    system, name = system_of(path)
    system.create_dir(name, recursive=True)


@contextmanager
def whole_file(path: str) -> Iterator[pa.NativeFile]:
    """A file to write to; a task that runs twice leaves one complete file."""
    system, name = system_of(path)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        yield out
    system.move(temporary, name)


def write_whole(path: str, raw: bytes) -> None:
    with whole_file(path) as out:
        out.write(raw)
