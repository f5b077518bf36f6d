"""Files that tasks write to and read from the shared folder, through whichever store its URI names."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


@contextmanager
def writing(uri: str, attempt: int) -> Iterator:
    """A stream to a file that appears under its name when complete; a task's later attempt replaces an earlier one's file."""
    files, path = store(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{attempt}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, path)


def reading(uri: str):
    files, path = store(uri)
    return files.open_input_file(path)
